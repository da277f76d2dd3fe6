import hashlib
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from docquery.llm import warc
from docquery.llm.storage import fresh_path
from docquery.llm.url_filters import Automaton, RULES, host_glob, judged

PAGES = "page_id long, url string, html string, digest string, first string"


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_warc_round_trip(spark, chunk):
    rng = random.Random(5)
    rows = [(i, f"http://h/{i}", "".join(rng.choice(["<p>", "é", "\r\n\r\n", "WARC/1.1\r\n", "x" * 40, "\n"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    copy = "copied páge \r\n\r\n" * 20
    rows += [(100 + i, None, copy) for i in range(9, -1, -1)] + [(200, "u r\nl", None), (201, "", ""), (None, "n", copy), (203, "s", "short"), (202, "s", "short"), (100, "dup", copy)]
    rows += [(None, "a", "orphan" * 30), (None, "b", "orphan" * 30)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(3)
    path = fresh_path(spark, "warc-test")
    warc.write_archives(df, path, chunk)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(spark, path).collect()), key=str)
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = html == copy and page != 100
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 100 if revisit else None))
    assert got == sorted(want, key=str)
    chunks = warc.read_chunks(spark, path).where("record_type = 'response'").groupBy("archive", "record", "page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.hex("data").alias("h")))), lambda x: x["h"]), "").alias("h"))
    texts = {(r.page_id, bytes.fromhex(r.h).decode()) for r in chunks.collect()}
    assert texts == {(p, h or "") for p, _, h in rows if h != copy or p == 100}
    sizes = [r.n_bytes for r in warc.read_chunks(spark, path, data=False).collect()]
    assert max(sizes) <= chunk


def test_warc_of_nothing_and_damage(spark):
    df = spark.createDataFrame([], PAGES)
    path = fresh_path(spark, "warc-test")
    warc.write_archives(df, path)
    assert warc.read_records(spark, path).count() == 0
    import gzip

    whole = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:0\r\nWARC-Payload-Length: 3\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert len(list(warc.chunk_rows("a", iter([whole, whole[:9], whole[9:]]), True))) == 2
    for bad in (whole[:-3], whole[:60], b"no" + whole):
        with pytest.raises(ValueError):
            list(warc.chunk_rows("a", iter([bad]), True))
    folder = tempfile.mkdtemp(prefix="spark-")
    with gzip.open(f"{folder}/a.txt.gz", "wb") as out:
        out.write(whole)
    with pytest.raises(Exception, match="differs from its header"):
        warc.read_records(spark, folder).collect()


def test_many_shared_payloads(spark, monkeypatch):
    """More shared digests than may be broadcast: hot ones are, the others are joined by a shuffle."""
    monkeypatch.setattr(warc, "HOT", 4)
    rows = [(i, "u", "hot" * 50 if i % 3 else f"pair {i % 30} " * 20) for i in range(240)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.refers_to for r in warc._records(df, broadcast_digests=0).collect()}
    assert got == {r.page_id: r.refers_to for r in warc._records(df).collect()}
    assert got[1] is None and got[2] == 1 and got[30] == 0 and got[0] is None


def as_regex(glob):
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return re.compile("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts))


def test_automaton_matches_regexes():
    rng = random.Random(9)
    globs = ["".join(rng.choice(["a", "b", "/", "*", "**", "?", "ab/", "."]) for _ in range(rng.randrange(0, 40))) for _ in range(40)]
    texts = ["".join(rng.choice("ab/.") for _ in range(rng.randrange(0, 30))) for _ in range(300)] + [""]
    got = Automaton(globs).matches([t.encode() for t in texts])
    for r, glob in enumerate(globs):
        rule = as_regex(glob)
        assert [bool(rule.fullmatch(t)) for t in texts] == got[:, r].tolist(), glob


def test_rules_over_several_words():
    """The contract's rules between enough others that states cross 64-bit words."""
    others = [host_glob(f"host{i}.example.org", f"/path{i}/") for i in range(20)]
    globs = [*others[:7], *[host_glob(h, p) for _, h, p in RULES], *others[7:]]
    automaton = Automaton(globs)
    assert automaton.words > 3
    hosts = ["example.com", "a.www.example.com", "xexample.com", "net", "b.net", "host3.example.org", "c.host19.example.org"]
    urls = [(h, p) for h in hosts for p in ("/", "/en/", "/en", "/es/a", "/fr/x/y", "/path3/", "/path19/q")]
    got = automaton.matches([("." + h + p).encode() for h, p in urls])
    rules = [*[(f"host{i}.example.org", f"/path{i}/") for i in range(7)], *[(h, p) for _, h, p in RULES], *[(f"host{i}.example.org", f"/path{i}/") for i in range(7, 20)]]
    assert got.tolist() == [[("." + h).endswith("." + host) and p.startswith(path) for host, path in rules] for h, p in urls]


def test_rules(spark):
    urls = {
        "http://a.example.com/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://WWW.Example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://com/": ("com", "/", "com/", "allow"),
        "http://b.net/es/1": ("b.net", "/es/1", "net/es/", "block"),
        "http://b.net/es": ("b.net", "/es", None, "allow"),
        "http://b.org/a.net/es/": ("b.org", "/a.net/es/", None, "allow"),
        "http://É.NET/fr/ü": ("É.net", "/fr/ü", "net/fr/", "block"),
        "http://b.com?x": ("b.com", "", None, "allow"),
        "no scheme/x": ("", "", None, "allow"),
        "http://": ("", "", None, "allow"),
        "http://h.net/fr/a\nb#c": ("h.net", "/fr/a\nb", "net/fr/", "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, None, "d", "f") for i, u in enumerate(urls)] + [(None, "http://b.net/es/", None, None, None)]
    rules = [(v, h + p, host_glob(h, p)) for v, h, p in RULES]
    df = spark.createDataFrame(rows, PAGES)
    got = {r.page_id: tuple(r)[1:] for r in judged(df, rules).collect()}
    assert got == {**dict(enumerate(urls.values())), None: ("b.net", "/es/", "net/es/", "block")}
    assert {r.verdict for r in judged(df, [], "block").collect()} == {"block"}
    assert judged(df.where("false"), rules).count() == 0
