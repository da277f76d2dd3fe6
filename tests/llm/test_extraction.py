import random
from collections import Counter, defaultdict

import pytest

from docquery.llm.extraction import extracted, op13_html_extraction, parsed_pages, templates
from docquery.llm.html import page_of

PAGE = "page_id long, url string, html string, host string, text int"


def own(source):
    page = page_of(source)
    return [b for b, keep in zip(page.blocks, page.own, strict=True) if keep]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, []),
        ("", []),
        ("<", ["<"]),
        ("no markup at all", ["no markup at all"]),
        ("<article><h1>A &amp B</h1><p>x<b>y<p>z <span class='ad-slot'>buy</span> w<br>v</article>", ["A & B", "xy", "z w v"]),
        ("<p>1 &lt; 2 &amp;amp; &#233;&nbsp;&#xe9;</p><!-- <p>no</p> --><p>a <!----> b", ["1 < 2 &amp; é é", "a b"]),
        ("<script>var t='</p>';</script><style>p{}</style><noscript>no</noscript><p>yes</p><script>open", ["yes"]),
        ("<head><title>t</title><p>body begins", ["body begins"]),
        ("<header><h1>Site</h1></header><article><header><h1>Own</h1><p>by</p></header><p>text</p></article>", ["Own", "by", "text"]),
        ("<div role=navigation>n</div><div id='siteFooter'>f</div><p>text</p><section class=\"reader-comments\"><p>c</p></section>", ["text"]),
        ("<form><article><p>text</p><form>Name <input></form></article></form>", ["text"]),
        ("<nav><a>never closed<article><p>text</article>", ["text"]),
        ("<main><h1>T</h1><aside>s</aside><ul><li>one<li>two<ul><li>three</ul></ul></main><div>other</div>", ["T", "one", "two", "three"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("<ul><li><a href=1>Home</a><li><a>About</a><li><a>News</a></ul><p>Real <a>link</a> text</p>", ["Real link text"]),
        ("<DIV CLASS=Headline>kept</DIV><P TITLE='a>b'>also\n\t kept</P>", ["kept", "also kept"]),
        ("<article><p>a</div></td>b</p></article>", ["ab"]),
    ],
)
def test_blocks_of_the_article(source, want):
    assert own(source) == want


@pytest.mark.parametrize("source", ["<div>" * 30_000 + "x", "<b>" * 20_000 + "<p>x" * 20_000, "<li><b>x" * 20_000, '<a href="' * 50_000, "<p x= " * 50_000, "<" * 50_000, "</p>" * 50_000])
def test_hostile_pages_are_read_in_linear_time(source):
    page = page_of(source)
    assert len(page.blocks) == len(page.own) <= 20_001


def test_prose_and_majorities_are_no_subtrees():
    page = page_of("<article><p>same passage</p><div><p>most of the article is here</p></div><div>aside</div></article><div>after</div>")
    assert [page.blocks[a:z] for _, a, z in page.subtrees] == [["aside"], ["after"]]


def site(host, n, seed, marked):
    """Pages whose menu, notice and imprint have no telling names, some with copies and shared passages."""
    r = random.Random(seed)
    menu = "".join(f"<div><span>{host} section {i}</span></div>" for i in range(5))
    pages = []
    for i in range(n):
        body = "".join(f"<p>{' '.join(r.choice('alpha beta gamma delta'.split()) + str(r.randint(0, 999)) for _ in range(r.randint(3, 9)))}</p>" for _ in range(4))
        body += "<p>a passage that many articles share</p>" if marked else ""
        text = f"<div class=z1>{menu}</div>" + (f"<article>{body}<div class=q>We at {host} would like to tell you something.</div></article>" if marked else f"<div>{body}</div>") + f"<div>imprint of {host}</div>"
        pages.append((f"http://{host}/{i}", text))
    return pages + pages[:2] * n


def brute(pages, least=4, share=0.3):
    read = [(host, url, page_of(html)) for host, url, html in pages]
    sites = defaultdict(set)
    for host, _, p in read:
        if host:
            sites[host].add((tuple(p.blocks), tuple(h for h, *_ in p.subtrees)))
    many = {host: {h for h, n in Counter(h for _, hashes in seen for h in set(hashes)).items() if n >= least and n >= share * len(seen)} for host, seen in sites.items()}
    out = []
    for host, url, p in read:
        gone = {i for h, a, z in p.subtrees if h in many.get(host, ()) for i in range(a, z)}
        out.append((url, "\n".join(b for i, (b, keep) in enumerate(zip(p.blocks, p.own, strict=True)) if keep and i not in gone), len(gone)))
    return sorted(out)


def test_what_a_site_repeats_goes_and_what_articles_share_stays(spark):
    pages = [(host, *p) for k, (host, n) in enumerate([("a.example", 30), ("b.example", 6), ("few.example", 3)]) for p in site(host, n, k, k % 2 == 0)]
    rows = spark.createDataFrame([(i, url, html, "clash", 7) for i, (_, url, html) in enumerate(pages)], PAGE).repartition(7)
    found = extracted(rows).collect()
    assert sorted((r.url, r.text, r.n_site_blocks) for r in found) == brute(pages)
    for r in found:
        assert ("imprint" in r.text) == ("We at" in r.text) == ("section 0" in r.text) if "few" not in r.url else True
        assert r.n_chars == len(r.text) and r.text.count("\n") >= 3
        if "a.example" in r.url:
            assert "a passage that many articles share" in r.text and "We at" not in r.text and "section" not in r.text
        if "b.example" in r.url:
            assert "imprint" not in r.text and "section" not in r.text
    assert sum("few" in r.url and "imprint" not in r.text for r in found) == 9  # marked: structure alone


def test_copies_of_a_page_make_no_template(spark):
    rows = spark.createDataFrame([(i, "http://x.example/", "<div><div>one</div><div>two</div><div>three</div></div>", None, None) for i in range(50)], PAGE)
    assert templates(parsed_pages(rows)).collect() == []
    assert {r.text for r in extracted(rows).collect()} == {"one\ntwo\nthree"}


def test_nulls_repeats_long_and_no_pages(spark):
    long = "<p>" + "word " * 400_000
    rows = spark.createDataFrame([(1 << 60, None, "<p>a", None, 1), (1 << 60, "nowhere", "<p>a", None, 1), (None, "http://h/", None, None, 1), (3, "http://h/", "", None, 1), (4, "http://h/", long, None, 1)], PAGE)
    found = sorted(((r.page_id or 0, r.url or "", r.text[:9], r.n_chars) for r in extracted(rows).collect()))
    assert found == [(0, "http://h/", "", 0), (3, "http://h/", "", 0), (4, "http://h/", "word word", 1_999_999), (1 << 60, "", "a", 1), (1 << 60, "nowhere", "a", 1)]
    assert extracted(spark.createDataFrame([], PAGE)).collect() == []


def test_query_columns(spark, sf):
    found = op13_html_extraction(spark, sf)
    assert dict(found.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
