"""The registered queries of this subpackage and the DuckDB SQL of their results."""

from __future__ import annotations

from docquery.llm.clustering import op12_clustering
from docquery.llm.decontamination import op1_decontamination
from docquery.llm.extraction import op13_html_extraction
from docquery.llm.mixing import op8_mixing
from docquery.llm.near_dedup import op10_near_dedup
from docquery.llm.neighbours import op5_neighbours
from docquery.llm.sharding import op2_sharding
from docquery.llm.spelling import op11_spelling_variants
from docquery.llm.substring_dedup import op7_substring_dedup
from docquery.llm.suffix_dedup import op6_suffix_dedup
from docquery.llm.toxicity import op3_toxicity
from docquery.llm.url_filters import op9_url_filters
from docquery.llm.warc import op4_warc

QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_sharding, op3_toxicity, op4_warc, op5_neighbours, op6_suffix_dedup, op7_substring_dedup, op8_mixing, op9_url_filters, op10_near_dedup, op11_spelling_variants, op12_clustering, op13_html_extraction)
}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _centroid_rounds(rounds: int) -> str:
    """n<r>: each vector's centroid in round r; c<r>: components of the centroids that round r starts with."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""d{r} as (select v.vec_id, c, sum((v.x - c{r}.x) * (v.x - c{r}.x)) as far from v join c{r} using (i) group by all),
        n{r} as (select vec_id, arg_min(c, (far, c)) as c, min(far) as far from d{r} group by vec_id)""")
        out.append(f"""c{r + 1} as (select c{r}.c, c{r}.i, case when n is null then c{r}.x else (s - ((s % n) + n) % n) // n end as x
             from c{r} left join (select c, i, sum(x) as s, count(*) as n from v join n{r} using (vec_id) group by all) m on m.c = c{r}.c and m.i = c{r}.i)""")
    return ",\n        ".join(out[:-1])


#: A search is exact where a table has fewer vectors than it verifies at least (op5 below 512).
#: Classifiers (op3), tilings (op1) and trees (op2) are held against brute force and invariants in tests/llm instead.
ORACLES = {
    "op4_warc": """
        with facts as (select page_id, coalesce(octet_length(encode(html)), 0) as n, sha256(coalesce(html, '')) as digest from pages),
        first as (select digest, min(page_id) as page from facts where n >= 100 group by digest)
        select page_id, cast(n as bigint) as payload_bytes, facts.digest as payload_digest,
               case when page is null or page = page_id then 'response' else 'revisit' end as record_type,
               case when page <> page_id then page end as refers_to
        from facts left join first on facts.digest = first.digest and n >= 100
    """,
    "op5_neighbours": """
        with v as (select vec_id, embedding::double[] as e from embeddings),
        q as (select * from v where vec_id % 100 = 0),
        d as (select q.vec_id as query_id, v.vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, v.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda x, y: x + y)) as score
              from q join v on q.vec_id <> v.vec_id)
        select query_id, row_number() over (partition by query_id order by score, vec_id)::int as rank, vec_id, score from d qualify rank <= 10
    """,
    "op6_suffix_dedup": """
        with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        win as (select doc_id, pos, md5(substr(h, 2 * pos - 1, 800)) as k from (select doc_id, h, unnest(range(1, length(h) // 2 - 398)) as pos from b)),
        again as (select doc_id, pos from win qualify count(*) over (partition by k) > 1),
        edge as (select doc_id, pos, max(pos + 400) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as reach from again),
        numbered as (select doc_id, pos, sum(case when reach is null or pos > reach then 1 else 0 end) over (partition by doc_id order by pos) as run from edge),
        span as (select doc_id, run, min(pos) as a, max(pos) + 400 as z from numbered group by all),
        part as (select b.doc_id, coalesce(lag(z) over w, 1) as a, span.a as z, h from b join span using (doc_id) window w as (partition by doc_id order by span.a)
                 union all select b.doc_id, max(z), any_value(length(h)) // 2 + 1, any_value(h) from b join span using (doc_id) group by b.doc_id),
        kept as (select doc_id, string_agg(substr(h, 2 * a - 1, 2 * (z - a)), '' order by a) as k from part group by doc_id),
        gone as (select doc_id, sum(z - a) as r, count(*) as n from span group by doc_id)
        select b.doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(r, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256
        from b left join gone using (doc_id) left join kept using (doc_id)
    """,
    "op7_substring_dedup": f"""
        with w as (select doc_id, {WORDS} as ws from documents),
        word as (select doc_id, generate_subscripts(ws, 1) as pos, unnest(ws) as word from w),
        win as (select doc_id, pos, md5(array_to_string(ws[pos : pos + 19], ' ')) as h from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as pos from w)),
        again as (select doc_id, pos from win qualify row_number() over (partition by h order by doc_id, pos) > 1),
        gone as (select distinct doc_id, pos + i as pos from again, range(20) t(i)),
        kept as (select word.doc_id, count(*) as n, count(gone.pos) as r, coalesce(string_agg(word, ' ' order by word.pos) filter (where gone.pos is null), '') as t
                 from word left join gone on word.doc_id = gone.doc_id and word.pos = gone.pos group by word.doc_id)
        select w.doc_id, coalesce(n, 0) as n_words, coalesce(r, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)
    """,
    "op8_mixing": f"""
        with d as (select doc_id, source, cast(len({WORDS}) as bigint) as size from documents),
        q as (select doc_id, max(case when quality > 0 then 2.0 else 0.5 end)::double as quality from labels where quality is not null group by doc_id),
        k as (select d.*, -ln((('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / coalesce(quality, 1.0) as key
              from d left join q using (doc_id)),
        s as (select source, sum(size)::bigint as source_size, [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from d group by source),
        l as (select *, (sum(source_size) over () * 150 / 100 - coalesce(sum(2 * source_size) over (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
                        / sum(weight) over (order by source_size / weight, source nulls last rows between current row and unbounded following) as level from s),
        water as (select min_by(level, source_size / weight) as water from l where level * weight <= 2 * source_size),
        t as (select source, source_size, least(coalesce(water, 'inf'::double) * weight, 2 * source_size)::double as target from l, water),
        p as (select k.doc_id, k.size, t.source_size, t.target, case when t.source_size > 0 then floor(target / source_size) else 0 end as epochs,
                     coalesce(sum(size) over (partition by k.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
              from k join t on k.source is not distinct from t.source)
        select doc_id, size, source_size, target,
               (size * least(epochs + case when before + size / 2 <= target - epochs * source_size then 1 else 0 end, 2))::bigint as taken
        from p
    """,
    "op9_url_filters": r"""
        with r as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
        u as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
        rules(verdict, host, path) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        best as (select page_id, max_by(rules.host || rules.path, length(rules.host || rules.path)) as rule, max_by(rules.verdict, length(rules.host || rules.path)) as verdict
                 from u join rules on ends_with('.' || u.host, '.' || rules.host) and starts_with(u.path, rules.path) group by page_id)
        select u.page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') as verdict from u left join best using (page_id)
    """,
    "op10_near_dedup": f"""
        with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
        s as (select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
                     else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) end) as h from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.h = b.h and a.doc_id < b.doc_id group by all),
        link as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
        both_ways as (select a, b from link union all select b, a from link),
        reach as (select doc_id, doc_id as other from n union select reach.doc_id, both_ways.b from reach join both_ways on both_ways.a = reach.other),
        c as (select doc_id, min(other) as c from reach group by doc_id)
        select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.c, w.doc_id) as component_id, coalesce(c.c, w.doc_id) = w.doc_id as kept
        from w left join n using (doc_id) left join c using (doc_id)
    """,
    # crc32 is linear: that of as many zero bytes, and what each byte adds by its distance from the end
    "op11_spelling_variants": r"""
        with recursive bit(b, x, i) as (select b, b, 0 from range(256) t(b) union all select b, xor(x >> 1, case when x & 1 = 1 then 3988292384 else 0 end), i + 1 from bit where i < 8),
        tab as (select b, x as t from bit where i = 8),
        run as (select coalesce(doc_id::varchar, '') || ':' || x as key, x, count(*) as n
                from (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) as x from documents) group by all),
        size as (select max(octet_length(encode(key))) as most from run),
        far(b, x, k) as (select b, t, 0 from tab union all select far.b, xor(far.x >> 8, tab.t), k + 1 from far join tab on tab.b = far.x & 255, size where k < most),
        zero(x, k) as (select 4294967295, 0 union all select xor(zero.x >> 8, tab.t), k + 1 from zero join tab on tab.b = zero.x & 255, size where k < most),
        byte as (select key, octet_length(encode(key)) as len, unnest(range(octet_length(encode(key)))) as i from run),
        part as (select key, len, bit_xor(far.x) as x from byte join far on far.k = len - 1 - i and far.b = ('0x' || substr(hex(encode(key)), 2 * i + 1, 2))::bigint group by key, len),
        crc as (select key, xor(xor(part.x, zero.x), 4294967295) as h from part join zero on zero.k = len),
        spelt as (select case when h % 97 = 0 then substr(x, 1, h % length(x)) || substr(x, h % length(x) + 2) else x end as word, n from run join crc using (key)),
        w as (select word, sum(n)::bigint as n from spelt where length(word) >= 5 group by word having sum(n) >= 3),
        cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as k from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
        near as (select a.word, b.word as other, b.n from cut a join cut b on a.k = b.k and a.i = b.i and a.word <> b.word
                 union select cut.word, w.word, w.n from cut join w on w.word = cut.k union select w.word, cut.word, cut.n from cut join w on w.word = cut.k),
        best as (select word, count(*) as n_near, arg_min(other, (-n, other)) as form, max(n) as form_n from near group by word),
        f as (select w.word, case when form_n >= 2 * w.n then form end as form, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 2 * w.n then form_n end as form_n from w left join best using (word)),
        chain(word, root) as (select word, word from f union all select chain.word, form from chain join f on f.word = root where form is not null)
        select f.word, f.form, root, f.n, f.n_near, f.form_n from f join chain using (word) join f final on final.word = root and final.form is null
    """,
    "op12_clustering": f"""
        with kept as (select vec_id, embedding as e from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        v as (select vec_id, generate_subscripts(e, 1) as i, floor(256 * unnest(e)::double)::bigint as x from kept),
        start as (select vec_id, row_number() over (order by sha256('2:' || vec_id)) - 1 as c from kept qualify c < 40),
        c0 as (select c, i, x from v join start using (vec_id)),
        {_centroid_rounds(5)},
        each as (select c, sum(far)::bigint as cluster_inertia from n5 group by c),
        digest as (select c, sha256(string_agg(x::bigint::varchar, ',' order by i)) as centroid_sha256 from c5 group by c)
        select vec_id, c::int as cluster, far::bigint as distance, cluster_inertia, (sum(far) over ())::bigint as inertia, centroid_sha256 from n5 join each using (c) join digest using (c)
    """,
    # every page of these tables has one article of headings, paragraphs and inline marks
    "op13_html_extraction": r"""
        with b as (select page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '</?(p|h1)>') as parts from pages),
        x as (select page_id, url, parts, unnest(parts) as part, generate_subscripts(parts, 1) as i from b),
        t as (select page_id, url, i, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{3000}]+', ' ', 'g')) as block from x),
        j as (select page_id, string_agg(block, chr(10) order by i) as text from t where block <> '' group by page_id)
        select page_id, url, coalesce(text, '') as text, length(coalesce(text, ''))::bigint as n_chars from pages left join j using (page_id)
    """,
}
