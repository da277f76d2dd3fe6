"""DuckDB SQL of the registered queries, written from their definitions."""

from __future__ import annotations

from docquery.operators.answering import INSTRUCTION, REFUSAL

SOURCE = """md as (select doc_id + 1 as document_id, doc_id % 3 + 1 as workspace_id, '# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || array_to_string(list_transform(string_split(text, chr(10)),
        lambda x, i: case (i - 1) % 6 when 2 then '### Part' || chr(10) || chr(10) when 3 then '###### Deep' || chr(10) || chr(10) when 5 then '## ' || lang || chr(10) || chr(10) else '' end || x), chr(10) || chr(10)) as body from documents)"""
#: Lines, then headings, whose paths are built one after another, and paragraphs.
ELEMENTS = f"""{SOURCE},
    line as (select document_id, unnest(string_split(body, chr(10))) as raw, generate_subscripts(string_split(body, chr(10)), 1) as n from md),
    kind as (select *, trim(raw) as x, regexp_matches(trim(raw), '^#{{1,6}} ') as head, length(regexp_extract(trim(raw), '^#+')) as level from line),
    run as (select *, sum(case when head or x = '' then 1 else 0 end) over (partition by document_id order by n) as g, sum(case when head then 1 else 0 end) over (partition by document_id order by n) as h from kind),
    top as (select document_id, h, n, level, trim(substr(x, level + 2)) as title from run where head),
    stack as (select document_id, h, [title] as path from top where h = 1
              union all select top.document_id, top.h, list_concat(list_slice(stack.path, 1, least(len(stack.path), level - 1)), [title]) from stack join top on top.document_id = stack.document_id and top.h = stack.h + 1),
    para as (select document_id, h, min(n) as a, max(n) as z, trim(string_agg(raw, chr(10) order by n)) as text from run where not head and x <> '' group by document_id, g, h),
    el as (select document_id, h, text, 'paragraph' as element_type, array_to_string(path, ' > ') as path, null::bigint as heading_level, a, z from para join stack using (document_id, h)
           union all select document_id, h, title, 'heading', array_to_string(path, ' > '), level, n, n from top join stack using (document_id, h))"""


def split_cte(name: str, base: str, keys: str) -> str:
    """Recursive pieces of base (keys, rest, lim): at the last space that fits, else hard."""
    cut = "case when length(rest) <= lim then length(rest) else coalesce(nullif(greatest(lim + 1 - strpos(reverse(substr(rest, 1, lim + 1)), ' '), 0) * (strpos(substr(rest, 1, lim + 1), ' ') > 0)::int, 0), lim) end"
    return f"""{name} as (select {keys}, 0 as part, trim(substr(rest, 1, {cut})) as piece, trim(substr(rest, {cut} + 1)) as rest, lim from {base} where rest <> ''
        union all select {keys}, part + 1, trim(substr(rest, 1, {cut})), trim(substr(rest, {cut} + 1)), lim from {name} where rest <> '')"""


CHUNKS = f"""{ELEMENTS},
    p as (select document_id, h, path, a, z, text, row_number() over (partition by document_id order by a) as k, length(path) + 2 as pre, length(path) + 2 + length(text) > 1200 as over from el where element_type = 'paragraph'),
    big as (select document_id, k, text as rest, 1200 - pre as lim from p where over),
    {split_cte("piece", "big", "document_id, k")},
    pack as (select document_id, k, h, 1 as no, pre + length(text) as len, over from p where k = 1
             union all select p.document_id, p.k, p.h, case when not p.over and not pack.over and p.h = pack.h and pack.len + 2 + length(p.text) <= 1200 then no else no + 1 end,
                              case when not p.over and not pack.over and p.h = pack.h and pack.len + 2 + length(p.text) <= 1200 then pack.len + 2 + length(p.text) else p.pre + length(p.text) end, p.over
             from pack join p on p.document_id = pack.document_id and p.k = pack.k + 1),
    c0 as (select document_id, no, null::int as part, any_value(path) as section, min(a) as line_start, max(z) as line_end, count(*) as paragraphs, any_value(path) || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) order by k) as text
           from pack join p using (document_id, k) where not p.over group by document_id, no
           union all select document_id, no, part, path, a, z, 1, path || chr(10) || chr(10) || piece from pack join p using (document_id, k) join piece using (document_id, k)),
    c1 as (select *, row_number() over (partition by document_id order by no, part) - 1 as chunk_index, length(text) as char_count from c0),
    c as (select *, document_id % 3 as w, document_id * 1000000 + chunk_index + 1 as id,
                 sha256(section || chr(10) || chr(10) || chr(10) || trim(regexp_replace(text, '[ \\n]+', ' ', 'g')) || chr(10) || 'occurrence:' || (row_number() over (partition by document_id, section, trim(regexp_replace(text, '[ \\n]+', ' ', 'g')) order by chunk_index) - 1)) as chunk_id from c1)"""
DOT = "list_inner_product({0}::double[], {1}::double[])"


def embed(name: str, base: str, key: str, prefix: str) -> str:
    return f"""{name}_tok as (select {key}, ('0x' || substr(md5(x), 1, 7))::bigint % 16 as b from (select {key}, unnest(string_split(lower('{prefix}: ' || trim(t, ' ' || chr(10))), ' ')) as x from {base}) where x <> ''),
    {name}_cnt as (select {key}, b, count(*)::double as n from {name}_tok group by all),
    {name}_len as (select {key}, sqrt(sum(n * n)) as l from {name}_cnt group by all),
    {name} as (select {name}_len.{key}, i as bucket, coalesce(n, 0) / l as x from {name}_len cross join range(16) r(i) left join {name}_cnt on {name}_cnt.{key} = {name}_len.{key} and b = i)"""


VECTOR_HITS = f"""pt as (select vec_id + 1 as point_id, label + 1 as workspace_id, embedding as vector from embeddings),
    q as (select point_id - 1 as query_id, workspace_id, vector from pt where (point_id - 1) % 20 = 0),
    s as (select query_id, q.workspace_id::bigint as workspace_id, point_id, {DOT.format("pt.vector", "q.vector")} as score from q join pt using (workspace_id)),
    hit as (select *, row_number() over (partition by query_id order by round(score, 12) desc, point_id)::int as rank from s qualify rank <= 5)"""
STORE = f"""{CHUNKS},
    stored as (select id as chunk_db_id, (document_id - 1) % 3 + 1 as workspace_id, chunk_id, document_id, 'doc-' || (document_id - 1) || '.md' as document_name, 'markdown' as source_type,
                      chunk_index::int as chunk_index, section, null::int as page_start, null::int as page_end, text from c),
    body as (select chunk_db_id as point_id, text as t from stored), {embed("v", "body", "point_id", "passage")}"""


def hits(k: int) -> str:
    return f"""{STORE},
    q as (select doc_id as query_id, doc_id % 3 + 1 as workspace_id, text as t from documents where doc_id % 20 = 0), {embed("u", "q", "query_id", "query")},
    s as (select query_id, q.workspace_id, point_id, sum(u.x * v.x) as score from u join q using (query_id) join stored on stored.workspace_id = q.workspace_id join v on v.point_id = chunk_db_id and v.bucket = u.bucket group by all),
    hit as (select *, row_number() over (partition by query_id order by round(score, 12) desc, point_id)::int as rank from s qualify rank <= {k})"""


STORED = f"""{hits(12)},
    ctx as (select query_id, rank, score, stored.* from hit join stored on point_id = chunk_db_id and hit.workspace_id = stored.workspace_id)"""
BLOCKS = f"""{STORED},
    b0 as (select *, row_number() over (partition by query_id order by rank) as n from ctx),
    b1 as (select *, 'SOURCE_' || n as source_id, concat('[SOURCE_', n, ']', chr(10), 'document: ', document_name, chr(10), 'page: ',
                  case when page_start is null and page_end is null then 'N/A' when page_start is null then page_end::varchar when page_end is null or page_start = page_end then page_start::varchar else page_start || '-' || page_end end,
                  chr(10), 'section: ', coalesce(section, 'N/A'), chr(10), 'chunk_id: ', chunk_id, chr(10), 'content:', chr(10), text) as block from b0),
    src as (select *, sum(length(block) + 2) over (partition by query_id order by n) - 2 <= 12000 as included from b1),
    packed as (select query_id, coalesce(string_agg(block, chr(10) || chr(10) order by n) filter (where included), '') as prompt_context, count(*) filter (where included) as source_count, count(*) filter (where not included) as omitted_count from src group by query_id)"""
REPLIES = f"""{BLOCKS},
    r0 as (select query_id, max(n) as m, query_id // 20 % 6 as kind from src where included group by query_id),
    rep as (select query_id, kind, case kind when 0 then 'answer ' || query_id when 1 then 'none' when 2 then 'x' when 5 then 'z' end as text,
                   case kind when 0 then list_transform(range(1, m + 1), lambda i: 'SOURCE_' || i) when 1 then []::varchar[] when 2 then ['SOURCE_99', 'SOURCE_1', 'SOURCE_99'] when 5 then ['SOURCE_1', 'SOURCE_2', 'SOURCE_1'] end as ids,
                   case when kind in (0, 2, 5) then false when kind = 1 then true end as refused,
                   case kind when 3 then 'answer field ''text'' must be a string' when 4 then 'answer field ''cited_source_ids'' must be an array of strings' end as error_message from r0),
    said as (select query_id, i - 1 as pos, ids[i] as source_id from (select query_id, ids, unnest(range(1, len(ids) + 1)) as i from rep where not refused)),
    mention as (select query_id, source_id, (row_number() over (partition by query_id order by min(pos)) - 1)::int as position from said group by query_id, source_id),
    cit as (select mention.position, src.* from mention join src on src.query_id = mention.query_id and src.source_id = mention.source_id and included)"""
GOLDEN = f"""{hits(25)},
    gold as (select query_id, chunk_id as expected_chunk_id from q join stored on document_id = query_id + 1 and chunk_index = 0),
    told as (select query_id, rank, chunk_id from hit join stored on chunk_db_id = point_id),
    ranked as (select gold.query_id, expected_chunk_id, min(rank) as relevant_rank from gold left join told on told.query_id = gold.query_id and told.chunk_id = expected_chunk_id group by all)"""


SERVED = f"""{BLOCKS},
    ask as (select query_id, workspace_id, length(trim(t, ' ' || chr(10))) as size, workspace_id = 3 as lost from q),
    fine as (select *, size % 7 = 0 as down, size % 5 = 0 as garbled from ask where size between 1 and 1000 and not lost),
    inn as (select query_id, count(*) as n, max(case when n = 1 then text end) as text from src where included group by query_id)"""
DOCS16 = "d16 as (select doc_id + 1 as point_id, doc_id % 3 + 1 as workspace_id, text as t from documents)"
PAGES = f"""pg as (select conv_id + 1 as document_id, (turn + 1)::int as page, trim(text, ' ' || chr(10)) as rest, 1200 as lim from conversations),
    {split_cte("piece", "pg", "document_id, page")},
    pp as (select document_id, page, piece, row_number() over (partition by document_id order by page, part) as k from piece),
    pack as (select document_id, k, 1 as no, length(piece) as len from pp where k = 1
             union all select pp.document_id, pp.k, case when pack.len + 2 + length(piece) <= 1200 then no else no + 1 end, case when pack.len + 2 + length(piece) <= 1200 then pack.len + 2 + length(piece) else length(piece) end
             from pack join pp on pp.document_id = pack.document_id and pp.k = pack.k + 1),
    c0 as (select document_id, no - 1 as chunk_index, string_agg(piece, chr(10) || chr(10) order by k) as text, min(page) as page_start, max(page) as page_end, count(*) as pieces from pack join pp using (document_id, k) group by document_id, no),
    c as (select *, length(text) as char_count, chr(10) || page_start || chr(10) || page_end || chr(10) || trim(regexp_replace(text, '[ \\n]+', ' ', 'g')) as ident from c0)"""

ORACLES = {
    "route_files": """
        select doc_id, case doc_id % 7 when 0 then 'markdown' when 1 then 'pdf' when 3 then 'markdown' when 5 then 'pdf' when 6 then 'markdown' end as file_type,
               case doc_id % 7 when 2 then 'UNSUPPORTED_TYPE' when 4 then 'TYPE_CONFLICT' end as error_code from documents""",
    "doc_checksum": f"with {SOURCE} select document_id, octet_length(encode(body)) as file_size_bytes, sha256(body) as checksum from md",
    "md_elements": f"with recursive {ELEMENTS} select document_id, (row_number() over (partition by document_id order by a) - 1)::int as at, text, element_type, path, heading_level::int as heading_level, a::int as line_start, z::int as line_end from el",
    "md_title": "select doc_id + 1 as document_id, source as title from documents",
    "split_text": f"with recursive base as (select doc_id, trim(replace(text, chr(10), ' ')) as rest, 300 as lim from documents), {split_cte('piece', 'base', 'doc_id')} select doc_id, part::int as part_index, piece from piece",
    "md_chunks": f"with recursive {CHUNKS} select document_id, chunk_index::int as chunk_index, text, section, line_start::int as line_start, line_end::int as line_end, part::int as part_index, char_count::int as char_count, array_to_string(list_transform(range(paragraphs), lambda i: 'paragraph'), ',') as kinds from c",
    "md_chunk_ids": f"with recursive {CHUNKS} select id, document_id, chunk_index::int as chunk_index, chunk_id from c",
    "page_chunks": f"with recursive {PAGES} select document_id, chunk_index::int as chunk_index, text, page_start, page_end, char_count::int as char_count, array_to_string(list_transform(range(pieces), lambda i: 'page_text'), ',') as kinds, sha256(ident || chr(10) || 'occurrence:' || (row_number() over (partition by document_id, ident order by chunk_index) - 1)) as chunk_id from c",
    "chunk_stats": f"with recursive {CHUNKS} select (document_id - 1) % 3 + 1 as workspace_id, count(*) as chunks, count(distinct document_id) as documents, sum(char_count)::bigint as chars, max(char_count)::int as longest, min(line_start)::int as first_line, max(line_end)::int as last_line from c group by 1",
    "ingest_status": """
        with p as (select conv_id + 1 as d, turn + 1 as page, (turn + 1) % 5 = 0 or (conv_id + 1) % 11 = 0 as failed, trim(text, ' ' || chr(10)) <> '' as has from conversations),
        g as (select d, string_agg(page::varchar, ', ' order by page) filter (where failed) as bad, bool_or(has and not failed) as ok from p group by d)
        select d as document_id, case when not ok then 'FAILED' when bad is not null then 'PARTIAL' else 'COMPLETED' end as status,
               case when not ok then 'Parsing produced no usable chunks.' when bad is not null then 'Text extraction failed for pages: ' || bad end as error_message, ok as has_chunks from g""",
    "mixed_ingest": r"""
        with t as (select doc_id, doc_id % 4 as kind, doc_id % 25 = 5 as bad, length(regexp_replace(text, '[ \n]', '', 'g')) as n from documents),
        p as (select -(conv_id + 1) as d, turn + 1 as page, (turn + 1) % 5 = 0 as failed, length(regexp_replace(text, '[ \n]', '', 'g')) as n from conversations),
        g as (select d, string_agg(page::varchar, ', ' order by page) filter (where failed) as lost, coalesce(sum(n) filter (where not failed), 0) as n from p group by d)
        select doc_id as document_id, case kind when 1 then 'text' when 3 then 'text' end as file_type, case kind when 0 then 'TYPE_CONFLICT' when 2 then 'UNSUPPORTED_TYPE' end as error_code,
               case when kind in (0, 2) then null when bad or n = 0 then 'FAILED' else 'COMPLETED' end as status,
               case kind when 0 then 'Filename extension and content type identify different file formats.' when 2 then 'Unsupported file type: filename=''c.bin'', content_type=''application/octet-stream'''
                         else case when bad then 'Text file must be valid UTF-8.' when n = 0 then 'Parsing produced no usable chunks.' end end as error_message,
               case when kind in (0, 2) or bad then 0 else n end::int as chars from t
        union all select d, 'pdf', null, case when n = 0 then 'FAILED' when lost is not null then 'PARTIAL' else 'COMPLETED' end,
               case when n = 0 then 'Parsing produced no usable chunks.' when lost is not null then 'Text extraction failed for pages: ' || lost end, n::int from g""",
    "dup_documents": f"with {SOURCE} select sha256(body) as checksum, count(*) as copies, min(document_id) as first from md group by 1 having count(*) > 1",
    "shared_chunk_ids": f"with recursive {CHUNKS} select chunk_id, count(distinct document_id) as documents, min(id) as first from c group by chunk_id having count(distinct document_id) > 1",
    "vector_topk": f"with {VECTOR_HITS} select query_id, workspace_id, point_id, round(score, 6) as score, rank from hit",
    "vector_upsert": """
        with old as (select vec_id + 1 as point_id, label::bigint + 1 as workspace_id, list_sum(embedding::double[]) as total from embeddings),
        come as (select case when point_id % 8 = 0 then point_id else point_id + 1000000 end as point_id, workspace_id, case turn when 2 then -total else 3 * total end as total, turn from old, (values (1), (2)) t(turn) where point_id % 4 = 0),
        new as (select point_id, workspace_id, total from come qualify row_number() over (partition by point_id order by turn desc) = 1)
        select point_id, workspace_id, round(total, 6) as total from (select * from old anti join new using (point_id) union all select * from new)""",
    "hash_embed": f"with {DOCS16}, {embed('v', 'd16', 'point_id', 'passage')}, n as (select point_id, round(sqrt(sum(x * x)), 6) as norm from v group by 1) select point_id, norm, bucket::int as bucket, round(x, 6) as x from v join n using (point_id)",
    "hash_search": f"""with {DOCS16}, ask as (select doc_id as query_id, doc_id % 3 + 1 as workspace_id, text as t from documents where doc_id % 20 = 0),
        {embed("v", "d16", "point_id", "passage")}, {embed("u", "ask", "query_id", "query")},
        s as (select query_id, point_id, sum(u.x * v.x) as score from u join ask using (query_id) join d16 using (workspace_id) join v using (point_id, bucket) group by all)
        select query_id, point_id, row_number() over (partition by query_id order by round(score, 12) desc, point_id)::int as rank, round(score, 6) as score from s qualify rank <= 5""",
    "index_points": f"""with recursive {STORE}, w as (select point_id, sum(x * (bucket + 1)) as weighted from v group by 1)
        select point_id, workspace_id, document_id, chunk_id, chunk_index, section, document_name, source_type, page_start, page_end, round(weighted, 6) as weighted from stored join w on point_id = chunk_db_id""",
    "index_status": f"""with recursive {CHUNKS}, n as (select document_id, count(*) as n from c where document_id % 11 > 0 group by 1)
        select doc_id + 1 as document_id, case when (doc_id + 1) % 13 = 0 then 0 else coalesce(n, 0) end as indexed_chunks,
               case when (doc_id + 1) % 13 = 0 then 'document workspace_id must not be empty' when n is null then 'document must contain at least one chunk' end as message
        from documents left join n on n.document_id = doc_id + 1""",
    "chunk_search": f"""with recursive {hits(5)} select query_id, rank, point_id, round(score, 6) as score, chunk_id, document_name, null::varchar as error_message from hit join stored on chunk_db_id = point_id""",
    "stored_search": f"""with recursive {hits(5)} select query_id, rank, point_id, round(score, 6) as score, chunk_id, document_name, null::varchar as error_message from hit join stored on chunk_db_id = point_id""",
    "repository_upsert": f"""with recursive {STORE}, w as (select point_id, sum(x * (bucket + 1)) as weighted from v group by 1)
        select point_id, case when point_id % 9 = 0 then 9 else workspace_id end as workspace_id, round(case when point_id % 4 = 0 and point_id % 9 > 0 then -weighted else weighted end, 6) as weighted from stored join w on point_id = chunk_db_id""",
    "hydrate": f"with recursive {STORED} select query_id, chunk_db_id, document_id, document_name, section, page_start, page_end, length(text)::int as chars from ctx",
    "enrich_rank": f"with recursive {STORED} select query_id, rank, chunk_db_id, chunk_id, round(score, 6) as score from ctx",
    "missing_hits": f"with recursive {STORED} select query_id, point_id, rank from hit where not exists (select 1 from stored where chunk_db_id = point_id and chunk_db_id % 3 > 0)",
    "context_blocks": f"with recursive {BLOCKS} select query_id, source_id, block, included from src",
    "context_pack": f"with recursive {BLOCKS} select query_id, prompt_context, source_count, omitted_count, length(prompt_context) as character_count from packed",
    "prompts": f"""with recursive {BLOCKS} select query_id, case when prompt_context <> '' then concat_ws(chr(10) || chr(10), 'Question:', 'What is ' || query_id || '?', 'Sources:', trim(prompt_context, ' ' || chr(10)), '{INSTRUCTION}') end as prompt from packed""",
    "llm_parse": f"with recursive {REPLIES} select query_id, text, case when ids is not null then array_to_string(ids, ',') end as cited, refused, error_message from rep",
    "citations": f"with recursive {REPLIES} select query_id, position, source_id, chunk_id, document_id from cit",
    "answers": f"""with recursive {REPLIES},
        st as (select q.query_id, q.query_id // 20 % 7 = 0 as gone, q.query_id // 20 % 9 = 0 as silent, count(hit.point_id) as hits from q left join hit using (query_id) group by all),
        v1 as (select st.*, coalesce(source_count, 0) as n, rep.kind, rep.text, rep.ids, rep.refused, rep.error_message,
                      case when hits = 0 then 'none' when gone then 'lost' when coalesce(source_count, 0) = 0 then 'none' when silent then 'silent' when kind in (3, 4) then 'bad' when kind = 2 or kind = 5 and source_count < 2 then 'unknown' when kind = 1 then 'none' else 'said' end as what
               from st left join packed on packed.query_id = st.query_id left join rep on rep.query_id = st.query_id)
        select query_id, case what when 'none' then '{REFUSAL}' when 'said' then text end as answer, case what when 'none' then true when 'said' then false end as refused,
               case what when 'none' then '' when 'said' then case when kind = 5 then 'SOURCE_1,SOURCE_2' else array_to_string(ids, ',') end end as cited,
               case what when 'lost' then 'DATA_INCONSISTENT' when 'silent' then 'LLM_INVALID' when 'bad' then 'LLM_INVALID' when 'unknown' then 'INVALID_CITATION' end as error_code,
               case what when 'lost' then 'all retrieved chunks are missing from the chunk table' when 'silent' then 'the model returned an invalid response' when 'bad' then error_message
                         when 'unknown' then case when kind = 2 then 'LLM cited unknown sources: SOURCE_99, SOURCE_99' else 'LLM cited unknown sources: SOURCE_2' end end as error_message
        from v1""",
    "served_answers": f"""with recursive {SERVED},
        v1 as (select fine.*, coalesce(inn.n, 0) as n, text, coalesce(inn.n, 0) = 0 as none from fine left join inn using (query_id))
        select query_id, case when none then '{REFUSAL}' when down or garbled then null else trim(regexp_extract(text, '^[^.]*'), ' ' || chr(10)) end as answer, case when none then true when not down and not garbled then false end as refused,
               case when none then '' when down or garbled then null when n > 1 then 'SOURCE_1,SOURCE_2' else 'SOURCE_1' end as cited, case when not none and (down or garbled) then 'LLM_INVALID' end as error_code,
               case when none then null when down then 'the model request failed: OSError' when garbled then 'the model returned an invalid response' end as error_message from v1
        union all select query_id, null, null, null, case when size between 1 and 1000 then 'WORKSPACE_NOT_FOUND' else 'INVALID_INPUT' end,
               case when size between 1 and 1000 then 'Workspace ' || workspace_id || ' does not exist.' else 'question must have 1 to 1000 characters and a positive workspace_id' end from ask where lost or size not between 1 and 1000""",
    "served_citations": f"""with recursive {SERVED} select query_id, (src.n - 1)::int as position, source_id, document_name, section, text as quote from src join fine using (query_id) where included and src.n <= 2 and not down and not garbled""",
    "eval_cases": f"with recursive {GOLDEN} select query_id, expected_chunk_id, relevant_rank from ranked",
    "eval_metrics": f"with recursive {GOLDEN} select count(*) as cases, count(relevant_rank) as recalled, round(avg((relevant_rank is not null)::int), 6) as recall, round(avg(coalesce(1.0::double / relevant_rank, 0)), 6) as mrr from ranked",
    "eval_failures": f"with recursive {GOLDEN} select query_id, expected_chunk_id, (select string_agg(chunk_id, ',' order by rank) from told where told.query_id = ranked.query_id) as retrieved from ranked where relevant_rank is null",
    "public_citations": f"with recursive {REPLIES} select query_id, position, source_id, document_name, source_type, section, page_start, page_end, text as quote from cit",
    "integrity": f"with recursive {CHUNKS} select count(*) as chunks, (count(*) - count(distinct (document_id, chunk_id)))::bigint as repeated_ids, (count(*) - count(distinct id))::bigint as repeated_places, 0::bigint as wrong_lengths, count(*) filter (where char_count > 1200) as too_long from c",
    "reconcile_stores": f"""with recursive {CHUNKS}, n as (select document_id, count(*) as n from c group by 1),
        d as (select document_id, case when document_id % 13 = 0 then 0 when document_id % 17 = 0 then 2 else 1 end as n_documents, coalesce(n, 0) as want from md left join n using (document_id)),
        ch as (select document_id, chunk_index, case when document_id % 7 = 0 and chunk_index = 0 then 0 when document_id % 5 = 0 and chunk_index = 1 then 2 else 1 end as times from c),
        pt as (select document_id, chunk_index, case when document_id % 11 = 0 and chunk_index = 0 then 0 when document_id % 23 = 0 and chunk_index = 0 then 2 else 1 end as times from c),
        cs as (select document_id, sum(times)::bigint as n_chunks, count(*) filter (where times > 0) as ids from ch group by 1),
        ps as (select document_id, sum(times)::bigint as n_points, count(*) filter (where times > 0) as ids from pt group by 1),
        j as (select d.document_id, n_documents, want, coalesce(n_chunks, 0) as n_chunks, coalesce(cs.ids, 0) as c_ids, coalesce(n_points, 0) as n_points, coalesce(ps.ids, 0) as p_ids
              from d left join cs using (document_id) left join ps using (document_id))
        select document_id, n_documents::bigint as n_documents, n_chunks, n_points,
               concat_ws(',', case when n_documents = 0 then 'NO_DOCUMENT' end, case when n_documents > 1 then 'REPEATED_DOCUMENT' end, case when n_documents > 0 and want <> c_ids then 'CHUNK_COUNT' end,
                         case when n_chunks > c_ids then 'REPEATED_CHUNKS' end, case when p_ids < c_ids then 'MISSING_POINTS' end, case when p_ids > c_ids then 'ORPHAN_POINTS' end, case when n_points > p_ids then 'REPEATED_POINTS' end,
                         case when p_ids = c_ids and p_ids > 0 and (document_id % 19 = 0 or document_id % 7 = 0) and not (document_id % 19 > 0 and document_id % 7 = 0 and document_id % 11 = 0) then 'OTHER_POINTS' end) as problems
        from j where n_documents + n_chunks + n_points > 0""",
    "gapless_ids": "select doc_id, sha256(text) as checksum, row_number() over (order by sha256(text), doc_id) as number from documents",
    "eval_file": f"""with recursive {GOLDEN} select row_number() over (order by query_id) as query_id, query_id + 1 as expected_document_id, expected_chunk_id, relevant_rank from ranked""",
    "workspace_check": "select doc_id, doc_id % 8 as workspace_id, case when doc_id % 8 not in (select r_regionkey + 1 from region) then 'WORKSPACE_NOT_FOUND' end as error_code from documents",
    "health": """with p as (select 'documents' as store, count(*) > 0 and count(*) = count(doc_id) as ok from documents union all select 'embeddings', count(*) > 0 and count(*) = count(vec_id) from embeddings
        union all select 'conversations', count(*) > 0 and count(*) = count(conv_id) from conversations) select * from p union all select 'all', bool_and(ok) from p""",
}
ORACLES |= {
    "hydrate_bucketed": ORACLES["hydrate"],
    "sql_text": r"""select doc_id, len(string_split(text, chr(10)))::int as lines, len(string_split(trim(regexp_replace(text, '[ \n]+', ' ', 'g')), ' '))::int as words, length(trim(text, ' ' || chr(10)))::int as chars from documents""",
    "sql_routing": ORACLES["route_files"],
    "sql_split": ORACLES["split_text"],
    "sql_chunk_ids": ORACLES["md_chunk_ids"],
    "sql_blocks": ORACLES["context_blocks"],
    "sql_search": f"""with recursive {hits(5)} select query_id, rank, point_id, round(score, 6) as score from hit""",
}
