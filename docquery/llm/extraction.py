"""Main text of web pages: what a site repeats on many pages goes, and what is furniture by its markup.

Pages become blocks of text and hashed element subtrees (see html.py), once.
Spark counts each subtree's pages per host; a subtree on LEAST_PAGES distinct
pages and SHARE of the host's distinct pages is part of the site's template, and
the blocks within it are deleted. Pages of a host with the same blocks and
subtrees count as one, so that copies of a page make no template. Counts are
per host and subtree, so that a host that holds a third of all pages is
counted by many tasks. Of what is left, the blocks stay that are the article's
by structure: within article or main where a page marks them, and in no menu,
header, footer, sidebar, notice, advert, form, script or comment section.

Paragraphs, headings, lists and tables directly in a marked article, and what
holds over half of an article's text, are never taken for a template: passages
that many articles share stay.

Null and empty html give an empty text. A null url, or one without host, has no
site: its page is judged by structure alone. Rows that repeat a page_id are
pages of their own, and so are equal rows. Other columns are not read; an empty
table gives no rows. Pages have no bound but the memory of one page.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquery.llm.batches import batches_of
from docquery.llm.html import page_of
from docquery.llm.storage import written
from docquery.llm.url_filters import host_of

#: Distinct pages, and share of a host's distinct pages, from which a subtree is its site's; pages that Python gets at once.
LEAST_PAGES, SHARE, BATCH = 4, 0.3, 256
#: Bytes of html after which a batch of results is handed on.
TOGETHER = 8 << 20
READ = "row long, page_id long, url string, host string, blocks array<string>, own array<boolean>, hashes array<long>, firsts array<int>, ends array<int>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(x) for x in (pa.string(), pa.bool_(), pa.int64(), pa.int32(), pa.int32())]
    for batch in batches:
        sources, begin = batch.column("html"), 0
        while begin < batch.num_rows:
            pages, size = [], 0
            while begin + len(pages) < batch.num_rows and size < TOGETHER:
                source = sources[begin + len(pages)].as_py()
                pages.append(page_of(source))
                size += len(source or "")
            columns = [[p.blocks for p in pages], [p.own for p in pages], *([[s[i] for s in p.subtrees] for p in pages] for i in range(3))]
            kept = batch.slice(begin, len(pages))
            arrays = [kept.column(n) for n in ("row", "page_id", "url", "host")] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "page_id", "url", "host", "blocks", "own", "hashes", "firsts", "ends"])
            begin += len(pages)


def parsed_pages(pages: DataFrame) -> DataFrame:
    """row (a number of its own), page_id, url, host, blocks and subtrees of every page, written."""
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", host_of("url").alias("host"), "html")
    with batches_of(pages.sparkSession, BATCH):
        return written(rows.mapInArrow(_read, READ), "page-blocks")


def templates(read: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """host, hash of the subtrees that many pages of a host have."""
    sites = read.where("host <> ''").select("host", F.xxhash64("blocks", "hashes").alias("content"), F.array_distinct("hashes").alias("hashes"))
    distinct = sites.groupBy("host", "content").agg(F.first("hashes").alias("hashes"))
    pages = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    counts = distinct.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return counts.join(pages, "host").where(F.col("n") >= share * F.col("pages")).select("host", "hash")


def template_spans(read: DataFrame, found: DataFrame) -> DataFrame:
    """row, gone: the outermost runs of blocks of each page that lie in its site's template."""
    subtrees = read.where("host <> ''").select("row", "host", F.explode(F.arrays_zip("hashes", "firsts", "ends")).alias("s")).select("row", "host", F.col("s.hashes").alias("hash"), F.col("s.firsts").alias("first"), F.col("s.ends").alias("end"))
    hit = subtrees.join(found, ["host", "hash"]).select("row", "first", "end").distinct()
    before = Window.partitionBy("row").orderBy("first", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = hit.withColumn("upto", F.max("end").over(before)).where("upto is null or end > upto")
    return outer.groupBy("row").agg(F.collect_list(F.struct("first", "end")).alias("gone"))


def extracted(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_site_blocks of every page: its main text, all its blocks, and those that its site's template takes."""
    read = parsed_pages(pages)
    gone = written(template_spans(read, templates(read, least_pages, share)), "page-templates")
    rows = read.select("row", "page_id", "url", F.arrays_zip("blocks", "own").alias("blocks")).join(gone, "row", "left")
    taken = lambda i: F.exists(F.coalesce("gone", F.array()), lambda g: (i >= g["first"]) & (i < g["end"]))
    kept = F.filter(F.filter("blocks", lambda _, i: ~taken(i)), lambda b: b["own"])
    size = lambda c: F.size(c).cast("long")
    text = F.array_join(F.transform(kept, lambda b: b["blocks"]), "\n")
    site = F.coalesce(F.aggregate("gone", F.lit(0), lambda n, g: n + g["end"] - g["first"]), F.lit(0)).cast("long")
    out = rows.select("page_id", "url", text.alias("text"), size("blocks").alias("n_blocks"), site.alias("n_site_blocks"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_site_blocks")


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
