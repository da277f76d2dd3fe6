"""Spelling variants: each word's commoner near word, and where a chain of them ends.

Two words are near if one insertion, deletion or replacement of a code point
turns one into the other. Half of a word then stands unchanged in the other,
at the same end. So every word is indexed under the starts and ends that may
be half of a near word (two lengths each), and asked for under its own first
and second half: blocks of halves hold an FM-index of their words and search
it for their patterns, both bounded by letters (see fm_index.py). A half that
outgrows a block has indexes of its own, each of a part of its words, and its
patterns are asked of all of them. A pair that shares both halves is found by
its first.

No pairs leave a task: a block gives, for each pattern, how many near words it
has there and the best of them.

Words are compared as they are. Null words and null texts are left out; a
table that repeats a word counts its rows together. Empty words have no
halves; they are near to words of one letter and are left out too, as are
words without a positive n. Tables without words give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.llm.fm_index import BidirectionalIndex
from docquery.llm.storage import written

#: Letters of a block's index; share of them beyond which a half is split off.
BLOCK_LETTERS, SPLIT = 1 << 18, 4
#: How many times commoner a form is than its variant.
RATIO = 2
#: Of the query: a run of letters; every so many runs lose a letter; letters and occurrences that a word has at least.
RUN, SPOILT, LEAST_LETTERS, LEAST_COUNT = r"[A-Za-zÀ-ÿ]+", 97, 5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOUND = "word string, n_near long, form string, form_n long"


def _halves(asked: bool) -> Column:
    """(kind, key) of a word: of its own halves, or of all starts and ends that are half of a word with one letter less or more."""
    size = F.char_length("word")
    steps = (0,) if asked else (-1, 0, 1)
    first = F.array_distinct(F.array(*[F.floor((size + d) / 2).cast("int") for d in steps]))
    last = F.array_distinct(F.array(*[F.ceil((size + d) / 2).cast("int") for d in steps]))
    key = lambda kind, part: F.struct(F.lit(kind).alias("kind"), F.xxhash64(part).alias("key"))
    starts = F.transform(first, lambda n: key("start", F.substr("word", F.lit(1), n)))
    ends = F.transform(last, lambda n: key("end", F.right("word", n)))
    return F.concat(starts, ends)


def _rows(words: list[str], near: np.ndarray, forms: list[str], n: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"word": pd.Series(words, dtype=object), "n_near": near, "form": pd.Series(forms, dtype=object), "form_n": n})


def _block(key: tuple, index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Count and best of the near words that each pattern of a block has in its index."""
    held = dict(zip(index["word"], index["n"], strict=True))
    words, patterns = sorted(held), sorted(set(asked["pattern"]))
    if not words or not patterns:
        return _rows([], np.zeros(0, np.int64), [], np.zeros(0, np.int64))
    n, ends = np.array([held[w] for w in words], np.int64), key[0] == "end"
    sizes = np.array([len(p) for p in patterns])
    exact = sizes - sizes // 2 if ends else sizes // 2
    turn = (lambda x: [w[::-1] for w in x]) if ends else list
    q, w = BidirectionalIndex(turn(words)).one_error(turn(patterns), exact)
    if ends:
        other = [not words[b].startswith(patterns[a][: len(patterns[a]) // 2]) for a, b in zip(q.tolist(), w.tolist(), strict=True)]
        q, w = q[other], w[other]
    order = np.lexsort((w, -n[w], q))
    q, w = q[order], w[order]
    own, first, count = np.unique(q, return_index=True, return_counts=True)
    best = w[first]
    return _rows([patterns[i] for i in own], count, [words[i] for i in best], n[best])


def near_words(words: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """word, n_near, form, form_n of the words (word, n, distinct) that have near words; form is the near word of largest n, the first in code-point order of equals."""
    letters = words.agg(F.coalesce(F.sum(F.char_length("word") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * letters // block_letters))
    keyed = lambda asked: words.select("word", "n", F.explode(_halves(asked)).alias("half")).select("word", "n", "half.*")
    index = keyed(False)
    heavy = index.groupBy("kind", "key").agg(F.sum(F.char_length("word") + 1).alias("letters")).where(F.col("letters") * SPLIT > block_letters)
    heavy = written(heavy.select("kind", "key", F.ceil(F.col("letters") * SPLIT / block_letters).cast("int").alias("parts")), "spelling-heavy")
    placed = lambda rows: rows.join(heavy, ["kind", "key"], "left").withColumn("block", F.when(F.col("parts").isNull(), F.pmod("key", F.lit(blocks))).otherwise(F.col("key")))
    group = ["kind", "block", "split", "part"]
    split = F.col("parts").isNotNull().alias("split")
    held = placed(index).select("kind", "block", split, F.coalesce(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"), F.lit(0)).alias("part"), "word", "n")
    asked = placed(keyed(True)).select("kind", "block", split, F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.col("word").alias("pattern"))
    found = held.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(_block, FOUND)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "best.form", (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form), which must have no cycles: each round doubles the steps that a row has gone."""
    held = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not held.where("moved").isEmpty():
        step = held.select(F.col("word").alias("root"), F.col("root").alias("further"))
        held = written(held.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
    return held.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of words (word, n)."""
    counted = words.where("word <> '' and n > 0").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    counted = written(counted, "spelling-words")
    near = near_words(counted, block_letters).withColumnRenamed("form", "near").withColumnRenamed("form_n", "near_n")
    common = F.col("near_n") >= F.col("n") * ratio
    rows = counted.join(near, "word", "left").select("word", F.when(common, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("near_n")).alias("form_n"))
    rows = written(rows, "spelling-forms")
    last = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spoilt_words(docs: DataFrame) -> DataFrame:
    """word, n of the lower-cased runs of letters of all texts, some of which lose a letter; a null doc_id counts as an empty one."""
    run = F.explode(F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(RUN), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    h = F.crc32(F.encode(F.concat("id", F.lit(":"), "run"), "UTF-8"))
    at = F.pmod("h", F.char_length("run")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.pmod("h", F.lit(SPOILT)) == 0, less).otherwise(F.col("run"))
    words = runs.withColumn("h", h).select(word.alias("word")).where(F.char_length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spoilt_words(spark.read.parquet(f"{sf_dir}/documents.parquet")))
