"""Batches of rows through Python, with whole numbers kept exact."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exact(batches: Iterator[pd.DataFrame], cut: Callable, key: str) -> Iterator[pd.DataFrame]:
    ids = lambda x: pd.array([None if v is None else int(v) for v in x], "Int64")
    return cut(batch.assign(**{key: ids(batch[key])}) for batch in batches)


def map_rows(rows: DataFrame, cut: Callable, schema: str, key: str = "doc_id") -> DataFrame:
    """mapInPandas with the long column `key` as nullable integers: with nulls, pandas would make it floats of 53 bits."""
    return rows.withColumn(key, F.col(key).cast("string")).mapInPandas(functools.partial(_exact, cut=cut, key=key), schema)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside hands Python so many rows at a time; for rows that are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
