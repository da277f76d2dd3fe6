"""Tables bucketed by a key: joins on it move only the other side, and lookups read only the key's buckets."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquery.sources.scratch import fresh_path

#: Buckets of a table; its largest bucket should fit a task.
BUCKETS = 32


class Buckets:
    """A catalogued Parquet table whose files are the buckets of `key`; writing replaces it as a whole."""

    def __init__(self, spark: SparkSession, name: str, key: str, buckets: int = BUCKETS):
        if buckets <= 0:
            raise ValueError("buckets must be positive")
        self.spark, self.name, self.key, self.buckets = spark, name, key, buckets

    @classmethod
    def fresh(cls, spark: SparkSession, name: str, key: str, buckets: int = BUCKETS) -> Buckets:
        """A table under a name that no other has."""
        return cls(spark, f"{name}_{uuid.uuid4().hex}", key, buckets)

    def write(self, rows: DataFrame, path: str | None = None) -> Buckets:
        """rows become the table, a file per bucket, sorted by key, at path or in a new folder of the shared one."""
        dealt = rows.repartition(self.buckets, self.key)
        dealt.write.bucketBy(self.buckets, self.key).sortBy(self.key).mode("overwrite").option("path", path or fresh_path(self.spark, self.name)).format("parquet").saveAsTable(self.name)
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def of(self, keys: Sequence[int]) -> DataFrame:
        """The rows of a few keys, from their buckets alone."""
        return self.read().where(F.col(self.key).isin(list(keys)))
