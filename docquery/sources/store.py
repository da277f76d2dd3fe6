"""Versioned Parquet tables of one store: versions are written whole and then named together as the current ones."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from docquery.operators.vectors import latest
from docquery.sources.scratch import claim, exists

#: Shared by all workspaces; times that a table may have.
LOG, CREATED, UPDATED = "versions", "created_at", "updated_at"


class Conflict(RuntimeError):
    """Another writer has committed since the commit that was read."""


class Store:
    """Tables below `root`. A commit is one small file, numbered one above the last; it names the folders of every table's workspaces.

    A table's rows lie in a folder per commit and workspace, so that an upsert
    rewrites the workspaces it touches and no others. Of two writers that read
    the same commit the second fails with Conflict, since the number after it is
    taken, and has to run again; what it read is never committed over what the
    first wrote.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def state(self) -> tuple[int, dict[str, dict[int, str]]]:
        """Number of the last commit (0: none) and, by table and workspace, the folder of the rows."""
        if not exists(self.spark, f"{self.root}/{LOG}"):
            return 0, {}
        row = self.spark.read.schema("n long, tables string").json(f"{self.root}/{LOG}/*").orderBy(F.desc("n")).first()
        return (row.n, {t: {int(w): path for w, path in parts.items()} for t, parts in json.loads(row.tables).items()}) if row else (0, {})

    def mark(self, name: str, n: int | None = None) -> int:
        """What the last commit, or commit n, notes under a name; -1 for nothing."""
        return self._marks(self.state()[0] if n is None else n).get(name, -1)

    def _marks(self, n: int) -> dict[str, int]:
        row = self.spark.read.schema("n long, marks string").json(f"{self.root}/{LOG}/{n:012d}.json").first() if n else None
        return json.loads(row.marks or "{}") if row else {}

    def commit(self, changes: dict[str, DataFrame], replace: bool = False, base: tuple[int, dict] | None = None, marks: dict[str, int] | None = None) -> None:
        """The rows of changes become the rows of the workspaces that they hold, in all tables at once; replace: of all workspaces.

        base is the state() that the changes were made from; without it, the
        present one. marks are numbers noted in the same commit, by name.
        """
        n, tables = base or self.state()
        tables, noted = dict(tables), self._marks(n) | (marks or {})
        for name, rows in changes.items():
            version = f"{name}/{uuid.uuid4().hex}"
            rows.withColumn("part", F.coalesce("workspace_id", F.lit(-1))).write.partitionBy("part").parquet(f"{self.root}/{version}")
            held = self.spark.read.parquet(f"{self.root}/{version}") if self._parts(version) else None
            parts = {} if held is None else {r.part: f"{version}/part={r.part}" for r in held.select(F.col("part").cast("long")).distinct().collect()}
            tables[name] = parts if replace else tables.get(name, {}) | parts
        if not claim(self.spark, f"{self.root}/{LOG}/{n + 1:012d}.json", json.dumps({"n": n + 1, "tables": json.dumps(tables), "marks": json.dumps(noted)})):
            raise Conflict(f"commit {n + 1} is taken")

    def _parts(self, version: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{version}/part=*")
        return len(place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place)) > 0


class Table:
    """A table of a store; readers see what was committed last."""

    def __init__(self, store: Store, name: str, schema: str):
        self.store, self.name, self.schema = store, name, _parse_datatype_string(schema)

    def read(self, workspaces: list[int] | None = None, base: tuple[int, dict] | None = None) -> DataFrame:
        """All rows, or those of some workspaces, as of the last commit or of base."""
        parts = (base or self.store.state())[1].get(self.name, {})
        paths = [f"{self.store.root}/{path}" for w, path in sorted(parts.items()) if workspaces is None or w in workspaces]
        spark = self.store.spark
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def publish(self, rows: DataFrame) -> None:
        """rows become the table; a failure before the end leaves the old version in place."""
        self.store.commit({self.name: rows.select(self.schema.names)}, replace=True)

    def merged(self, rows: DataFrame, key: str, base: tuple[int, dict], order: str | None = None) -> DataFrame:
        """The touched workspaces' rows of base with those of equal keys replaced, by the last of the rows that share one (see latest); a replaced row keeps its created_at, and rows get the time of now."""
        rows = latest(rows, key, order)
        touched = [-1 if r[0] is None else r[0] for r in rows.select("workspace_id").distinct().collect()]
        old = self.read(touched, base)
        for name in (CREATED, UPDATED):
            if name in self.schema.names:
                rows = rows.drop(name).withColumn(name, F.current_timestamp())
        if CREATED in self.schema.names:
            rows = rows.join(old.select(key, F.col(CREATED).alias("first time")), key, "left").withColumn(CREATED, F.coalesce("first time", CREATED)).drop("first time")
        return old.join(rows.select(key), key, "left_anti").unionByName(rows.select(old.columns))

    def upsert(self, rows: DataFrame, key: str, order: str | None = None) -> None:
        """rows replace those with equal keys, the last by `order` of those that share one; without rows nothing happens."""
        upsert_together([(self, rows, key)], order)


def upsert_together(changes: list[tuple[Table, DataFrame, str]], order: str | None = None, marks: dict[str, int] | None = None, store: Store | None = None) -> None:
    """Upserts into several tables of one store that readers see all at once or not at all, with the marks noted in the same commit."""
    stores = [store] if store else []
    stores += [table.store for table, _, _ in changes]
    if len({s.root for s in stores}) > 1:
        raise ValueError("tables of several stores have no commit in common")
    if stores:
        base = stores[0].state()  # read once: what is merged is what the commit follows
        held = [(table, rows, key) for table, rows, key in changes if not rows.isEmpty()]
        if held or marks:
            stores[0].commit({table.name: table.merged(rows, key, base, order) for table, rows, key in held}, base=base, marks=marks)
