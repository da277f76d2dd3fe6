"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Paths and schemas of the tables that once() has written.
_KEPT: dict[tuple, tuple[str, StructType]] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a fresh folder of this machine if it runs Spark alone, and else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Whether this writer is the one that gives path its text: the file appears whole, or is another's already."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    place, draft = hadoop.Path(path), hadoop.Path(f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft)
    out.write(text.encode())
    out.close()
    try:
        if files.getUri().getScheme() == "file":  # a rename on a local disk replaces what is there
            local = lambda x: spark._jvm.java.io.File(x.toUri().getPath()).toPath()
            spark._jvm.java.nio.file.Files.createLink(local(place), local(draft))
        else:
            none = spark._gateway.new_array(hadoop.Options.Rename, 0)
            hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, place, none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        files.delete(draft, False)
    return True


def file_state(rows: DataFrame) -> int:
    """A hash of the paths and modification times of the files that rows are read from."""
    files = rows.select("_metadata.file_path", "_metadata.file_modification_time").distinct()
    return files.agg(F.coalesce(F.bit_xor(F.xxhash64("file_path", "file_modification_time")), F.lit(0))).first()[0]


def _write(df: DataFrame, name: str) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write as Parquet in the shared folder and read it again.

    The table survives lost executors, and its readers prune its columns. The
    cluster clears the folder; a lazy result may still read the table, so it
    is not deleted here.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_write(df, name))


def once(spark: SparkSession, name: str, state: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives, written at its first use in this application and read again from then on.

    state stands for what it is made from: in another state, or where the folder
    has been cleared, it is made anew.
    """
    key = (spark.sparkContext.applicationId, shared_folder(spark), name, *state)
    if key not in _KEPT or not exists(spark, f"{_KEPT[key][0]}/_SUCCESS"):
        df = make()
        _KEPT[key] = _write(df, name), df.schema
    path, schema = _KEPT[key]
    return spark.read.schema(schema).parquet(path)
