"""Shared-folder staging: cut lineage with written tables that every executor can read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

_LOCAL: list[str] = []
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (``local[...]``, as in tests)
    gets a folder of its own; a cluster session raises ValueError, since no
    folder of one machine would be seen by the others. The path is qualified, so
    that a name without a scheme means the same file system in every process.
    """
    found = spark.conf.get(SETTING, None)
    if found:
        return qualified(spark, found.rstrip("/"))
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="civilake-"))
    return _LOCAL[0]


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and authority that Hadoop gives it on the driver: without a scheme, those of the default file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return "file://" + whole.removeprefix("file:") if whole.startswith("file:/") and not whole.startswith("file://") else whole


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before; the innermost open ``scratch`` removes it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder, if it is there."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, on leaving, every table staged inside: write what is to stay before that, to a path of its own."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def staged(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write the rows once as Parquet in the shared folder and return them as read back.

    Later jobs start from these files, so a lost executor costs no recomputation
    of what came before, and row numbers taken before the write stay the same.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str) -> DataFrame:
    """As ``staged``, dealt by a column into as many buckets as the session has shuffle partitions, so that grouping by it needs no shuffle.

    The table's name is needed only while it is written and is dropped at once; the files stay in the shared folder.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).format("parquet").saveAsTable(table)
    found = spark.table(table).select(df.columns)
    spark.sql(f"DROP TABLE {table}")
    return found
