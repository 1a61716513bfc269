"""Several tables published together: each version in a folder of its own, seen once a pointer to it is renamed into place."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from civilake.session import file_system


class Conflict(RuntimeError):
    """Another writer has published since the version that this one began with."""


def _names(spark: SparkSession, path: str) -> list[str]:
    files, folder = file_system(spark, path)
    return sorted(x.getPath().getName() for x in files.listStatus(folder)) if files.exists(folder) else []


def current(spark: SparkSession, root: str) -> int:
    """The number of the newest version, 0 if there is none."""
    return max((int(name) for name in _names(spark, f"{root}/_versions") if name.isdigit()), default=0)


def folder_of(spark: SparkSession, root: str, version: int | None = None) -> str:
    """The folder of a version, by default the newest: that which its pointer holds the name of."""
    number = current(spark, root) if version is None else version
    held = _names(spark, f"{root}/_versions/{number:012d}")
    if not held:
        raise FileNotFoundError(f"no version {number} under {root}")
    return f"{root}/{held[0]}"


def read(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table as one version has it. A reader that wants several tables of one version asks for its number first."""
    return spark.read.parquet(f"{folder_of(spark, root, version)}/{table}")


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], base: int | None = None) -> int:
    """Write all tables, then publish them as the version after ``base`` (by default the newest), and return its number.

    Until the last step readers see the old version, whatever fails. That step
    is one rename of the pointer, a folder named by the number, which fails if it is there already: of
    two writers that begin with the same version one publishes, the other raises Conflict and
    leaves nothing that is seen.
    """
    base = current(spark, root) if base is None else base
    name = f"v-{uuid.uuid4().hex}"
    for table, rows in tables.items():
        rows.write.parquet(f"{root}/{name}/{table}")
    taken = current(spark, root)
    if taken != base:
        raise Conflict(f"version {taken} was published since {base}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files, mark = file_system(spark, f"{root}/_versions/_next-{name}/{name}")
    files.mkdirs(mark)
    pointer = jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/{base + 1:012d}")
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE  # a pointer that is there is never replaced
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(mark.getParent(), pointer, options)
    except Py4JJavaError as e:
        files.delete(mark.getParent(), True)
        if current(spark, root) == base:
            raise
        raise Conflict(f"version {base + 1} was published at the same time") from e
    return base + 1


def drop_old(spark: SparkSession, root: str, keep: int) -> None:
    """Remove all but the newest ``keep`` versions, and what unfinished writers have left: run it while nobody writes."""
    newest = current(spark, root)
    kept = {folder_of(spark, root, v).rpartition("/")[2] for v in range(max(1, newest - keep + 1), newest + 1)}
    files, _ = file_system(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for v in _names(spark, f"{root}/_versions"):
        if not v.isdigit() or int(v) <= newest - keep:
            files.delete(path(f"{root}/_versions/{v}"), True)
    for name in _names(spark, root):
        if name.startswith("v-") and name not in kept:
            files.delete(path(f"{root}/{name}"), True)
