"""Session defaults shared by the tests, the benchmark and the entry point."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library expects anywhere: UTC and AQE."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("civilake")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []


def work_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used before, in the folder that ``spark.checkpoint.dir`` names.

    Where that is unset, a session on one machine gets a temporary folder; a
    cluster session raises ValueError, since its machines share none.
    """
    folder = (spark.conf.get("spark.checkpoint.dir", None) or "").rstrip("/")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="civilake-"))
        folder = _LOCAL[0]
    return f"{folder}/{name}-{uuid.uuid4().hex}"


#: Rows that a task is given by ``spread``.
ROWS_A_TASK = 1 << 18


def spread(rows: DataFrame, *keys: str, of: DataFrame | None = None) -> DataFrame:
    """``rows`` dealt by keys to a task for every ROWS_A_TASK rows of ``of``, a table that is quick to count, and to no fewer than the session's shuffles have.

    Adaptive execution joins small partitions by their bytes; this holds where a row costs much more work or memory than its bytes tell.
    """
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    n = max(n, -(-of.count() // ROWS_A_TASK)) if of is not None else n
    return rows.repartition(n + 1, *keys)  # Spark leaves out a repartition equal to the shuffle below it, which adaptive execution then joins


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows written as Parquet and read back: later jobs start from the files."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path itself, for what DataFrames cannot do: delete, rename, look."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    files, found = file_system(spark, path)
    return files.exists(found)
