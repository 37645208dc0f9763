"""Session settings, the shared scratch folder and the splitting of hot keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of a table's rows; so there are fewer than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 64
#: Number of parts into which the rows of a hot key are dealt.
SALTS = 16


def session(app: str = "marginalia", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster's own settings win where they exist."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


#: Setting with the folder for intermediate tables where ``spark.checkpoint.dir`` isn't set.
SHARED = "marginalia.shared.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, else that of ``marginalia.shared.dir``, else the one given to ``setCheckpointDir``.

    If none is set, a local session (tests) gets a folder of its own; on a cluster this is an error, since no folder of one machine will do."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SHARED, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set spark.checkpoint.dir or {SHARED} to a folder that all machines of the cluster share")
        folder = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set(SHARED, folder)
    return folder.rstrip("/")


#: Paths given out by ``scratch`` and not yet cleared.
_PATHS: list[str] = []


def hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of a path and the path as its own object."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder. It is deleted by ``clear``, or when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = hadoop(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    _PATHS.append(path)
    return path


def clear(spark: SparkSession, since: int = 0) -> int:
    """Delete the intermediate tables of this process, or those beyond the first ``since``. Results that were not written elsewhere can't be read afterwards."""
    n = 0
    while len(_PATHS) > since:
        fs, at = hadoop(spark, _PATHS.pop())
        n += bool(fs.delete(at, True))
    return n


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """``with cleared(spark): query(spark, folder).write…`` – what was made for the result is deleted when it has been written."""
    since = len(_PATHS)
    try:
        yield
    finally:
        clear(spark, since)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name) + "/table"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    for file in table.inputFiles()[:1]:
        path = next((p for p in _PATHS if f"{p.split('://')[-1]}/" in file), None)
        if path:
            fs, at = hadoop(table.sparkSession, path)
            fs.delete(at, True)
            _PATHS.remove(path)


def hot_keys(df: DataFrame, keys: list[str], share: float = HOT_SHARE) -> DataFrame:
    """The keys that hold more than ``share`` of all rows: fewer than 1 / share rows, whatever the size of ``df``.

    Counts are combined before the shuffle, so that a hot key costs one row a task. Null keys count as a key."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(F.lit(1)))  # one number, a scalar subquery
    return counts.where(F.col("_n") > total.scalar() * share).select(*keys)


def broadcast_if_small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, which is counted first and no further; else as it is, so that a join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salt_left(df: DataFrame, keys: list[str], hot: DataFrame, spread: list[str], salts: int = SALTS) -> DataFrame:
    """Add ``_salt``: rows of a hot key get one of ``salts`` values by the hash of ``spread``, all others 0."""
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*spread), F.lit(salts))).otherwise(F.lit(0))
    return marked.withColumn("_salt", salt.cast("int")).drop("_hot")


def salt_right(df: DataFrame, keys: list[str], hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """Add ``_salt``: rows of a hot key are repeated once for each of ``salts`` values, all others have 0."""
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    values = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return marked.withColumn("_salt", F.explode(values)).drop("_hot")
