"""Files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.exprs import HEADERS, glob, is_cpp

#: Fixed: limits in bytes of source files, included files, JSON input and configuration.
MAX_SOURCE, MAX_INCLUDE, MAX_JSON, MAX_CONFIG = 10 << 20, 1 << 20, 100 << 20, 1 << 20


def read_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True, max_bytes: int = MAX_SOURCE) -> DataFrame:
    """path, content, size, is_cpp of the files below ``folder`` whose basename matches.

    The name filter is the reader's own and the size is its metadata column, so that what isn't wanted isn't read;
    larger files are left out. Bytes that are no UTF-8 become U+FFFD."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(folder).where(F.col("length") <= max_bytes)
    path = F.regexp_replace("path", "^file:", "")
    return files.select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("size"), is_cpp(path).alias("is_cpp"), F.unix_micros("modificationTime").cast("decimal(38,0)").alias("mtime"))


def read_headers(spark: SparkSession, folder: str, **options) -> DataFrame:
    """Header files only."""
    return read_files(spark, folder, pattern="*.{h,hpp,hxx,hh,H}", **options).where(F.col("path").rlike(HEADERS))


def expand(files: DataFrame, patterns: list[str]) -> DataFrame:
    """The files whose path matches one of the patterns; ``**/x`` matches x against the basename at any depth."""
    hit = F.lit(False)
    for p in patterns:
        if "**" in p:
            root, _, name = p.partition("**")
            hit = hit | (F.col("path").startswith(root) & glob(F.substring_index("path", "/", -1), name.lstrip("/") or "*"))
        elif any(c in p for c in "*?["):
            folder, _, name = p.rpartition("/")
            own = F.substring(F.col("path"), 1, len(folder) + bool(folder)) == (folder + "/" if folder else "")
            rest = F.substr("path", F.lit(len(folder) + bool(folder) + 1))
            hit = hit | (own & ~F.contains(rest, F.lit("/")) & glob(rest, name))
        else:
            hit = hit | (F.col("path") == p)
    return files.where(hit)
