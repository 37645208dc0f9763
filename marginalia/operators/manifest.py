"""Change detection between two manifests of files, and what has to be rebuilt."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.exprs import content_hash
from marginalia.operators.graph import closure
from marginalia.runtime import hadoop

MANIFEST = "path string, hash string, mtime decimal(38,0), size bigint"


def manifest(files: DataFrame) -> DataFrame:
    """path, hash, mtime and size of files (path, content, mtime)."""
    return files.select("path", content_hash(F.col("content")).alias("hash"), F.col("mtime").cast("decimal(38,0)").alias("mtime"), F.octet_length("content").cast("bigint").alias("size"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Status of every path: deleted, new_file, unchanged or modified. Equal time and size spare the comparison of hashes."""
    o = old.select("path", F.col("hash").alias("_h"), F.col("mtime").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_old"))
    n = new.select("path", "hash", "mtime", "size", F.lit(True).alias("_new"))
    both = o.join(n, "path", "full_outer")
    same = ((F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s"))) | (F.col("hash") == F.col("_h"))
    status = F.when(F.col("_old").isNull(), "new_file").when(F.col("_new").isNull(), "deleted").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("modified")
    return both.select("path", status.alias("status"))


def with_dependencies(status: DataFrame, edges: DataFrame) -> DataFrame:
    """A file is modified too if one that it needs directly (edges: path -> needs) is modified or deleted."""
    bad = status.where("status in ('modified', 'deleted')").select(F.col("path").alias("needs"))
    hit = edges.select("path", "needs").distinct().join(bad, "needs", "left_semi").select("path").distinct().withColumn("_hit", F.lit(True))
    return status.join(hit, "path", "left").select("path", F.when((F.col("status") == "unchanged") & F.col("_hit"), "modified").otherwise(F.col("status")).alias("status"))


def changed(status: DataFrame) -> DataFrame:
    return status.where("status != 'unchanged'")


def needs_rebuild(old: DataFrame, new: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs whose hash differs, that are new, or whose output (path) isn't there."""
    o = old.select("path", F.col("hash").alias("_h"))
    out = outputs.select("path", F.lit(True).alias("_out")).distinct()
    joined = new.select("path", "hash").join(o, "path", "left").join(out, "path", "left")
    return joined.where(F.col("_h").isNull() | (F.col("hash") != F.col("_h")) | F.col("_out").isNull()).select("path")


def rebuild_set(status: DataFrame, edges: DataFrame) -> DataFrame:
    """The changed files that still exist and all that need them, directly or not, each once."""
    seeds = changed(status).select(F.col("path").alias("name"))
    above = closure(edges.select(F.col("needs").alias("src"), F.col("path").alias("dst")), None, seeds).select(F.col("reached").alias("path"))
    there = status.where("status != 'deleted'").select("path")
    return seeds.select(F.col("name").alias("path")).union(above).distinct().join(there, "path", "left_semi")


def normalized(path):
    """A path without ``.``, ``..`` and empty components, as a column; ``..`` beyond the top stays."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    up = lambda acc: (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
    out = F.aggregate(parts, empty, lambda acc, p: F.when((p == "..") & F.coalesce(F.when(F.size(acc) > 0, up(acc)), F.lit(False)), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.when(F.startswith(path, F.lit("/")), "/").otherwise(""), F.array_join(out, "/"))


def dependencies(includes: DataFrame, files: DataFrame) -> DataFrame:
    """Edges path -> needs from include lines. A local include is sought beside the file that has it; what isn't there is no edge.

    Joined by the whole path, so that each include line meets one file at most."""
    folder = F.when(F.contains("module", F.lit("/")), F.regexp_replace("module", "[^/]*$", "")).otherwise("")
    local = includes.where("not is_system").select(F.col("module").alias("path"), normalized(F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(folder, "path"))).alias("_at")).distinct()
    there = files.select(F.col("path").alias("needs"), normalized(F.col("path")).alias("_at")).distinct()
    return local.join(there, "_at").where("path != needs").select("path", "needs").distinct()


def save(current: DataFrame, folder: str) -> str:
    """Write a manifest as a new version below ``folder``: ``version=n``, n being one more than the last complete one. Earlier versions stay readable."""
    spark = current.sparkSession
    n = max(versions(spark, folder), default=0) + 1
    at = f"{folder}/version={n}"
    current.write.mode("overwrite").parquet(at)
    return at


def versions(spark, folder: str) -> list[int]:
    """The versions that were written to their end."""
    fs, at = hadoop(spark, folder)
    names = [x.getPath() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith("version=") and fs.exists(hadoop(spark, f"{p}/_SUCCESS")[1]))


def load(spark, folder: str) -> DataFrame:
    """The last version of a stored manifest; an empty one if there is none."""
    known = versions(spark, folder)
    return spark.read.schema(MANIFEST).parquet(f"{folder}/version={known[-1]}") if known else spark.createDataFrame([], MANIFEST)


def replace(stored: DataFrame, entries: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """A manifest with ``entries`` in the place of those of the same path, and without the paths of ``gone``."""
    kept = stored.join(entries.select("path"), "path", "left_anti").unionByName(entries.select(*stored.columns))
    return kept if gone is None else kept.join(gone.select("path"), "path", "left_anti")


def upsert(old_edges: DataFrame, new_edges: DataFrame) -> DataFrame:
    """The edges of every path that has new ones are replaced."""
    return old_edges.join(new_edges.select("path").distinct(), "path", "left_anti").unionByName(new_edges)
