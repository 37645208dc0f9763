"""Excerpts of other files in documentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.exprs import language, snippet
from marginalia.runtime import hot_keys, salt_left, salt_right
from marginalia.sources.files import MAX_INCLUDE

#: Fixed: folders that are searched, in this order.
FOLDERS = ("", "examples/", "test/examples/", "test/fixtures/", "test/fixtures/examples/")
#: Fixed: what stands for an include that can't be resolved.
ERROR = "<!-- Include error: {} -->"
_INCLUDE = r"\{\{#include\s+([^}\s]+)\s*\}\}"


def resolve(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (ref_id, file, anchor, language) with the path and text of the excerpt: the first folder that has the file."""
    tried = refs.select("ref_id", "file", "anchor", "language", F.posexplode(F.array(*[F.lit(f) for f in FOLDERS])).alias("_n", "_f")).withColumn("path", F.concat("_f", "file"))
    hit = tried.join(files.select("path", "content"), "path")
    # Only the rank and the path are compared; the content follows the winner.
    best = hit.groupBy("ref_id").agg(F.min(F.struct("_n", "path")).alias("_b")).select("ref_id", F.col("_b.path").alias("path"))
    found = refs.join(best, "ref_id", "left").join(files.select("path", "content"), "path", "left")
    text = snippet(F.col("path"), F.col("content"), F.col("anchor"))
    status = F.when(F.col("path").isNull(), "File not found").when(text.isNull(), "Anchor not found in file").otherwise("ok")
    return found.select("ref_id", "path", text.alias("text"), F.coalesce("language", language(F.col("file"))).alias("language"), status.alias("status"))


def expand_includes(texts: DataFrame, files: DataFrame, max_bytes: int = MAX_INCLUDE) -> DataFrame:
    """Texts (text_id, text) with each include directive replaced once by the file or the part of it between its anchors.

    Files above ``max_bytes`` aren't read: such a directive is an error like one whose file isn't there. The pieces are
    exploded; only directives are joined, each distinct one once, and the pieces put together in order."""
    pieces = texts.select("text_id", F.posexplode(F.split(F.regexp_replace("text", _INCLUDE, "\x01$1\x01"), "\x01")).alias("pos", "_p"))
    asked = pieces.where("pos % 2 = 1")
    wanted = asked.select("_p").distinct().withColumn("_a", F.when(F.contains(F.col("_p"), F.lit(":")), F.regexp_extract("_p", r":([^:]*)$", 1))).withColumn("path", F.regexp_replace("_p", r":[^:]*$", ""))
    met = wanted.join(files.where(F.octet_length("content") <= max_bytes).select("path", "content"), "path", "left")
    start, end = F.concat(F.lit("ANCHOR: "), F.col("_a")), F.concat(F.lit("ANCHOR_END: "), F.col("_a"))
    a, b = F.instr(F.col("content"), start), F.instr(F.col("content"), end)
    inner = F.when((a > 0) & (b > a), F.regexp_replace(F.substr("content", a + F.length(start), b - a - F.length(start)), r"^[^\n]*\n|\n[^\n]*$", ""))
    body = F.when(F.col("_a").isNull(), F.col("content")).otherwise(inner)
    text = F.coalesce(body, F.concat(F.lit(ERROR.split("{}")[0]), F.col("path"), F.lit(ERROR.split("{}")[1])))
    found = met.select("_p", text.alias("t"))
    hot = hot_keys(asked, ["_p"])
    put = salt_left(asked, ["_p"], hot, ["text_id", "pos"]).join(salt_right(found, ["_p"], hot), ["_p", "_salt"], "left")
    parts = pieces.where("pos % 2 = 0").select("text_id", "pos", F.col("_p").alias("t")).unionByName(put.select("text_id", "pos", "t"))
    return parts.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("text"))


def expand_sources(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Sources (path, content, …) with the include directives in their comments expanded, to be parsed afterwards. Files without one aren't touched."""
    has = F.coalesce(F.col("content").rlike(_INCLUDE), F.lit(False))
    done = expand_includes(sources.where(has).select(F.col("path").alias("text_id"), F.col("content").alias("text")), files)
    rest = [c for c in sources.columns if c != "content"]
    return sources.where(~has).unionByName(sources.where(has).select(*rest).join(done.select(F.col("text_id").alias("path"), F.col("text").alias("content")), "path").select(*sources.columns))
