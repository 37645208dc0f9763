"""Documentation coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.exprs import glob_any, has_docs, is_void, percentage

#: Fixed: kinds that count; methods count as functions.
KINDS = ("function", "method", "class", "struct", "enum", "typedef", "type_alias", "concept")


def counted(entities: DataFrame, exclude: list[str] | None = None) -> DataFrame:
    out = entities.where(F.col("kind").isin(*KINDS) & (F.coalesce(F.col("access"), F.lit("public")) != "private"))
    return out.where(~glob_any(F.col("name"), exclude)) if exclude else out


def by_kind(entities: DataFrame, missing: DataFrame | None = None) -> DataFrame:
    """Total, documented and percentage of each kind and, with kind null, of all.

    With ``missing`` (rows of ``missing_items``) also how many parameters and returns documented declarations leave out."""
    kind = lambda c: F.when(F.col(c) == "method", F.lit("function")).otherwise(F.col(c))
    own = counted(entities).select("entity_id", kind("kind").alias("kind"), has_docs(F.col("doc")).alias("_d"))
    total, documented = F.count(F.lit(1)), F.count_if("_d")
    out = own.rollup("kind").agg(total.alias("total"), documented.alias("documented")).withColumn("percentage", F.round(percentage(F.col("documented"), F.col("total")), 6))
    if missing is None:
        return out
    lost = missing.select(kind("entity_type").alias("kind"), "issue").rollup("kind").agg(F.count_if(F.startswith("issue", F.lit("missing @param"))).alias("_p"), F.count_if(F.col("issue") == "missing @return").alias("_r"))
    joined = out.join(lost, out["kind"].eqNullSafe(lost["kind"]), "left").select(*(out[c] for c in out.columns), F.coalesce("_p", F.lit(0)).alias("missing_params"), F.coalesce("_r", F.lit(0)).alias("missing_returns"))
    return joined


def summary_line(coverage: DataFrame) -> DataFrame:
    """The total as one line of text."""
    return coverage.where("kind is null").select(F.format_string("Documentation coverage: %.1f%% (%d/%d)", "percentage", "documented", "total").alias("text"))


def missing_items(entities: DataFrame, params=None, doc_params=None, tparams=None, doc_tparams=None) -> DataFrame:
    """What is missing: documentation, or in documented functions a parameter, template parameter or return."""
    own = counted(entities).withColumn("_d", has_docs(F.col("doc")))
    place = [F.col("module").alias("file"), F.col("qualified_name").alias("entity_name"), F.col("kind").alias("entity_type")]
    line = F.when(F.col("kind").isin("type_alias", "concept"), 0).otherwise(F.col("line")).alias("line")
    callable_ = F.col("kind").isin("function", "method") & ~F.coalesce(F.col("method_kind"), F.lit("")).isin("constructor", "destructor", "copy_constructor", "move_constructor")
    no_return = callable_ & ~F.coalesce(is_void(F.col("return_type")), F.lit(True)) & F.col("doc.returns").isNull()
    issue = F.when(~F.col("_d"), "no documentation").when(no_return, "missing @return")
    out = own.select(*place, issue.alias("issue"), line).where("issue is not null")
    for tag, declared, told, kinds in (("param", params, doc_params, ("function", "method")), ("tparam", tparams, doc_tparams, ("function", "class"))):
        if declared is not None and told is not None:
            lost = declared.where("name != ''").select("entity_id", F.col("name").alias("_n")).join(told.select("entity_id", F.col("name").alias("_n")), ["entity_id", "_n"], "left_anti")
            out = out.unionByName(own.where(F.col("_d") & F.col("kind").isin(*kinds)).join(lost, "entity_id").select(*place, F.concat(F.lit(f"missing @{tag} for '"), F.col("_n"), F.lit("'")).alias("issue"), line))
    return out


def report_lines(items: DataFrame, tool: str = "marginalia") -> DataFrame:
    """Compiler-style text lines."""
    severity = F.when(F.col("issue") == "no documentation", "warning").otherwise("note")
    at = F.when(F.col("line") > 0, F.col("line")).otherwise(F.lit(1))
    return items.select(F.concat(F.col("file"), F.lit(":"), at.cast("string"), F.lit(":1: "), severity, F.lit(": "), F.col("issue"), F.lit(" '"), F.col("entity_name"), F.lit("' ("), F.col("entity_type"), F.lit(")")).alias("text"))


def report_json(coverage: DataFrame) -> DataFrame:
    """The total as JSON text."""
    return coverage.where("kind is null").select(F.to_json(F.struct(F.struct(F.round("percentage", 1).alias("percentage"), "documented", "total").alias("coverage"))).alias("json"))


def report_human(coverage: DataFrame) -> DataFrame:
    """A line for each kind."""
    return coverage.select(F.format_string("%-12s %5.1f%% (%d/%d)", F.coalesce("kind", F.lit("total")), "percentage", "documented", "total").alias("text"))
