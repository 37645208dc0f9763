"""Grouping, headings, the index, and lists collected from documentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.exprs import basename, glob, header_title, index_anchor, prefix_group, short_name, truncate_brief

#: Fixed: sections of a page in their order.
SECTIONS = {"function": 0, "struct": 1, "union": 2, "enum": 3, "typedef": 4, "macro": 5, "class": 6, "type_alias": 7, "concept": 8}


def project_stats(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("kind").isin("function", "struct", "union", "enum", "typedef")).groupBy("kind").agg(F.count(F.lit(1)).alias("entities"))


def by_prefix(entities: DataFrame) -> DataFrame:
    """Number of declarations of each name prefix; aliases and concepts aren't grouped."""
    return entities.where(~F.col("kind").isin("type_alias", "concept", "method")).groupBy(prefix_group(F.col("name")).alias("prefix"), "kind").agg(F.count(F.lit(1)).alias("entities"))


def by_header(entities: DataFrame) -> DataFrame:
    return entities.where(F.col("kind").isin(*SECTIONS)).groupBy("module", "kind").agg(F.count(F.lit(1)).alias("entities")).withColumn("title", header_title(F.col("module")))


def by_module(files: DataFrame, modules: list[tuple[str, list[str]]], column: str = "path") -> DataFrame:
    """The first module of the configuration one of whose globs the path or its basename matches; null if none. An expression, no join."""
    out = F.lit(None).cast("string")
    for name, globs in reversed(modules):
        hit = reduce(lambda a, b: a | b, (glob(F.col(column), g) | glob(basename(F.col(column)), g) for g in globs), F.lit(False))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return files.withColumn("assigned", out)


def function_groups(entities: DataFrame) -> DataFrame:
    """Groups (module, group_name) in the order of their first member, with the first heading that is given."""
    g = entities.where("kind = 'function' and doc.group_name is not null")
    return g.groupBy("module", F.col("doc.group_name").alias("group_name")).agg(F.min("ord").alias("first_ord"), F.min_by("doc.group_heading", F.when(F.col("doc.group_heading").isNotNull(), F.col("ord"))).alias("heading"), F.count(F.lit(1)).alias("functions"))


def existence(entities: DataFrame) -> DataFrame:
    """Whether there is anything for each of the extra pages. One row."""
    any_ = lambda c: F.coalesce(F.max(F.size(c) > 0), F.lit(False))
    return entities.agg(any_("doc.todos").alias("has_todos"), any_("doc.bugs").alias("has_bugs"), any_("doc.tests").alias("has_tests"))


def collected(entities: DataFrame, field: str) -> DataFrame:
    """Todos, bugs or tests of functions, classes, methods, structs and macros: file, entity_name, line (0 for methods), pos, text."""
    own = entities.where(F.col("kind").isin("function", "class", "method", "struct", "macro"))
    items = F.transform("doc.tests", lambda t: F.concat(t["name"], F.coalesce(F.concat(F.lit(" ("), t["file"], F.lit(")")), F.lit("")))) if field == "tests" else F.col(f"doc.{field}")
    return own.select(F.col("module").alias("file"), F.col("qualified_name").alias("entity_name"), F.when(F.col("kind") == "method", 0).otherwise(F.col("line")).alias("line"), "ord", F.posexplode(items).alias("pos", "text"))


def headings(rows: DataFrame, columns: list[str], order: list[str], partition: list[str]) -> DataFrame:
    """Where a column's value changes in the order: ``new_<column>``. Windows are kept within ``partition`` so that no task holds all rows."""
    w = Window.partitionBy(*partition).orderBy(*order)
    out = rows
    for n, c in enumerate(columns):
        changed = reduce(lambda a, b: a | b, (~F.col(x).eqNullSafe(F.lag(x).over(w)) for x in columns[: n + 1]))
        out = out.withColumn(f"new_{c}", changed | (F.row_number().over(w) == 1))
    return out


def section_of(rows: DataFrame, column: str, order: list[str], partition: list[str]) -> DataFrame:
    """The last section given before a row; a row without one doesn't end it. ``new_section`` marks a change."""
    before = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(column, ignorenulls=True).over(before)
    return rows.withColumn("open_section", last).withColumn("new_section", F.coalesce(F.col(column) != last, F.col(column).isNotNull()))


def index(entities: DataFrame) -> DataFrame:
    """Rows of the index: functions, classes, public methods, structs, enums, macros, typedefs and concepts.

    ``letter`` is the first byte in upper case; rows are ordered by it and then by name, within a letter by partition."""
    own = entities.where(F.col("kind").isin("function", "class", "struct", "enum", "macro", "typedef", "concept") | ((F.col("kind") == "method") & (F.coalesce(F.col("access"), F.lit("public")) == "public")))
    letter = F.upper(F.substring("_short", 1, 1))
    return own.select(
        "entity_id", "module", "kind", short_name(F.col("qualified_name")).alias("_short"), "qualified_name", truncate_brief(F.col("doc.brief")).alias("brief"), index_anchor(F.col("qualified_name")).alias("anchor")
    ).withColumn("letter", letter).withColumnRenamed("_short", "name")


def index_ordered(rows: DataFrame) -> DataFrame:
    """The index with ``new_letter``; letters are few, so ties with a letter's first name are found by an aggregate, not by one big window."""
    first = rows.groupBy("letter").agg(F.min(F.struct("qualified_name", "entity_id")).alias("_f"))
    return rows.join(first, "letter").withColumn("new_letter", F.struct("qualified_name", "entity_id") == F.col("_f")).drop("_f")


def merge_diagnostics(lint: DataFrame, coverage: DataFrame) -> DataFrame:
    """All rows of the linter, and those of coverage that no row of it equals in (file, line, message)."""
    return lint.unionByName(coverage.join(lint.select("file", "line", "message"), ["file", "line", "message"], "left_anti").select(*lint.columns))
