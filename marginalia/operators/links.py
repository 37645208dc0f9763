"""Links from types and references to their targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.exprs import anchor, base_type, external_url, is_anchor_id, stem
from marginalia.runtime import hot_keys, salt_left, salt_right

#: Fixed: where names of the standard library are documented; ``$$`` stands for the rest of the name.
EXTERNAL = (("std::", "https://en.cppreference.com/w/cpp/$$"),)


def external_links(names: DataFrame, prefixes: list[tuple[str, str]] | tuple = EXTERNAL, column: str = "name") -> DataFrame:
    """The address of each name by the first prefix in the list that it begins with. The list is configuration: an expression, no join."""
    name, out = F.col(column), F.lit(None).cast("string")
    for prefix, template in reversed(list(prefixes)):
        out = F.when(name.startswith(prefix), external_url(F.lit(template), F.substr(name, F.lit(len(prefix) + 1)))).otherwise(out)
    return names.withColumn("url", out)


def symbol_link(kind: Column, source_file: Column, name: Column) -> Column:
    """``../types/<stem>.md#anchor`` and the like."""
    folder = F.when(kind.isin("function", "method"), "functions").when(kind == "macro", "macros").otherwise("types")
    return F.concat(F.lit("../"), folder, F.lit("/"), stem(source_file), F.lit(".md#"), anchor(name))


def type_links(types: DataFrame, symbols: DataFrame, column: str = "type_str") -> DataFrame:
    """The link of a type: its bare name in the symbol table, else an external address."""
    bare = types.withColumn("_base", base_type(F.col(column)))
    hit = bare.join(symbols.select(F.col("lookup_key").alias("_base"), F.col("kind").alias("_k"), "source_file", F.col("name").alias("_n")), "_base", "left")
    own = F.when(F.col("_n").isNotNull(), symbol_link(F.col("_k"), F.col("source_file"), F.col("_n")))
    return external_links(hit, column="_base").withColumn("link", F.coalesce(own, F.col("url"))).drop("url", "_k", "source_file", "_n").withColumnRenamed("_base", "base_type")


def resolve(refs: DataFrame, symbols: DataFrame, pages: DataFrame) -> DataFrame:
    """How a target (module, target) resolves: symbol, else a page of its module, else a well-formed anchor, else unresolved."""
    s = symbols.select(F.col("lookup_key").alias("target"), F.col("anchor").alias("_anchor"), F.lit(True).alias("_symbol"))
    p = pages.select("module", F.col("id").alias("target"), F.lit(True).alias("_page")).distinct()
    out = refs.join(s, "target", "left").join(p, ["module", "target"], "left")
    how = F.when(F.col("_symbol"), "symbol").when(F.col("_page"), "page").when(is_anchor_id(F.col("target")), "anchor").otherwise("unresolved")
    link = F.when(F.col("_symbol"), F.concat(F.lit("#"), F.col("_anchor"))).when(F.col("_page"), F.concat(F.col("target"), F.lit(".md"))).when(is_anchor_id(F.col("target")), F.concat(F.lit("#"), F.col("target")))
    return out.select(*refs.columns, how.alias("resolved_as"), link.alias("link"))


def param_types(params: DataFrame, doc_params: DataFrame) -> DataFrame:
    """Documented parameters with the type of the first parameter of that name; null if there is none."""
    typed = params.groupBy("entity_id", "name").agg(F.min_by("type_str", "pos").alias("type_str"))
    return doc_params.join(typed, ["entity_id", "name"], "left").select("entity_id", "pos", "name", "type_str", "description")


def rewrite(texts: DataFrame, symbols: DataFrame) -> DataFrame:
    """Texts (text_id, text) with every ``@ref target`` as a link, or in backticks if it has none.

    The pieces of a text are exploded, joined by equality with the symbol table, and put together in their order."""
    pattern = r'[@\\]ref\s+([^\s,;\]"]*[^\s,.;\]"])(?:\s+"([^"]*)")?'
    marked = F.split(F.regexp_replace("text", pattern, "\x01$1\x02$2\x01"), "\x01")
    pieces = texts.select("text_id", F.posexplode(marked).alias("pos", "_p"))
    # Plain text joins nothing and doesn't travel by a key; targets meet the table once each.
    asked = pieces.where("pos % 2 = 1").withColumn("_t", F.substring_index("_p", "\x02", 1))
    known = asked.select("_t").distinct().join(symbols.select(F.col("lookup_key").alias("_t"), F.col("anchor").alias("_a")), "_t")
    hot = hot_keys(asked, ["_t"])
    met = salt_left(asked, ["_t"], hot, ["text_id", "pos"]).join(salt_right(known, ["_t"], hot), ["_t", "_salt"], "left")
    shown = F.coalesce(F.nullif(F.substring_index("_p", "\x02", -1), F.lit("")), F.col("_t"))
    link = F.when(F.col("_a").isNotNull(), F.concat(F.lit("["), shown, F.lit("](#"), F.col("_a"), F.lit(")"))).otherwise(F.concat(F.lit("`"), shown, F.lit("`")))
    parts = pieces.where("pos % 2 = 0").select("text_id", "pos", F.col("_p").alias("t")).unionByName(met.select("text_id", "pos", link.alias("t")))
    return parts.groupBy("text_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("text"))
