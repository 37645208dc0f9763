"""Markdown pages from parsed declarations: a text for each declaration, put together by page in order.

A page holds what one file declares, so collecting by page is bounded by a file's size. Pages that list a whole
project (index, todos) are split by letter or file and come as one row for each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.exprs import anchor, class_simple_name, header_title, html_escape, namespace_hidden, stem
from marginalia.operators import grouping
from marginalia.runtime import hadoop

#: Fixed: sections of a module page and their headings.
HEADINGS = {"function": "Functions", "struct": "Structs", "union": "Unions", "enum": "Enums", "typedef": "Typedefs", "macro": "Macros", "class": "Classes", "type_alias": "Type Aliases", "concept": "Concepts"}


def _present(value: Column, *around: Column | str) -> Column:
    """Text with ``value`` in it, or nothing if it is null or empty."""
    parts = [F.lit(a) if isinstance(a, str) else a for a in around]
    return F.when(value.isNotNull() & (value != ""), F.concat(*parts)).otherwise(F.lit(""))


def _list(items: Column, title: str, line) -> Column:
    return F.when(F.size(items) > 0, F.concat(F.lit(f"**{title}**\n\n"), F.array_join(F.transform(items, line), "\n"), F.lit("\n\n"))).otherwise(F.lit(""))


def template_signature(tparams: Column) -> Column:
    """``template <typename T, int N = 3>``, or nothing."""
    one = lambda p: F.concat(F.coalesce(p["kind"], F.lit("")), F.lit(" "), p["name"], F.when(p["default_value"].isNotNull(), F.concat(F.lit(" = "), p["default_value"])).otherwise(F.lit("")))
    return F.when(F.size(tparams) > 0, F.concat(F.lit("template <"), F.array_join(F.transform(tparams, one), ", "), F.lit(">\n"))).otherwise(F.lit(""))


def attribute_list(attributes: Column) -> Column:
    one = lambda a: F.concat(a["name"], F.when(a["argument"].isNotNull(), F.concat(F.lit("("), a["argument"], F.lit(")"))).otherwise(F.lit("")))
    return F.when(F.size(attributes) > 0, F.concat(F.lit("[["), F.array_join(F.transform(attributes, one), ", "), F.lit("]] "))).otherwise(F.lit(""))


def synopsis() -> Column:
    """The declaration as it is shown; ``@synopsis`` wins."""
    beside = lambda t: F.when(t.rlike("[*&]$"), t).otherwise(F.concat(t, F.lit(" ")))
    args = F.array_join(F.transform("params", lambda p: F.when(p["name"] != "", F.concat(beside(p["type_str"]), p["name"])).otherwise(p["type_str"])), ", ")
    shown = F.when(F.col("kind").isin("function", "method"), F.concat(F.coalesce(beside(F.col("return_type")), F.lit("")), F.col("name"), F.lit("("), args, F.lit(")")))
    shown = shown.when(F.col("kind") == "macro", F.concat(F.lit("#define "), F.col("name"), F.when(F.size("params") > 0, F.concat(F.lit("("), F.array_join(F.transform("params", lambda p: p["name"]), ", "), F.lit(")"))).otherwise(F.lit("")), F.coalesce(F.concat(F.lit(" "), "body"), F.lit(""))))
    shown = shown.when(F.col("kind") == "typedef", F.concat(F.lit("typedef "), F.coalesce("underlying", F.lit("")), F.lit(" "), F.col("name")))
    shown = shown.when(F.col("kind") == "type_alias", F.concat(F.lit("using "), F.col("name"), F.lit(" = "), F.coalesce("underlying", F.lit(""))))
    shown = shown.when(F.col("kind") == "concept", F.concat(F.lit("concept "), F.col("name"), F.lit(" = "), F.coalesce("constraint_text", F.lit(""))))
    shown = shown.otherwise(F.concat("kind", F.lit(" "), "qualified_name"))
    return F.coalesce(F.col("doc.synopsis"), F.concat(template_signature(F.col("tparams")), attribute_list(F.col("attributes")), shown))


def hidden(names: list[str], patterns: list[str] | None = None) -> Column:
    """Not shown: excluded by tag, in a hidden namespace, or by pattern; aliases and concepts by tag only."""
    from marginalia.functions.exprs import glob_any

    tagged = F.coalesce(F.col("doc.exclude") == "full", F.lit(False))
    return tagged | (~F.col("kind").isin("type_alias", "concept") & (namespace_hidden(F.col("qualified_name"), names) | glob_any(F.col("name"), patterns or [])))


def doc_text() -> Column:
    """The text of a declaration's documentation."""
    d = F.col("doc")
    typed = F.map_from_entries(F.transform(F.array_distinct(F.transform("params", lambda p: p["name"])), lambda n: F.struct(n.alias("key"), F.filter("params", lambda p: p["name"] == n)[0]["type_str"].alias("value"))))
    table = F.when(F.size(d["params"]) > 0, F.concat(F.lit("**Parameters**\n\n| Name | Type | Description |\n|---|---|---|\n"), F.array_join(F.transform(d["params"], lambda p: F.concat(F.lit("| `"), p["name"], F.lit("` | "), F.coalesce(F.concat(F.lit("`"), F.replace(typed[p["name"]], F.lit("|"), F.lit("\\|")), F.lit("`")), F.lit("")), F.lit(" | "), F.replace(p["description"], F.lit("|"), F.lit("\\|")), F.lit(" |"))), "\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    bullet = lambda x: F.concat(F.lit("- "), x)
    return F.concat(
        _present(d["deprecated"], "> **Deprecated:** ", d["deprecated"], "\n\n"), _present(d["brief"], html_escape(d["brief"]), "\n\n"), _present(d["details"], html_escape(d["details"]), "\n\n"), table,
        _list(d["tparams"], "Template parameters", lambda p: F.concat(F.lit("- `"), p["name"], F.lit("`: "), p["description"])), _present(d["returns"], "**Returns:** ", d["returns"], "\n\n"),
        _list(d["retvals"], "Return values", lambda p: F.concat(F.lit("- `"), p["value"], F.lit("`: "), p["description"])), _list(d["exceptions"], "Throws", lambda p: F.concat(F.lit("- `"), p["type"], F.lit("`: "), p["description"])),
        _list(d["preconditions"], "Preconditions", bullet), _list(d["postconditions"], "Postconditions", bullet), _list(d["notes"], "Notes", bullet), _list(d["warnings"], "Warnings", bullet), _list(d["attentions"], "Attention", bullet),
        _list(d["remarks"], "Remarks", bullet), _list(d["invariants"], "Invariants", bullet), _list(d["see_also"], "See also", lambda x: F.concat(F.lit("- `"), x, F.lit("`"))),
        F.array_join(F.transform(d["code_blocks"], lambda c: F.concat(F.lit("```"), F.coalesce(c["language"], F.lit("cpp")), F.lit("\n"), c["code"], F.lit("\n```\n\n"))), ""),
        F.array_join(F.transform(d["diagrams"], lambda c: F.concat(F.lit("```mermaid\n"), c["content"], F.lit("\n```\n\n"))), ""),
        _present(d["since"], "*Since ", d["since"], "*\n\n"), _present(d["author"], "*Author: ", d["author"], "*\n\n"), _present(d["copyright"], "*", d["copyright"], "*\n\n"),
    )


def _members(parsed: DataFrame) -> DataFrame:
    """entity_id and ``_fields``: the visible members of classes, structs and unions as a list."""
    own = parsed.where((F.col("kind") == "field") & (F.coalesce(F.col("access"), F.lit("public")) != "private"))
    line = F.concat(F.lit("- `"), F.coalesce(F.concat("underlying", F.lit(" ")), F.lit("")), "name", F.lit("`"), F.coalesce(F.concat(F.lit(" — "), "doc.brief"), F.lit("")), F.lit("\n"))
    return own.groupBy(F.col("parent_id").alias("entity_id")).agg(F.concat(F.lit("**Members**\n\n"), _joined(F.struct("ord", line.alias("md"))), F.lit("\n")).alias("_fields"))


def _derived(parsed: DataFrame) -> DataFrame:
    """entity_id and ``_derived``: the lines of a class's diagram for the classes that have it as a base, matched by simple name within the project."""
    classes = parsed.where("kind in ('class', 'struct')")
    below = classes.select(F.col("name").alias("_child"), F.explode("bases").alias("_b")).select("_child", class_simple_name(F.col("_b.name")).alias("_k")).distinct()
    hit = classes.select("entity_id", "name", class_simple_name(F.col("name")).alias("_k")).join(below, "_k")
    line = F.concat(F.lit("    "), "name", F.lit(" <|-- "), "_child", F.lit("\n"))
    return hit.groupBy("entity_id").agg(_joined(F.struct("_child", line.alias("md"))).alias("_derived"))


def declaration_text(parsed: DataFrame, hide: list[str] = ("detail", "internal", "impl"), patterns: list[str] | None = None) -> DataFrame:
    """entity_id, parent_id, module, kind, ord and ``md`` of every declaration that is shown."""
    own = parsed.where(~F.col("kind").isin("include", "field", "variable", "friend") & ~hidden(list(hide), patterns) & (F.coalesce(F.col("access"), F.lit("public")) != "private"))
    level = F.when(F.col("kind") == "method", "#### ").otherwise("### ")
    own = own.join(_members(parsed), "entity_id", "left").join(_derived(parsed), "entity_id", "left")
    values = F.when(F.col("kind") == "enum", _list(F.col("enum_values"), "Values", lambda v: F.concat(F.lit("- `"), v["name"], F.lit("`"), F.coalesce(F.concat(F.lit(" = "), v["text"]), F.lit(""))))).otherwise(F.lit(""))
    above = F.array_join(F.transform("bases", lambda b: F.concat(F.lit("    "), class_simple_name(b["name"]), F.lit(" <|-- "), F.col("name"), F.lit("\n"))), "")
    bases = F.when((F.size("bases") > 0) | F.col("_derived").isNotNull(), F.concat(F.lit("```mermaid\nclassDiagram\n"), above, F.coalesce("_derived", F.lit("")), F.lit("```\n\n"))).otherwise(F.lit(""))
    text = F.concat(level, F.col("name"), F.lit(" {#"), anchor(F.col("qualified_name")), F.lit("}\n\n```cpp\n"), synopsis(), F.lit("\n```\n\n"), bases, F.coalesce(doc_text(), F.lit("")), values, F.coalesce("_fields", F.lit("")))
    return own.select("entity_id", "parent_id", "module", "kind", "name", "qualified_name", "ord", "doc", text.alias("md"))


def _joined(order: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["md"]), "")


def group_text(parsed: DataFrame) -> DataFrame:
    """The compact form of groups of functions: entity_id of the first function, and ``_group``, its heading with the synopses of all and the documentation of the first."""
    own = parsed.where("kind = 'function' and doc.group_name is not null").select("entity_id", "module", "ord", F.col("doc.group_name").alias("_g"), F.col("doc.group_heading").alias("_h"), synopsis().alias("_s"), doc_text().alias("_d"))
    by = own.groupBy("module", "_g").agg(
        F.min_by("entity_id", "ord").alias("entity_id"), F.min_by("_d", "ord").alias("_d"), F.min_by("_h", F.when(F.col("_h").isNotNull(), F.col("ord"))).alias("_h"), _joined(F.struct("ord", F.concat("_s", F.lit("\n")).alias("md"))).alias("_all"),
    )
    return by.select("entity_id", F.concat(F.lit("### "), F.coalesce("_h", "_g"), F.lit("\n\n```cpp\n"), F.col("_all"), F.lit("```\n\n"), F.coalesce("_d", F.lit(""))).alias("_group"))


def grouped_text(parsed: DataFrame, **options) -> DataFrame:
    """``declaration_text`` with each group of functions in its compact form, at the place of its first function."""
    texts = declaration_text(parsed, **options)
    member = (F.col("kind") == "function") & F.col("doc.group_name").isNotNull()
    put = texts.where(member).join(group_text(parsed), "entity_id").withColumn("md", F.col("_group")).drop("_group")
    return texts.where(~F.coalesce(member, F.lit(False))).unionByName(put)


def with_links(pages: DataFrame, symbols: DataFrame) -> DataFrame:
    """Pages (path, content) with the inline references of their texts as links."""
    from marginalia.operators.links import rewrite

    return rewrite(pages.select(F.col("path").alias("text_id"), F.col("content").alias("text")), symbols).select(F.col("text_id").alias("path"), F.col("text").alias("content"))


def readme(parsed: DataFrame, title: str = "API Reference") -> DataFrame:
    """One page with a line for each folder of modules: how many files and declarations it holds."""
    folder = F.when(F.contains("module", F.lit("/")), F.regexp_replace("module", "/[^/]*$", "")).otherwise(F.lit("."))
    by = parsed.where(F.col("kind").isin(*HEADINGS)).groupBy(folder.alias("folder")).agg(F.countDistinct("module").alias("_m"), F.count(F.lit(1)).alias("_n"))
    line = F.concat(F.lit("- "), "folder", F.lit(": "), F.col("_n").cast("string"), F.lit(" declarations in "), F.col("_m").cast("string"), F.lit(" files\n"))
    return by.agg(_joined(F.struct("folder", line.alias("md"))).alias("_md")).select(F.lit("README.md").alias("path"), F.concat(F.lit(f"# {title}\n\n"), F.coalesce("_md", F.lit(""))).alias("content"))


def module_summary(parsed: DataFrame) -> DataFrame:
    """path and content of a page for each file that lists its declarations with their briefs."""
    own = parsed.where(F.col("kind").isin(*HEADINGS))
    line = F.concat(F.lit("- "), "kind", F.lit(" [`"), "name", F.lit("`](#"), anchor(F.col("qualified_name")), F.lit(")"), F.coalesce(F.concat(F.lit(" — "), "doc.brief"), F.lit("")), F.lit("\n"))
    by = own.groupBy("module").agg(_joined(F.struct("ord", line.alias("md"))).alias("_md"))
    return by.select(F.concat(F.lit("SUMMARY/"), F.replace(F.regexp_replace("module", r"\.[^./]*$", ""), F.lit("/"), F.lit("_")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), header_title(F.col("module")), F.lit("\n\n"), F.col("_md")).alias("content"))


def module_pages(parsed: DataFrame, **options) -> DataFrame:
    """path and content of a page for each file: sections in their order, methods below their class."""
    texts = grouped_text(parsed, **options)
    below = texts.where("kind = 'method'").groupBy(F.col("parent_id").alias("entity_id")).agg(_joined(F.struct("ord", "md")).alias("_below"))
    top = texts.where("kind != 'method'").join(below, "entity_id", "left").select("module", "kind", "ord", F.concat("md", F.coalesce("_below", F.lit(""))).alias("md"))
    rank = F.create_map(*[F.lit(x) for kv in grouping.SECTIONS.items() for x in kv])[F.col("kind")]
    heading = F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv])[F.col("kind")]
    sections = top.where(F.col("kind").isin(*HEADINGS)).groupBy("module", "kind").agg(_joined(F.struct("ord", "md")).alias("_md")).select("module", rank.alias("r"), F.concat(F.lit("## "), heading, F.lit("\n\n"), F.col("_md")).alias("md"))
    pages = sections.groupBy("module").agg(_joined(F.struct("r", "md")).alias("_md"))
    return pages.select(F.concat(F.lit("headers/"), F.replace(F.regexp_replace("module", r"\.[^./]*$", ""), F.lit("/"), F.lit("_")), F.lit(".md")).alias("path"), F.concat(F.lit("# "), header_title(F.col("module")), F.lit("\n\n"), F.col("_md")).alias("content"))


def index_page(parsed: DataFrame) -> DataFrame:
    """The index, a part for each letter: path and content."""
    rows = grouping.index(parsed)
    line = F.concat(F.lit("- [`"), F.col("qualified_name"), F.lit("`](#"), F.col("anchor"), F.lit(")"), F.coalesce(F.concat(F.lit(" — "), "brief"), F.lit("")), F.lit("\n"))
    parts = rows.groupBy("letter", stem(F.col("module")).alias("_stem")).agg(_joined(F.struct("qualified_name", "entity_id", line.alias("md"))).alias("_md"))
    return parts.select(F.concat(F.lit("INDEX/"), F.col("letter"), F.lit("/"), F.col("_stem"), F.lit(".md")).alias("path"), F.concat(F.lit("## "), F.col("letter"), F.lit("\n\n"), F.col("_md")).alias("content"))


def list_pages(parsed: DataFrame) -> DataFrame:
    """Todos, bugs and tests of each file, with a heading for each declaration."""
    out = None
    for field, title in (("todos", "TODO"), ("bugs", "BUGS"), ("tests", "TESTS")):
        rows = grouping.headings(grouping.collected(parsed, field), ["entity_name"], ["ord", "pos"], ["file"])
        md = F.concat(F.when(F.col("new_entity_name"), F.concat(F.lit("### "), F.col("entity_name"), F.lit("\n\n"))).otherwise(F.lit("")), F.lit("- "), F.col("text"), F.lit("\n"))
        pages = rows.groupBy("file").agg(_joined(F.struct("ord", "pos", md.alias("md"))).alias("_md")).select(F.concat(F.lit(f"{title}/"), stem(F.col("file")), F.lit(".md")).alias("path"), F.concat(F.lit(f"# {title}\n\n## "), F.col("file"), F.lit("\n\n"), F.col("_md")).alias("content"))
        out = pages if out is None else out.unionByName(pages)
    return out


def includes_pages(includes: DataFrame) -> DataFrame:
    """What each file includes."""
    line = F.concat(F.lit("- "), F.when(F.col("is_system"), F.concat(F.lit("<"), "path", F.lit(">"))).otherwise(F.concat(F.lit('"'), "path", F.lit('"'))), F.lit("\n"))
    return includes.groupBy("module").agg(_joined(F.struct("line", line.alias("md"))).alias("_md")).select(F.concat(F.lit("INCLUDES/"), stem(F.col("module")), F.lit(".md")).alias("path"), F.concat(F.lit("# Includes of "), F.col("module"), F.lit("\n\n"), F.col("_md")).alias("content"))


def introduction(parsed: DataFrame, title: str = "API Reference") -> DataFrame:
    """One page with the counts of the project."""
    stats = grouping.project_stats(parsed)
    line = F.concat(F.lit("- "), "kind", F.lit(": "), F.col("entities").cast("string"), F.lit("\n"))
    return stats.agg(_joined(F.struct("kind", line.alias("md"))).alias("_md")).select(F.lit("introduction.md").alias("path"), F.concat(F.lit(f"# {title}\n\n"), F.coalesce("_md", F.lit(""))).alias("content"))


def summary(pages: DataFrame) -> DataFrame:
    """The lines of the table of contents, a row for each folder; of a folder's pages the names only are collected."""
    line = F.concat(F.lit("  - ["), stem(F.col("path")), F.lit("]("), F.col("path"), F.lit(")\n"))
    folder = F.substring_index("path", "/", 1)
    return pages.select("path").groupBy(folder.alias("folder")).agg(_joined(F.struct("path", line.alias("md"))).alias("content"))


def custom_pages(pages: DataFrame) -> DataFrame:
    """Pages of documentation; a main page replaces the introduction."""
    p = pages.select("id", F.coalesce("title", "id").alias("title"), "content", F.coalesce("is_mainpage", F.lit(False)).alias("main")).distinct()
    return p.select(F.when(F.col("main"), F.lit("introduction.md")).otherwise(F.concat(F.lit("pages/"), F.col("id"), F.lit(".md"))).alias("path"), F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce("content", F.lit(""))).alias("content"))


def book_toml(title: str = "API Reference", language: str = "en", authors: list[str] | None = None) -> str:
    names = ", ".join(f'"{a}"' for a in authors or [])
    return f'[book]\ntitle = "{title}"\nlanguage = "{language}"\nauthors = [{names}]\nsrc = "src"\n'


def write_book(pages: DataFrame, folder: str, toml: str | None = None) -> None:
    """Each row (path, content) as a file below ``folder``, which all machines must reach: a URI of any Hadoop file system.

    The rows go through a table in the folder, whose files the driver's file system then writes out one row at a time; a path given
    twice is written once, with the least content."""
    spark = pages.sparkSession
    once = pages.groupBy("path").agg(F.min("content").alias("content"))

    def put(name: str, text: str) -> None:
        fs, at = hadoop(spark, f"{folder}/{name}")
        out = fs.create(at, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()

    put("book.toml", toml or book_toml())
    for row in once.toLocalIterator(prefetchPartitions=True):  # one partition at a time, never the whole book
        put(f"src/{row['path']}", row["content"])
