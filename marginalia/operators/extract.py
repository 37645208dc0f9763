"""Source text to tables of declarations.

``nodes`` parses each file once and gives a row for each declaration with its nested lists; the functions below it
flatten these into one table for each kind of child. Parsing needs no shuffle: files are independent.
Null and empty content gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from marginalia.functions import cdecl, doccomment
from marginalia.functions.clex import tokens
from marginalia.functions.exprs import HEADERS, is_cpp

NODES = (
    "entity_id string, parent_id string, module string, kind string, name string, qualified_name string, namespace string, access string, method_kind string, operator_symbol string, return_type string, "
    "underlying string, constraint_text string, body string, requires_clause string, flags map<string,boolean>, line int, col_no int, ord int, depth int, "
    f"doc {doccomment.DOC}, params array<struct<name: string, type_str: string, default_value: string>>, tparams array<struct<name: string, kind: string, is_variadic: boolean, default_value: string>>, "
    "enum_values array<struct<name: string, text: string>>, bases array<struct<name: string, access: string, is_virtual: boolean>>, attributes array<struct<name: string, argument: string>>, signature string"
)
PAGES = "module string, pos int, kind string, id string, title string, content string, brief string, is_mainpage boolean"


def entity_id(module: str, kind: str, qualified: str, ord_: int) -> str:
    return hashlib.blake2b(f"{module}\0{kind}\0{qualified}\0{ord_}".encode(), digest_size=10).hexdigest()


def _kind_of(node: cdecl.Node) -> str | None:
    if node.kind != "method":
        return None
    own = node.parent.name if node.parent is not None else ""
    if node.name.startswith("~"):
        return "destructor"
    if node.name.startswith("operator"):
        return "conversion_operator" if node.name.startswith("operator ") else "operator_overload"
    if node.name == own:
        first = re.sub(r"\s+", "", node.params[0].type) if len(node.params) == 1 else ""
        return "copy_constructor" if first in (f"const{own}&", f"{own}const&") else "move_constructor" if first == f"{own}&&" else "constructor"
    return "regular"


def _tparam_kind(type_: str) -> str:
    return "template" if type_.startswith("template") else "type" if re.match(r"(typename|class)\b", type_) else "non_type"


def rows_of(module: str, content: str, cpp: bool) -> list[dict]:
    out, ids = [], {}
    for n, node in enumerate(cdecl.parse(content, cpp)):
        own = entity_id(module, node.kind, node.qualified, n)
        ids[id(node)] = own
        text = cdecl.documentation(node, near=True)
        attributes = [re.match(r"\s*([\w:]*)\s*(?:\((.*)\))?", a, re.S) for a in node.attributes]
        out.append({
            "entity_id": own, "parent_id": ids.get(id(node.parent)) if node.parent is not None else None, "module": module, "kind": node.kind, "name": node.name, "qualified_name": node.qualified, "namespace": node.namespace,
            "access": node.access, "method_kind": _kind_of(node), "operator_symbol": node.name.removeprefix("operator").strip() if node.name.startswith("operator") else None,
            "return_type": node.return_type if node.kind in ("function", "method") else None, "underlying": node.text if node.kind in ("typedef", "type_alias") else node.return_type if node.kind == "enum" else node.text if node.kind in ("field", "variable") else None,
            "constraint_text": node.text if node.kind == "concept" else None, "body": node.text if node.kind == "macro" else None, "requires_clause": node.requires, "flags": [(f, True) for f in sorted(node.flags)],
            "line": node.line, "col_no": node.begin_column, "ord": n, "depth": node.depth, "doc": doccomment.parse(text), "params": [{"name": p.name, "type_str": p.type, "default_value": p.default} for p in node.params],
            "tparams": [{"name": p.name, "kind": _tparam_kind(p.type), "is_variadic": "..." in p.type, "default_value": p.default} for p in node.tparams], "enum_values": [{"name": a, "text": b} for a, b in node.values],
            "bases": [{"name": a, "access": b, "is_virtual": c} for a, b, c in node.bases], "attributes": [{"name": a.group(1), "argument": a.group(2)} for a in attributes if a], "signature": node.text if node.kind in ("function", "method") else None,
        })
    return out


def _parser():
    schema = to_arrow_schema(StructType.fromDDL(NODES))  # needs the session, so not in the worker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows = [r for m, c, cpp in zip(*(part.column(k).to_pylist() for k in range(3))) if c for r in rows_of(m, c, bool(cpp))]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in PAGES.split(", ")])
    for batch in batches:
        rows = []
        for module, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = 0
            toks = tokens(content or "")
            for n, t in enumerate(toks):
                if t.kind != "bc" or not ("page" in t.text or "group" in t.text):
                    continue
                alone = n + 1 == len(toks) or toks[n + 1].kind in ("lc", "bc", "pp")  # a page comment documents no declaration
                text = doccomment.strip_delimiters(t.text)
                page = doccomment.parse_page(text) if alone else None
                group = doccomment.parse_group(text)
                if page:
                    rows.append({"module": module, "pos": found, "kind": "page", "id": page["id"], "title": page["title"], "content": page["content"], "brief": None, "is_mainpage": page["is_mainpage"]})
                elif group:
                    rows.append({"module": module, "pos": found, "kind": "group", "id": group["id"], "title": group["name"], "content": None, "brief": group["brief"], "is_mainpage": False})
                found += bool(page or group)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def nodes(sources: DataFrame) -> DataFrame:
    """A row for each declaration of ``sources`` (path, content, is_cpp; a null is_cpp is told from the path)."""
    cpp = F.coalesce(F.col("is_cpp"), is_cpp(F.col("path"))) if "is_cpp" in sources.columns else is_cpp(F.col("path"))
    return sources.where(F.col("content").isNotNull()).select("path", "content", cpp.alias("is_cpp")).mapInArrow(_parser(), NODES)


def is_guard():
    """Whether a row of ``nodes`` is the macro that guards its file against a second inclusion: its name is the file's path."""
    return (F.col("kind") == "macro") & (F.size("params") == 0) & (F.upper(F.regexp_replace("module", "[^A-Za-z0-9]", "_")) == F.upper(F.regexp_replace("name", "_+$", "")))


def pages_and_groups(sources: DataFrame) -> DataFrame:
    return sources.select("path", "content").mapInArrow(_pages, PAGES)


def headers(sources: DataFrame, max_bytes: int = 10 * 1024 * 1024) -> DataFrame:
    """Files that are headers and not larger than the limit."""
    return sources.where(F.col("path").rlike(HEADERS) & (F.octet_length("content") <= max_bytes))


def entities(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("kind").isin("include", "field", "variable", "friend")).drop("params", "tparams", "enum_values", "bases", "attributes", "signature")


def _children(parsed: DataFrame, column: str) -> DataFrame:
    return parsed.select("entity_id", F.posexplode(column).alias("pos", "_c")).select("entity_id", "pos", "_c.*")


def params(parsed: DataFrame) -> DataFrame:
    return _children(parsed, "params")


def tparams(parsed: DataFrame) -> DataFrame:
    return _children(parsed, "tparams")


def enum_values(parsed: DataFrame) -> DataFrame:
    from marginalia.functions.exprs import enum_value

    return _children(parsed, "enum_values").select("entity_id", "pos", "name", enum_value(F.col("text")).alias("value"))


def bases(parsed: DataFrame) -> DataFrame:
    return _children(parsed, "bases")


def attributes(parsed: DataFrame) -> DataFrame:
    return _children(parsed, "attributes")


def fields(parsed: DataFrame) -> DataFrame:
    """Members of classes and structs, in their order."""
    return parsed.where("kind = 'field'").select(F.col("parent_id").alias("entity_id"), F.col("ord").alias("pos"), "name", F.col("underlying").alias("type_str"), "access", F.col("doc.brief").alias("doc"))


def friends(parsed: DataFrame) -> DataFrame:
    """Friends of classes: functions with their signature, and classes."""
    functions = parsed.where(F.coalesce(F.col("flags")["is_friend"], F.lit(False))).select(F.col("parent_id").alias("entity_id"), F.col("ord").alias("pos"), F.lit("function").alias("kind"), "name", "signature")
    return functions.unionByName(parsed.where("kind = 'friend'").select(F.col("parent_id").alias("entity_id"), F.col("ord").alias("pos"), F.lit("class").alias("kind"), "name", F.lit(None).cast("string").alias("signature")))


def doc_params(parsed: DataFrame) -> DataFrame:
    return _children(parsed, "doc.params")


def doc_tparams(parsed: DataFrame) -> DataFrame:
    return _children(parsed, "doc.tparams")


def doc_refs(parsed: DataFrame) -> DataFrame:
    return _children(parsed, "doc.refs")


def includes(sources: DataFrame) -> DataFrame:
    """Include lines by expression only: module, pos, path, is_system, line."""
    lines = sources.where(F.col("content").isNotNull()).select(F.col("path").alias("module"), F.posexplode(F.split("content", "\r?\n")).alias("_n", "_l"))
    pattern = r'^\s*#\s*include\s*(?:<([^>]*)>|"([^"]*)")'
    hit = lines.where(F.col("_l").rlike(pattern))
    system = F.regexp_extract("_l", pattern, 1)
    return hit.select("module", (F.col("_n") + 1).alias("line"), F.when(system != "", system).otherwise(F.regexp_extract("_l", pattern, 2)).alias("path"), (system != "").alias("is_system"))
