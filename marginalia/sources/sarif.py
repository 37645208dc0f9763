"""Interchange documents: models read from and written to SARIF, and issues as SARIF results."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.jsontext import NotJson
from marginalia.operators.nested import MODULES_KEY, VERSION, VERSION_KEY, properties_of

TOOL, TOOL_VERSION = "marginalia", "0.1.0"
SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
STATUS = "sarif_id bigint, status string, modules int"


def status_of(body: str | None) -> tuple[str, int]:
    """``ok`` and the number of modules, or why a body isn't read."""
    try:
        p = properties_of(body)
    except NotJson:
        return "InvalidJson", 0
    if p is None:
        return "InvalidStructure", 0
    if not isinstance(p.get(VERSION_KEY), str):
        return "MissingVersion", 0
    if p[VERSION_KEY] != VERSION:
        return "UnsupportedVersion", 0
    if not isinstance(p.get(MODULES_KEY), list):
        return "MissingModules", 0
    return "ok", len(p[MODULES_KEY])


def _statuses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [status_of(b) for b in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.int32())], names=["sarif_id", "status", "modules"])


def statuses(documents: DataFrame) -> DataFrame:
    """Whether each document (sarif_id, body) can be read, and if not why."""
    return documents.select("sarif_id", "body").mapInArrow(_statuses, STATUS)


def module_documents(parsed: DataFrame) -> DataFrame:
    """One SARIF document for each module of parsed declarations: module, body.

    Children are collected by module; a module is a file, so its size is that of a file. Unions, namespaces, groups and
    includes aren't written, as in the format."""
    doc = F.when(F.col("doc").isNotNull(), F.struct(
        F.col("doc.brief").alias("brief"), F.col("doc.details").alias("details"), F.col("doc.params").alias("params"), F.col("doc.returns").alias("returns"), F.col("doc.deprecated").alias("deprecated"),
        F.col("doc.since").alias("since"), F.col("doc.examples").alias("examples"), F.col("doc.notes").alias("notes"), F.col("doc.warnings").alias("warnings"), F.col("doc.see_also").alias("seeAlso"), F.col("doc.tparams").alias("tparams"),
    ))
    args = F.transform("params", lambda p: F.struct(p["name"].alias("name"), p["type_str"].alias("type")))
    location = F.struct(F.col("line").alias("line"), F.col("col_no").alias("column"))
    flag = lambda f: F.coalesce(F.col("flags")[f], F.lit(False))
    method = parsed.where("kind = 'method'").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct(
        "ord", F.struct("name", F.col("return_type").alias("returnType"), F.col("access"), F.regexp_replace("method_kind", "^(operator|conversion)_.*", "$1").alias("kind"), flag("is_static").alias("isStatic"), flag("is_virtual").alias("isVirtual"), flag("is_const").alias("isConst"), args.alias("params"), doc.alias("doc")).alias("m"),
    ))).alias("_m"))
    field = parsed.where("kind = 'field'").groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.struct("name", F.col("underlying").alias("type"), "access").alias("f")))).alias("_f"))
    full = parsed.where("kind not in ('method', 'field', 'include', 'union', 'variable', 'friend')").join(method.withColumnRenamed("parent_id", "entity_id"), "entity_id", "left").join(field.withColumnRenamed("parent_id", "entity_id"), "entity_id", "left")
    body = F.to_json(F.struct(
        F.col("name"), location.alias("location"), F.col("return_type").alias("returnType"), F.when(F.col("kind").isin("function", "macro"), args).alias("params"), F.col("underlying"), F.col("body"), F.col("constraint_text").alias("constraint"),
        F.transform("_m", lambda x: x["m"]).alias("methods"), F.transform("_f", lambda x: x["f"]).alias("fields"), F.when(F.col("kind") == "enum", F.col("enum_values")).alias("values"), F.when(F.col("kind") == "class", F.col("bases")).alias("baseClasses"), doc.alias("doc"),
    ))
    keys = {"function": "functions", "class": "classes", "struct": "structs", "enum": "enums", "typedef": "typedefs", "macro": "macros", "type_alias": "typeAliases", "concept": "concepts"}
    per = full.groupBy("module").agg(*[F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ord", body.alias("j"))))), lambda x: x["j"]), ",").alias(v) for k, v in keys.items()])
    parts = F.concat(F.lit('{"name":'), F.to_json(F.array("module")), *[x for v in keys.values() for x in (F.lit(f',"{v}":['), F.coalesce(F.col(v), F.lit("")), F.lit("]"))], F.lit("}"))
    module = F.regexp_replace(parts, r'^\{"name":\[("(?:[^"\\]|\\.)*")\]', r'{"name":$1')
    head = json.dumps({"$schema": SCHEMA, "version": "2.1.0"})[:-1] + ', "runs": [{"tool": {"driver": {"name": "' + TOOL + '", "version": "' + TOOL_VERSION + '"}}, "results": [], "properties": {"' + VERSION_KEY + '": "' + VERSION + '", "' + MODULES_KEY + '": ['
    return per.select("module", F.concat(F.lit(head), module, F.lit("]}}]}")).alias("body"))


def rules(issues: DataFrame) -> DataFrame:
    """Each code once with the severity of its first issue."""
    return issues.groupBy("code").agg(F.min_by("severity", F.struct("file", "line", "message")).alias("severity"))


def results(issues: DataFrame) -> DataFrame:
    """A SARIF result for each issue as JSON text; without a line no region; ``\\`` in paths as ``/``."""
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    text = F.concat("message", F.lit(" (in "), "entity_type", F.lit(" '"), "entity_name", F.lit("')"))
    uri = F.replace("file", F.lit("\\"), F.lit("/"))
    region = F.when(F.col("line") > 0, F.struct(F.col("line").alias("startLine")))
    place = F.array(F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    return issues.select("file", "line", "code", F.to_json(F.struct(F.col("code").alias("ruleId"), level.alias("level"), F.struct(text.alias("text")).alias("message"), place.alias("locations"))).alias("result"))


def lint_documents(issues: DataFrame) -> DataFrame:
    """A whole SARIF document for each file with issues: file, body. Its rules are the codes found in the file, in their order.

    Issues are collected by file, never by project."""
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    rows = results(issues).select("file", "line", "code", "result")
    body = rows.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "code", "result"))), lambda x: x["result"]), ",").alias("_r"))
    rule = F.to_json(F.struct(F.col("code").alias("id"), F.struct(F.col("_l").alias("level")).alias("defaultConfiguration")))
    ruled = issues.groupBy("file", "code").agg(F.min(level).alias("_l")).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("code", rule.alias("j")))), lambda x: x["j"]), ",").alias("_rules"))
    head = f'{{"$schema":"{SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{TOOL}","version":"{TOOL_VERSION}","rules":['
    return body.join(ruled, "file").select("file", F.concat(F.lit(head), F.col("_rules"), F.lit(']}},"results":['), F.col("_r"), F.lit("]}]}")).alias("body"))
