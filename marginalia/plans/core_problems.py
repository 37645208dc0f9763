"""Queries p1 and p2 over the tables of a folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import nested, orphans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tracked(spark: SparkSession, d: str, **options) -> orphans.OrphanTracker:
    refs = orphans.references(table(spark, d, "doc_refs"), table(spark, d, "doc_params"))
    arrived = orphans.parents(table(spark, d, "entities"), table(spark, d, "symbols"), table(spark, d, "pages"))
    return orphans.track(spark, refs, arrived, **options)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d).state.pending.select(*orphans.REF_ID).distinct()


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _tracked(spark, d).counts()


def p1_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The pending orphans as they were known at the beginning of each year: ``as_of``, and at the end (null), by table, month and reason."""
    refs = orphans.references(table(spark, d, "doc_refs"), table(spark, d, "doc_params"))
    first, last = refs.agg(F.min("ingested_at"), F.max("ingested_at")).first()
    cuts = [datetime(y, 1, 1) for y in range(first.year + 1, last.year + 1)] if first is not None else []
    tracker = _tracked(spark, d, cuts=cuts, count=True)
    out = None
    for cut, counts in zip([*cuts, None], tracker.snapshots):
        rows = counts.drop("step").withColumn("as_of", F.lit(cut.date() if cut else None).cast("date"))
        out = rows if out is None else out.unionByName(rows)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.params(nested.flatten(table(spark, d, "sarif_documents")))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    """Every object of every kind at its place, with its name and main text."""
    return nested.records(nested.flatten(table(spark, d, "sarif_documents")))


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of the bridge each kind has in each document, and below how many parents."""
    bridge = nested.flatten(table(spark, d, "sarif_documents")).occurrences
    return bridge.groupBy("sarif_id", "child_kind").agg(F.count(F.lit(1)).alias("occurrences"), F.countDistinct(F.coalesce("owner_path", F.lit(""))).alias("owners"))


def p2_objects(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct object once."""
    return nested.flatten(table(spark, d, "sarif_documents")).objects.select("object_id", "kind", "name", "attributes")


def p2_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of every object below its parent."""
    return nested.flatten(table(spark, d, "sarif_documents")).occurrences


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts, "p1_snapshots": p1_snapshots, "p2_found": p2_found, "p2_records": p2_records, "p2_kinds": p2_kinds, "p2_objects": p2_objects, "p2_bridge": p2_bridge}

_ORPHANS = r"""
WITH refs AS (
  SELECT DISTINCT entity_id, pos, seen_at, strftime(seen_at, '%Y-%m') AS period, lower(coalesce(kind, 'symbol')) AS space,
         regexp_replace(target, '^\s+|\s+$', '', 'g') AS t FROM doc_refs),
targets AS (
  SELECT entity_id, pos, seen_at, period, space, CASE WHEN space = 'symbol' THEN regexp_replace(t, '^::', '') ELSE t END AS k
  FROM refs WHERE t <> ''),
keyed AS (
  SELECT *, CASE WHEN space = 'symbol' AND contains(k, '(') THEN split_part(k, '(', 1) ELSE k END AS k2 FROM targets),
declared AS (
  SELECT DISTINCT unnest(regexp_extract_all(content, '(?m)^[^\S\r\n]*[@\\](?:section|anchor)[^\S\r\n]+\S+')) AS line, added_at, removed_at FROM pages),
live AS (
  SELECT 'symbol' AS space, lookup_key AS k, added_at, removed_at FROM symbols
  UNION SELECT 'page', id, added_at, removed_at FROM pages
  UNION SELECT regexp_extract(line, '(section|anchor)', 1), regexp_extract(line, '[@\\](?:section|anchor)\s+(\S+)', 1), added_at, removed_at FROM declared),
began AS (SELECT space, k, min(added_at) AS f FROM live GROUP BY ALL),
begun AS (SELECT r.*, coalesce(least(b1.f, b2.f), b1.f, b2.f) AS f FROM keyed r LEFT JOIN began b1 ON b1.space = r.space AND b1.k = r.k LEFT JOIN began b2 ON b2.space = r.space AND b2.k = r.k2),
orphans AS (
  SELECT 'doc_refs' AS src_table, 'target' AS ref_field, entity_id, pos, period, CASE WHEN f IS NULL THEN 'never' WHEN f > r.seen_at THEN 'not yet' ELSE 'no longer' END AS reason FROM begun r
  WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.space = r.space AND l.k = r.k AND r.seen_at >= l.added_at AND (l.removed_at IS NULL OR r.seen_at < l.removed_at))
    AND NOT EXISTS (SELECT 1 FROM live l WHERE l.space = r.space AND l.k = r.k2 AND r.seen_at >= l.added_at AND (l.removed_at IS NULL OR r.seen_at < l.removed_at))
  UNION
  SELECT 'doc_refs', 'entity_id', entity_id, pos, period, 'never' FROM refs r WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.entity_id = r.entity_id)
  UNION
  SELECT 'doc_params', 'entity_id', entity_id, pos, min(strftime(ingested_at, '%Y-%m')), 'never' FROM doc_params r
  WHERE NOT EXISTS (SELECT 1 FROM entities e WHERE e.entity_id = r.entity_id) GROUP BY ALL)
"""

_NESTED = f"""
WITH RECURSIVE ok AS (
  SELECT DISTINCT sarif_id, json_extract(body, '$.runs[0].properties."{nested.MODULES_KEY}"') AS ms FROM sarif_documents
  WHERE body IS NOT NULL AND json_valid(body) AND json_type(body, '$.runs') = 'ARRAY' AND json_type(body, '$.runs[0].properties."{nested.VERSION_KEY}"') = 'VARCHAR'
    AND json_extract_string(body, '$.runs[0].properties."{nested.VERSION_KEY}"') = '{nested.VERSION}' AND json_type(body, '$.runs[0].properties."{nested.MODULES_KEY}"') = 'ARRAY'),
m AS (SELECT sarif_id, i::varchar AS path, json_extract(ms, '$[' || i || ']') AS o FROM (SELECT *, unnest(range(0, json_array_length(ms)::bigint)) AS i FROM ok)),
below AS (SELECT * FROM m WHERE json_type(o) = 'OBJECT'),
cls AS (
  SELECT sarif_id, path || '/classes/' || j AS path, json_extract(o, '$.classes[' || j || ']') AS o FROM (SELECT *, unnest(range(0, CASE WHEN json_type(o, '$.classes') = 'ARRAY' THEN json_array_length(o, '$.classes')::bigint ELSE 0 END)) AS j FROM below)
  UNION ALL
  SELECT sarif_id, path || '/nestedClasses/' || j, json_extract(o, '$.nestedClasses[' || j || ']') FROM (SELECT *, unnest(range(0, CASE WHEN json_type(o) = 'OBJECT' AND json_type(o, '$.nestedClasses') = 'ARRAY' THEN json_array_length(o, '$.nestedClasses')::bigint ELSE 0 END)) AS j FROM cls)),
owners AS (
  SELECT sarif_id, path || '/functions/' || j AS path, json_extract(o, '$.functions[' || j || ']') AS o FROM (SELECT *, unnest(range(0, CASE WHEN json_type(o, '$.functions') = 'ARRAY' THEN json_array_length(o, '$.functions')::bigint ELSE 0 END)) AS j FROM below)
  UNION ALL
  SELECT sarif_id, path || '/methods/' || j, json_extract(o, '$.methods[' || j || ']') FROM (SELECT *, unnest(range(0, CASE WHEN json_type(o) = 'OBJECT' AND json_type(o, '$.methods') = 'ARRAY' THEN json_array_length(o, '$.methods')::bigint ELSE 0 END)) AS j FROM cls)),
own AS (SELECT * FROM owners WHERE json_type(o) = 'OBJECT'),
held AS (
  SELECT sarif_id, path, 'param' AS child_kind, j AS pos, json_extract(o, '$.params[' || j || ']') AS p FROM (SELECT *, unnest(range(0, CASE WHEN json_type(o, '$.params') = 'ARRAY' THEN json_array_length(o, '$.params')::bigint ELSE 0 END)) AS j FROM own)
  UNION ALL
  SELECT sarif_id, path, 'doc_param', j, json_extract(o, '$.doc.params[' || j || ']') FROM (SELECT *, unnest(range(0, CASE WHEN json_type(o, '$.doc') = 'OBJECT' AND json_type(o, '$.doc.params') = 'ARRAY' THEN json_array_length(o, '$.doc.params')::bigint ELSE 0 END)) AS j FROM own))
SELECT DISTINCT sarif_id, path AS owner_path, child_kind, pos::int AS pos, CASE WHEN json_type(p, '$.name') = 'VARCHAR' THEN json_extract_string(p, '$.name') ELSE '' END AS name FROM held WHERE json_type(p) = 'OBJECT'
"""

# The same as of every cut: each table is taken as far as it had arrived.
_AS_OF = """
WITH cuts AS (
  SELECT make_date(y::int, 1, 1) AS as_of FROM (SELECT unnest(range(min(year(ingested_at)) + 1, max(year(ingested_at)) + 1)) AS y FROM (SELECT ingested_at FROM doc_refs UNION ALL SELECT ingested_at FROM doc_params))
  UNION ALL SELECT NULL),
refs AS (SELECT DISTINCT as_of, entity_id, pos, seen_at, strftime(seen_at, '%Y-%m') AS period, lower(coalesce(kind, 'symbol')) AS space, regexp_replace(target, '^\\s+|\\s+$', '', 'g') AS t
  FROM doc_refs, cuts WHERE as_of IS NULL OR ingested_at < as_of),
params AS (SELECT as_of, entity_id, pos, min(ingested_at) AS came FROM doc_params, cuts WHERE as_of IS NULL OR ingested_at < as_of GROUP BY ALL),
ents AS (SELECT DISTINCT as_of, entity_id FROM entities, cuts WHERE as_of IS NULL OR ingested_at < as_of),
keyed AS (SELECT *, CASE WHEN space = 'symbol' AND contains(k, '(') THEN split_part(k, '(', 1) ELSE k END AS k2
  FROM (SELECT *, CASE WHEN space = 'symbol' THEN regexp_replace(t, '^::', '') ELSE t END AS k FROM refs WHERE t <> '')),
declared AS (SELECT DISTINCT as_of, unnest(regexp_extract_all(content, '(?m)^[^\\S\\r\\n]*[@\\\\](?:section|anchor)[^\\S\\r\\n]+\\S+')) AS line, added_at, removed_at FROM pages, cuts WHERE as_of IS NULL OR ingested_at < as_of),
live AS (
  SELECT as_of, 'symbol' AS space, lookup_key AS k, added_at, removed_at FROM symbols, cuts WHERE as_of IS NULL OR ingested_at < as_of
  UNION SELECT as_of, 'page', id, added_at, removed_at FROM pages, cuts WHERE as_of IS NULL OR ingested_at < as_of
  UNION SELECT as_of, regexp_extract(line, '(section|anchor)', 1), regexp_extract(line, '[@\\\\](?:section|anchor)\\s+(\\S+)', 1), added_at, removed_at FROM declared),
began AS (SELECT as_of, space, k, min(added_at) AS f FROM live GROUP BY ALL),
begun AS (SELECT r.*, coalesce(least(b1.f, b2.f), b1.f, b2.f) AS f FROM keyed r
  LEFT JOIN began b1 ON b1.space = r.space AND b1.k = r.k AND b1.as_of IS NOT DISTINCT FROM r.as_of LEFT JOIN began b2 ON b2.space = r.space AND b2.k = r.k2 AND b2.as_of IS NOT DISTINCT FROM r.as_of),
hits AS (SELECT DISTINCT r.as_of, r.entity_id, r.pos, r.seen_at, r.space, r.k FROM begun r JOIN live l ON l.space = r.space AND l.k IN (r.k, r.k2) AND l.as_of IS NOT DISTINCT FROM r.as_of AND r.seen_at >= l.added_at AND (l.removed_at IS NULL OR r.seen_at < l.removed_at)),
orphans AS (
  SELECT as_of, 'doc_refs' AS src_table, 'target' AS ref_field, entity_id, pos, period, CASE WHEN f IS NULL THEN 'never' WHEN f > r.seen_at THEN 'not yet' ELSE 'no longer' END AS reason FROM begun r
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.as_of IS NOT DISTINCT FROM r.as_of AND h.entity_id IS NOT DISTINCT FROM r.entity_id AND h.pos = r.pos AND h.seen_at = r.seen_at AND h.space = r.space AND h.k = r.k)
  UNION SELECT as_of, 'doc_refs', 'entity_id', entity_id, pos, period, 'never' FROM refs r WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.entity_id = r.entity_id AND e.as_of IS NOT DISTINCT FROM r.as_of)
  UNION SELECT as_of, 'doc_params', 'entity_id', entity_id, pos, strftime(came, '%Y-%m'), 'never' FROM params r WHERE NOT EXISTS (SELECT 1 FROM ents e WHERE e.entity_id = r.entity_id AND e.as_of IS NOT DISTINCT FROM r.as_of))
SELECT as_of, src_table, ref_field, period, reason, count(*) AS orphans FROM orphans GROUP BY ALL
"""

_EDGES = ", ".join(f"('{kind}', '{key}', '{child}', true)" for kind, below in nested.CHILDREN.items() for key, child in below) + ", " + ", ".join(f"('{kind}', '{key}', 'doc', false)" for kind, key in nested.SINGLE.items())
_MAIN = " ".join(f"WHEN '{kind}' THEN CASE WHEN json_type(o, '$.{key}') = 'VARCHAR' THEN json_extract_string(o, '$.{key}') ELSE {'NULL' if absent is None else repr(absent)} END" for kind, (key, absent) in nested.MAIN.items())
_RECORDS = f"""
WITH RECURSIVE edges(kind, key, child, many) AS (VALUES {_EDGES}),
ok AS (
  SELECT DISTINCT sarif_id, json_extract(body, '$.runs[0].properties."{nested.MODULES_KEY}"') AS ms FROM sarif_documents
  WHERE body IS NOT NULL AND json_valid(body) AND json_type(body, '$.runs') = 'ARRAY' AND json_type(body, '$.runs[0].properties."{nested.VERSION_KEY}"') = 'VARCHAR'
    AND json_extract_string(body, '$.runs[0].properties."{nested.VERSION_KEY}"') = '{nested.VERSION}' AND json_type(body, '$.runs[0].properties."{nested.MODULES_KEY}"') = 'ARRAY'),
node AS (
  SELECT sarif_id, NULL::varchar AS owner_path, 'module' AS kind, i::int AS pos, i::varchar AS path, json_extract(ms, '$[' || i || ']') AS o FROM (SELECT *, unnest(range(0, json_array_length(ms)::bigint)) AS i FROM ok)
  WHERE json_type(ms, '$[' || i || ']') = 'OBJECT'
  UNION ALL
  SELECT sarif_id, path, child, j::int, path || '/' || key || CASE WHEN many THEN '/' || j ELSE '' END, c FROM (
    SELECT sarif_id, path, child, key, many, j, json_extract(o, '$.' || key || CASE WHEN many THEN '[' || j || ']' ELSE '' END) AS c FROM (
      SELECT n.sarif_id, n.path, n.o, e.child, e.key, e.many, unnest(range(0, CASE WHEN NOT e.many THEN 1 WHEN json_type(n.o, '$.' || e.key) = 'ARRAY' THEN json_array_length(n.o, '$.' || e.key)::bigint ELSE 0 END)) AS j
      FROM node n JOIN edges e ON e.kind = n.kind)) WHERE json_type(c) = 'OBJECT'),
shown AS (SELECT DISTINCT sarif_id, owner_path, kind AS child_kind, pos, CASE WHEN json_type(o, '$.name') = 'VARCHAR' THEN json_extract_string(o, '$.name') ELSE '' END AS name,
  CASE kind {_MAIN} WHEN 'value' THEN CASE WHEN json_type(o, '$.value') IN ('BIGINT', 'UBIGINT') THEN json_extract_string(o, '$.value') END END AS text, md5(o::varchar) AS h FROM node)
"""

ORACLE = {
    "p1_snapshots": _AS_OF,
    "p2_records": _RECORDS + "SELECT sarif_id, owner_path, child_kind, pos, name, text FROM shown",
    "p2_kinds": _RECORDS + "SELECT sarif_id, child_kind, count(*) AS occurrences, count(DISTINCT coalesce(owner_path, '')) AS owners FROM shown GROUP BY ALL",
    "p2_found": _NESTED,
    "p1_found": _ORPHANS + "SELECT DISTINCT src_table, ref_field, entity_id, pos FROM orphans",
    "p1_counts": _ORPHANS + "SELECT src_table, ref_field, period, reason, count(*) AS orphans FROM orphans GROUP BY ALL",
}
