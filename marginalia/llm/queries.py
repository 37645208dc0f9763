"""Queries p3 to p8 over the tables of a folder."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import codelang, docpairs, encode, labels, leaks, spans


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(spark: SparkSession) -> str:
    """The folder of vocabularies is a setting (``marginalia.tokenizers``); else that of the package public_tokenizers."""
    folder = spark.conf.get("marginalia.tokenizers", None)
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, "byte_bpe_50k.json")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.places(table(spark, d, "sources"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docpairs.pairs(table(spark, d, "sources"))


def _passages(spark: SparkSession, d: str) -> DataFrame:
    return codelang.find(table(spark, d, "sources"), codelang.train(table(spark, d, "documents"), table(spark, d, "lang_aliases")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return codelang.languages(_passages(spark, d))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return codelang.shares(codelang.distinct(_passages(spark, d)))


def _shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(spans.texts_of(table(spark, d, "entities")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.rows(_shared(spark, d))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return spans.shares(_shared(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), tokenizer_path(spark))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.exact(_leaks(spark, d))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return labels.segments(table(spark, d, "documents"), table(spark, d, "lang_aliases"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return labels.wrong(_segments(spark, d))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d)


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    return labels.documents_languages(_segments(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_pairs, p4_found, p4_shares, p5_found, p5_shares, p6_ids, p7_found, p7_leaks, p8_found, p8_segments, p8_documents)}
_SPANS = """
WITH t AS (SELECT entity_id, arg_max(coalesce(doc.details, doc.raw), ingested_at) AS x FROM entities WHERE entity_id IS NOT NULL GROUP BY 1),
w AS (SELECT entity_id, i, substr(x, i + 1, 160) AS s FROM (SELECT entity_id, x, unnest(range(0, length(x) - 159)) AS i FROM t WHERE length(x) >= 160)),
common AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT entity_id) > 1),
hit AS (SELECT entity_id, i FROM w SEMI JOIN common USING (s)),
marked AS (SELECT *, coalesce(i > lag(i) OVER o + 160, true) AS begins FROM hit WINDOW o AS (PARTITION BY entity_id ORDER BY i)),
runs AS (SELECT *, count(*) FILTER (begins) OVER (PARTITION BY entity_id ORDER BY i) AS n FROM marked),
spans AS (SELECT entity_id, min(i)::int AS span_start, (max(i) + 160)::int AS span_end FROM runs GROUP BY entity_id, n)
"""
_RUNS = """
WITH iw AS (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM eval_items), dw AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM documents),
ig AS (SELECT DISTINCT item_id, lower(array_to_string(w[k:k + 11], ' ')) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM iw WHERE len(w) >= 12)),
dg AS (SELECT doc_id, lower(array_to_string(w[k:k + 11], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM dw WHERE len(w) >= 12))
"""

ORACLE: dict[str, str] = {
    "p5_found": _SPANS + "SELECT * FROM spans",
    "p5_shares": _SPANS + "SELECT entity_id, length(any_value(x))::int AS text_chars, sum(span_end - span_start)::int AS shared_chars, round(sum(span_end - span_start) / length(any_value(x)), 6) AS share FROM spans JOIN t USING (entity_id) GROUP BY 1",
    "p7_found": _RUNS + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
}
