"""Plans of the queries on whole texts: what travels and what doesn't."""

from marginalia.llm import queries

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_shuffle_of_texts(spark):
    assert "Exchange" not in plan(queries.p6_ids(spark, D))
    for name in ("p3_found", "p4_found", "p7_found"):
        text = plan(queries.QUERIES[name](spark, D))
        below = text[text.index("MapInArrow") :]
        assert "Exchange" not in below[: below.index("FileScan")], name  # all shuffles are above the operator, on its small rows


def test_no_products(spark):
    for name, f in queries.QUERIES.items():
        text = plan(f(spark, D))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_columns(spark):
    want = {"p3_found": ["path", "line", "name"], "p4_found": ["path", "lang"], "p5_found": ["entity_id", "span_start", "span_end"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "seg_no", "lang"]}
    for name, columns in want.items():
        df = queries.QUERIES[name](spark, D)
        assert df.columns == columns
        rows = df.collect()
        assert len({str(r) for r in rows}) == len(rows)
