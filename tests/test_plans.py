"""What the plans must and must not hold, whatever the size of the tables."""

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products(spark):
    from marginalia.plans import core_problems, reference

    for name in ("coverage_by_kind", "missing_items", "lint_issues", "did_you_mean", "resolve_ref", "symbol_table", "scoped_lookup", "fuzzy_lookup", "merge_diagnostics", "change_status", "external_links", "module_assignment"):
        text = plan(reference.QUERIES[name](spark, D))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    assert set(core_problems.ORACLE) <= set(core_problems.QUERIES)


def test_filters_and_columns_reach_the_scan(spark):
    from marginalia.plans import reference

    text = plan(reference.QUERIES["project_stats"](spark, D))
    assert "PushedFilters: [In(kind" in text
    scan = next(x for x in text.split("\n") if "FileScan" in x)
    assert "doc" not in scan.split("ReadSchema")[1]


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p1_found", "p2_found"} <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["src_table", "ref_field", "entity_id", "pos"] and df.count() >= 0


def test_names_of_signatures(spark, tmp_path):
    from marginalia.plans import reference

    keys = ["n::Box::put_all(std::string, const n::Box&)", "f(std::map<a::B, int>*)", "n::Box::operator()(a::B)", "n::put", "put"]
    spark.createDataFrame([(k, "function", "a/b.hpp", "", k) for k in keys], "lookup_key string, kind string, source_file string, anchor string, name string").selectExpr("*", "timestamp'2024-01-01' AS added_at").write.parquet(f"{tmp_path}/symbols.parquet")
    rows = {r["lookup_key"]: r for r in reference.QUERIES["symbol_names"](spark, str(tmp_path)).collect()}
    assert [rows[k]["short"] for k in keys] == ["put_all(std::string, const n::Box&)", "f(std::map<a::B, int>*)", "operator()(a::B)", "put", "put"]
    assert rows[keys[0]]["anchor_of"] == "n::box::put-all(std::string,-const-n::box&)" and not rows[keys[0]]["anchor_id"] and rows[keys[3]]["title"] == "b"


def test_index_keeps_briefs_that_are_not_ascii(spark, tmp_path):
    from marginalia.plans import reference

    briefs = ["é short", "a" * 59 + "é and more", "a" * 58 + "é and more", "a" * 57 + "\ufffdé", "\U0001f680" * 16, "a" * 61, None]
    want = ["é short", "a" * 59 + "...", "a" * 58 + "é...", "a" * 57 + "\ufffd...", "\U0001f680" * 15 + "...", "a" * 60 + "...", None]
    rows = [(n, "function", None, "a.h", f"n::f{n}", (b,), None) for n, b in enumerate(briefs)]
    spark.createDataFrame(rows, "entity_id int, kind string, access string, module string, qualified_name string, doc struct<brief: string>, ingested_at timestamp").write.parquet(f"{tmp_path}/entities.parquet")
    got = {r["entity_id"]: r["brief"] for r in reference.QUERIES["symbol_index"](spark, str(tmp_path)).collect()}
    assert [got[n] for n in range(len(briefs))] == want
