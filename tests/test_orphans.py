from datetime import datetime as T

from marginalia.operators import orphans

R = "entity_id string, pos int, target string, kind string, seen_at timestamp_ntz, ingested_at timestamp_ntz, key string"
E = "entity_id string, ingested_at timestamp_ntz"
S = "lookup_key string, added_at timestamp_ntz, removed_at timestamp_ntz, ingested_at timestamp_ntz"
P = "id string, content string, added_at timestamp_ntz, removed_at timestamp_ntz, ingested_at timestamp_ntz"


def day(n):
    return T(2024, 1, n)


def tables(spark, refs=(), params=(), entities=(), symbols=(), pages=()):
    d = spark.createDataFrame
    return (
        orphans.references(d(list(refs), R), d(list(params), "entity_id string, pos int, ingested_at timestamp_ntz")),
        orphans.parents(d(list(entities), E), d(list(symbols), S), d(list(pages), P)),
    )


def found(spark, steps=3, **t):
    refs, parents = tables(spark, **t)
    got = [tuple(r)[:4] for r in orphans.track(spark, refs, parents, steps).orphans().collect()]
    assert len(got) == len(set(got))
    return set(got)


def ref(pos, target, kind=None, seen=5, arrived=5, owner="e"):
    return (owner, pos, target, kind, day(seen) if seen else None, day(arrived), "extra")


def test_liveness_and_spellings(spark):
    refs = [
        ref(0, "a::f"), ref(1, " ::a::f(int, char)\t", "SYMBOL"), ref(2, "g"), ref(3, "g", seen=9), ref(4, "g", seen=12), ref(5, "h(int)"), ref(6, "h"), ref(7, None), ref(8, " \n"),
        ref(9, "pg", "Page"), ref(10, "s1", "section"), ref(11, "s1", "anchor"), ref(12, "late"), ref(13, "::pg", "page"), ref(14, "a::f", seen=None), ref(15, "x", "nokind"), ref(0, "a::f", arrived=8),
        ref(19, "a::f"), ref(19, "other", arrived=7), ref(16, "a::f", owner="gone"), ref(17, "a::f", owner=None), ref(18, "w" * 50000),
    ]
    symbols = [("a::f", day(1), None, day(2)), ("g", day(1), day(9), day(2)), ("g", day(11), None, day(12)), ("h(int)", day(1), None, day(1)), ("late", day(1), None, day(20)), (None, day(1), None, day(1))]
    pages = [("pg", "text\r\n  @section s1 Title\r\nno @anchor s2 x\n\\anchor s3", day(1), None, day(3)), (None, None, day(1), None, day(3))]
    params = [("e", 0, day(3)), ("gone", 1, day(4)), ("gone", 1, day(5))]
    want = {("doc_refs", "target", "e", p) for p in (3, 6, 11, 13, 14, 15, 18, 19)}
    want |= {("doc_refs", "entity_id", "gone", 16), ("doc_refs", "entity_id", None, 17), ("doc_params", "entity_id", "gone", 1)}
    for steps in (1, 3):
        assert found(spark, steps, refs=refs, params=params, entities=[("e", day(1)), ("e", day(2)), (None, day(1))], symbols=symbols, pages=pages) == want


def test_arrivals_resolve_and_deletions_reopen(spark):
    refs, none = tables(spark, refs=[ref(0, "k", seen=5), ref(1, "k", seen=8)], entities=[])
    t = orphans.OrphanTracker(spark)
    pending = lambda: {r["pos"] for r in t.state.pending.where("ref_field = 'target'").collect()}
    parent = lambda *symbols: tables(spark, symbols=symbols)[1]
    t.step(refs, none)
    assert pending() == {0, 1}
    t.step(refs.limit(0), parent(("k", day(1), None, day(6))), count=True)
    assert pending() == set()
    t.step(refs.limit(0), parent(("k", day(1), day(7), day(9))), count=True)
    assert pending() == {1}
    t.step(refs.limit(0), parent(("k", day(8), None, day(10))))
    assert pending() == set()
    assert [s.where("ref_field = 'target'").count() for s in t.snapshots] == [0, 1]


def test_reasons(spark):
    refs, parents = tables(spark, refs=[ref(0, "old"), ref(1, "new"), ref(2, "none"), ref(3, "f()")], entities=[("e", day(1))], symbols=[("old", day(1), day(3), day(1)), ("new", day(8), None, day(8)), ("f", day(1), day(2), day(1)), ("f()", day(9), None, day(9))])
    got = orphans.track(spark, refs, parents, 2)
    assert {r["pos"]: r["reason"] for r in got.orphans().collect()} == {0: "no longer", 1: "not yet", 2: "never", 3: "no longer"}
    assert {(r["period"], r["reason"], r["orphans"]) for r in got.counts().collect()} == {("2024-01", "no longer", 2), ("2024-01", "not yet", 1), ("2024-01", "never", 1)}


def test_hot_target_and_empty_tables(spark):
    refs = [ref(i, "hot", seen=5 if i % 2 else 1) for i in range(400)] + [ref(1000 + i, f"k{i}") for i in range(300)]
    got = found(spark, refs=refs, entities=[("e", day(1))], symbols=[("hot", day(3), None, day(4))])
    assert got == {("doc_refs", "target", "e", i) for i in [*range(0, 400, 2), *range(1000, 1300)]}
    assert found(spark) == set()


def test_resume_and_streams(spark, tmp_path):
    from marginalia.streaming.orphans import follow

    refs, parents = tables(spark, refs=[ref(0, "k"), ref(1, "late")], entities=[("e", day(1))], symbols=[("k", day(1), None, day(1))])
    refs.write.parquet(str(tmp_path / "refs"))
    parents.write.parquet(str(tmp_path / "parents"))
    root = f"file://{tmp_path}/state"
    stream = lambda name, ddl: spark.readStream.schema(ddl).parquet(str(tmp_path / name))
    follow(orphans.OrphanTracker(spark, root), stream("refs", orphans.REFS), stream("parents", orphans.PARENTS), str(tmp_path / "cp"))
    again = orphans.OrphanTracker.resume(spark, root)
    assert again.state.number == 2 and {r["pos"] for r in again.state.pending.collect()} == {1}
    again.step(refs.limit(0), tables(spark, symbols=[("late", day(1), None, day(9))])[1])
    assert again.state.pending.count() == 0
    assert orphans.OrphanTracker.resume(spark, f"file://{tmp_path}/none").state.number == 0


def test_parent_without_time_of_arrival_ends(spark):
    symbols = [("k", day(1), day(3), None), ("m", day(1), day(3), None), ("m", day(1), None, day(4))]
    for steps in (1, 2):
        assert found(spark, steps, refs=[ref(0, "k", seen=5), ref(1, "k", seen=2, arrived=9), ref(2, "m")], entities=[("e", day(1))], symbols=symbols) == {("doc_refs", "target", "e", 0)}


def test_any_division_into_steps_gives_one_result(spark, monkeypatch):
    """Late rows, lives that are shortened, prolonged, ended and taken up again, copies, ties and null arrivals, against plain Python."""
    import random

    rng = random.Random(5)
    keys = ["a", "b", "b(int)", "c::d", "e"]
    symbols = [(rng.choice(keys), day(rng.choice([1, 10, 18])), rng.choice([None, day(rng.randint(2, 28)), day(rng.randint(2, 28))]), rng.choice([None, *(day(n) for n in range(1, 28))])) for _ in range(45)]
    refs = [ref(n, rng.choice(["a", "b", "b(int)", "b(char)", "::c::d", "e", "x"]), seen=rng.randint(1, 28), arrived=rng.randint(1, 28)) for n in range(120)]
    refs += [(*r[:5], day(rng.randint(1, 28)), "copy") for r in refs[:30]] + [(*ref(500, "a", seen=9)[:5], None, "x")]
    latest = {}
    for key, since, until, at in symbols:
        latest[key, since] = max(latest.get((key, since), ()), (at or T(1, 1, 1), until or T(9999, 1, 1)))
    live = lambda key, seen: any(k == key and since <= seen < until for (k, since), (_, until) in latest.items())
    bare = lambda t: t.removeprefix("::")
    want = {r[1] for r in refs if not (live(bare(r[2]), r[4]) or live(bare(r[2]).split("(")[0], r[4]))}
    monkeypatch.setattr(orphans, "MAX_LOGS", 3)
    r, p = tables(spark, refs=refs, entities=[("e", day(1))], symbols=symbols)
    for steps in (1, 2, 5):
        got = orphans.track(spark, r, p, steps)
        pending, resolved = ([x["pos"] for x in df.where("ref_field = 'target'").collect()] for df in (got.state.pending, got.state.resolved))
        assert set(pending) == want and len(pending) == len(want), steps
        assert set(resolved) == {x[1] for x in refs} - want and len(resolved) == len(set(resolved))
    assert len(got.state.logs) < 4 and got.vacuum() > 0 and got.state.pending.where("ref_field = 'target'").count() == len(want)


def test_shortened_life_reopens_and_the_join_is_by_key(spark):
    refs, none = tables(spark, refs=[ref(n, f"k{n}", seen=8) for n in range(20)], entities=[("e", day(1))])
    t = orphans.OrphanTracker(spark)
    parents = lambda until, arrived: tables(spark, symbols=[(f"k{n}", day(1), day(until), day(arrived)) for n in range(20)])[1]
    t.step(refs, none.unionByName(parents(20, 2)))
    assert t.state.pending.count() == 0 and t.state.resolved.count() == 40
    t.step(refs.limit(0), parents(5, 3).where("key = 'k3'"), count=True)
    assert [r["keys"] for r in t.state.pending.collect()] == [["k3"]] and t.state.resolved.count() == 39 and t.snapshots[0].collect()[0]["orphans"] == 1
    assert len(t._touched(t._path("refs", "2"))) == 1  # only the bucket of k3 was written
    shortened = spark.createDataFrame([("symbol", "k3", day(5), 1 << 60)], "space string, key string, live_to timestamp_ntz, _before bigint")
    text = t._reopened(t.state.logs, [1, 2], shortened)._jdf.queryExecution().executedPlan().toString()
    join = next(x for x in text.split("\n") if "Join" in x and "key" in x and "_salt" in x)
    assert "space" in join and "PartitionFilters: [isnotnull(bucket" in text or "bucket#" in text.split("PartitionFilters")[1][:200]
    t.step(refs.limit(0), parents(25, 4).where("key = 'k3'"))
    assert t.state.pending.count() == 0
