import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import leaks


def brute(docs, items):
    runs = lambda t: {tuple(w[k : k + leaks.PASSAGE]) for w in [leaks.words(t)] for k in range(len(w) - leaks.PASSAGE + 1)}
    held = [(i, runs(t)) for i, t in items]
    return {(d, i) for d, t in docs for own in [runs(t)] for i, r in held if own & r}


def distance(pattern, text):
    """Least edit distance to any part of the text, by the textbook recurrence."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 3), min_size=12, max_size=12), st.lists(st.integers(1, 3), min_size=14, max_size=14)), min_size=1, max_size=8))
def test_bit_parallel_distance(pairs):
    got = leaks.distances(np.array([p for p, _ in pairs]), np.array([t for _, t in pairs]))
    assert got.tolist() == [distance(p, t) for p, t in pairs]


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string, split string, doc_id bigint")


def test_against_brute_force(spark):
    item = [f"w{k}" for k in range(40)]
    other = ["same"] * 30
    say = " ".join
    items = [(1, say(item)), (2, say(other)), (3, "short text"), (4, None), (5, ""), (6, say(item[5:25])), (1, say(item))]
    changed = item[:20].copy()
    changed[6] = "x"
    docs = [
        (10, say(item[10:22])), (11, say(item[10:21])), (12, say(item[:6] + ["x"] + item[6:12])), (13, "-_- ".join(x.upper() for x in item[3:16]) + "\r\n"), (14, None), (15, ""), (16, " \t"),
        (17, say(["pad"] * 5000 + item[20:40] + ["pad"] * 5000)), (18, say(other[:12])), (19, say(other[:11])), (20, say(changed)), (10, say(item[10:22])), (21, say(item[:11] + item[12:24])), (22, "same " * 20000),
    ]
    d, i = frames(spark, docs, [(a, t, "test", 9) for a, t in items])
    want = brute(docs, [x for x in items])
    for options in ({}, {"block_chars": 40}):
        got = [tuple(r) for r in leaks.exact(leaks.leaks(d, i, **options)).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    near = {(r["doc_id"], r["item_id"]): r["distance"] for r in leaks.leaks(d, i).collect()}
    assert near[11, 1] == 1 and near[12, 1] == 1 and near[10, 1] == 0 and (19, 2) in near


def test_no_rows(spark):
    d, i = frames(spark, [(1, "a " * 20)], [])
    assert leaks.leaks(d, i).collect() == []
    d, i = frames(spark, [], [(1, "a " * 20, "test", 1)])
    assert leaks.leaks(d, i).collect() == []


def test_test_tables(spark):
    base = "/root/testdata/sf0.01"
    d, i = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/eval_items.parquet")
    docs = [(r["doc_id"], r["text"]) for r in d.collect()]
    assert {tuple(r) for r in leaks.exact(leaks.leaks(d, i)).collect()} == brute(docs, [(r["item_id"], r["text"]) for r in i.collect()])


def test_both_forms_give_the_same_rows_and_find_short_items(spark):
    item = [f"w{k}" for k in range(30)]
    say = " ".join
    items = [(1, say(item), "test", 0), (2, "Short text", "test", 0), (3, "w7", "test", 0), (4, say(item[3:14]), "test", 0), (5, "a b a b a b a b a b a b a b a b", "test", 0), (6, "_ - _", "test", 0)]
    docs = [
        (1, "a short; TEXT"), (2, "short of text"), (3, say(item[2:15])), (4, say(item[:6] + ["x"] + item[6:20])), (5, say(item[18:])), (6, "a b " * 40), (7, say(item[1:12])), (8, ""), (9, None), (10, "short text short text"),
        (11, say(["z"] + item[1:])), (12, say(item[:12] + ["q"] * 30 + item[12:])), (3, say(item[2:15])),
    ]
    d, i = frames(spark, docs, items)
    one, two = (sorted(tuple(r) for r in leaks.leaks(d, i, block_chars=n).collect()) for n in (1 << 20, 1))
    assert one == two
    pairs = {(r[0], r[1]) for r in one}
    assert {p for p in pairs if p[1] == 2} == {(1, 2), (10, 2)} and (3, 4) in pairs and (7, 4) not in pairs and (3, 3) in pairs and (2, 2) not in pairs
    assert {(r[0], r[1]) for r in one if r[1] == 1} >= {(3, 1), (4, 1), (5, 1), (11, 1), (12, 1)}
    assert not {r["item_id"] for r in leaks.exact(leaks.leaks(d, i)).collect()} & {2, 3, 4, 6}


def test_leaks_of_the_test_tables_in_both_forms(spark):
    base = "/root/testdata/sf0.001"
    d, i = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/eval_items.parquet")
    one, two = (sorted(tuple(r) for r in leaks.leaks(d, i, block_chars=n).collect()) for n in (1 << 30, 1))
    assert one == two and one
