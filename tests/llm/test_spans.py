import random
from collections import defaultdict

import numpy as np

from marginalia.llm import spans


def brute(texts, span):
    own = defaultdict(set)
    for e, x in texts.items():
        for k in range(len(x or "") - span + 1):
            own[x[k : k + span]].add(e)
    out = set()
    for e, x in texts.items():
        run = None
        for k in range(len(x or "") - span + 1):
            if len(own[x[k : k + span]]) > 1:
                if run and k <= run[1]:
                    run[1] = k + span
                else:
                    out |= {(e, *run)} if run else set()
                    run = [k, k + span]
        out |= {(e, *run)} if run else set()
    return out


def found(spark, texts, span, k, **options):
    df = spark.createDataFrame(list(texts.items()), "entity_id string, text string")
    got = [tuple(r) for r in spans.rows(spans.shared_spans(df, span, k, **options)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def corpus(seed):
    r = random.Random(seed)
    noise = lambda n: "".join(r.choice("abcdef é中\U0001f680") for _ in range(n))
    passages = [noise(r.randrange(15, 70)) for _ in range(8)]
    texts = {}
    for n in range(120):
        parts = [noise(r.randrange(0, 30))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            a = r.randrange(0, 10)
            parts += [p[a : len(p) - r.randrange(0, 10)], noise(r.randrange(0, 20))]
        texts[f"e{n}"] = "".join(parts)
    hot = noise(40)
    for n in range(80):  # a passage in a large part of all texts, in changing surroundings
        texts[f"h{n}"] = noise(r.randrange(0, 25)) + hot + noise(r.randrange(0, 25))
    for n in range(60):
        texts[f"s{n}"] = "the very same text in many records, " * 2
    texts |= {"null": None, "empty": "", "short": "abc", "loop": noise(21) * 3, "period": "ab" * 40, "period2": "ab" * 30 + "x", "ones": "a" * 90, "ones2": "b" + "a" * 70}
    return texts


def test_against_brute_force(spark):
    for seed, span, k in ((1, 20, 12), (2, 24, 24)):
        texts = corpus(seed)
        want = brute(texts, span)
        assert found(spark, texts, span, k) == want
    assert found(spark, texts, span, k, many=2) == want  # runs joined by hash


def test_texts_longer_than_a_part(spark, monkeypatch):
    letters = np.random.default_rng(7).integers(97, 105, 10_000_000).astype(np.uint8).tobytes().decode()
    cut = spans.CHARS
    texts = {"a": letters, "b": "x" * 50 + letters[7_000_000:7_000_400], "c": letters[:300], "d": letters[cut - 100 : cut + 100] + "y", "e": letters[-170:]}
    want = {("a", 0, 300), ("a", cut - 100, cut + 100), ("a", 7_000_000, 7_000_400), ("a", 9_999_830, 10_000_000), ("b", 50, 450), ("c", 0, 300), ("d", 0, 200), ("e", 0, 170)}
    assert found(spark, texts, spans.SPAN, spans.K) == want


def test_parts_give_the_anchors_of_the_whole(monkeypatch):
    r = random.Random(3)
    texts = ["".join(r.choice("abcd") for _ in range(n)) for n in (700, 90, 161, 160, 159, 3000)]
    whole = {tuple(map(int, row)) for part in spans.seeds_of(texts, 30, 20) for row in zip(*part)}
    monkeypatch.setattr(spans, "CHARS", 97)
    assert {tuple(map(int, row)) for part in spans.seeds_of(texts, 30, 20) for row in zip(*part)} == whole and whole


def test_long_text_and_no_rows(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefgh") for _ in range(150_000))
    texts = {"a": long, "b": "x" * 50 + long[70_000:70_400], "c": long[:300]}
    assert found(spark, texts, spans.SPAN, spans.K) == brute(texts, spans.SPAN)
    assert found(spark, {}, spans.SPAN, spans.K) == set()


def test_rolling_hash_and_anchors():
    x = np.array([ord(c) for c in "abcabcabcx" * 5], np.uint64)
    h = spans.rolling(x, 6, 0)
    same = {tuple(x[i : i + 6]): h[i] for i in range(len(h))}
    assert all(h[i] == same[tuple(x[i : i + 6])] for i in range(len(h))) and len(set(same.values())) == len(same)
    at = spans.anchors(h, 7)
    assert np.diff(at).max() <= 7 and at[0] <= 6 and at[-1] >= len(h) - 7


def test_entity_texts(spark):
    doc = "struct<raw:string,details:string>"
    from datetime import datetime as T

    rows = [("a", ("r", None), T(2024, 1, 1)), ("a", ("r", None), T(2024, 1, 2)), ("b", ("r", "d"), T(2024, 1, 1)), ("c", None, T(2024, 1, 1)), ("d", ("r", ""), T(2024, 1, 1)), (None, ("r", "d"), T(2024, 1, 1))]
    got = spans.texts_of(spark.createDataFrame(rows, f"entity_id string, doc {doc}, ingested_at timestamp_ntz")).collect()
    assert {tuple(r) for r in got} == {("a", "r"), ("b", "d"), ("c", None), ("d", "")}


def test_text_of_an_entity_without_time_of_arrival(spark):
    rows = [("a", ("only", None), None), ("b", ("old", None), None), ("b", ("new", None), "2024-01-01")]
    df = spark.createDataFrame(rows, "entity_id string, doc struct<details: string, raw: string>, ingested_at string")
    assert {tuple(r) for r in spans.texts_of(df).collect()} == {("a", "only"), ("b", "new")}
