import random

import numpy as np
import pytest

from marginalia.llm import encode, queries

tokenizers = pytest.importorskip("tokenizers")
KINDS = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def tools(spark):
    path = queries.tokenizer_path(spark)
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return encode.Vocabulary(path), lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_vocabulary_tokens_encode_to_themselves(tools):
    v, _ = tools
    assert v.sound == set(v.ids.values())
    some = random.Random(1).sample(list(v.ids), 2000)
    assert all(v.merged(b) == [v.ids[b]] for b in some)


def test_pair_test_is_exact(tools):
    v, _ = tools
    r = random.Random(2)
    tokens = {i: b for b, i in v.ids.items()}
    keys = list(tokens)
    pairs = [(r.choice(keys), r.choice(keys)) for _ in range(3000)] + [(a, b) for a in r.sample(keys, 60) for b in r.sample(range(256), 40)]
    a, b = np.array(pairs).T
    want = [v.merged(tokens[x] + tokens[y]) == [x, y] for x, y in pairs]
    assert v.beside(a, b).tolist() == want


def test_every_code_point(tools):
    v, reference = tools
    e = encode.Encoder(v)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)}\n" for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    assert e.encode(texts) == reference(texts)


def test_odd_and_long_texts(tools):
    v, reference = tools
    r = random.Random(3)
    texts = [None, "", " ", "\r\n \t\n x", "<|endoftext|> x<|endoftext|>", "a" * 9000, "ab" * 9000, " " * 4000 + "x", "中" * 4000, "can't, we'll I'D ＡＢ１２ ﬁ é ​﻿"]
    texts += ["".join(r.choice("abcdeth nigsor EATIN.\n\té中рあ\U0001f680'sre") for _ in range(r.randrange(1, 300))) for _ in range(800)]
    e = encode.Encoder(v)
    assert e.encode(texts) == reference(texts)
    assert 0 < e.exact


def test_rows(spark, tools):
    _, reference = tools
    rows = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x"), (None, "naïve", "x")]
    got = encode.encode(spark.createDataFrame(rows, KINDS), queries.tokenizer_path(spark)).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in got) == sorted((str(a), i) for (a, _, _), i in zip(rows, reference([t for _, t, _ in rows])))
    assert encode.encode(spark.createDataFrame([], KINDS), queries.tokenizer_path(spark)).collect() == []
