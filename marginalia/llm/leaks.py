"""Evaluation texts leaking into training text: pigeonhole edit matching.

Each test item is taken passage by passage (PASSAGE words). With an error budget of ERRORS word edits a passage is
split into ERRORS + 1 pieces, at least one of which must stand unchanged in any text within the budget. Documents
are searched for exact hits of the pieces; each hit is verified with Myers' bit-parallel edit distance, for all
hits of a batch at once. Words are the longest runs of letters and digits, compared in lower case. An item of fewer words
is one passage; its budget shrinks in proportion, below a whole error, so it must stand there word for word.

Items up to BLOCK_CHARS characters go to all tasks as one index. More of them are joined instead: the pieces of all
passages with the runs of words of all documents that a filter of fixed size lets through, by equal hashes; what meets
is verified in the same way. In both forms the documents are read once, and the rows are the same.

Defined results: null, empty and blank texts hold nothing; an item without a word can't be found; items or documents
given twice give a pair once; a passage may stand anywhere in a text of any length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import hot_keys, materialize, salt_left, salt_right

PASSAGE, ERRORS = 12, 1
#: Characters of items that go to the tasks as one index; a larger item table is joined.
BLOCK_CHARS = 8_000_000
#: Bits of the filter of pieces, for the join.
FILTER_BITS, CHUNK_BITS = 1 << 28, 1 << 19
#: Words of documents handled at a time.
CHUNK = 200_000
LEAKS = "doc_id bigint, item_id bigint, passages int, exact_passages int, distance int, item_words int, covered_words int, doc_word int, item_word int, run int"
_WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text)] if text else []


def distances(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edit distance of each pattern (rows of word numbers, at most 63) to any part of its text; word 0 equals nothing."""
    n, m = patterns.shape
    bits = np.uint64(1) << np.arange(m, dtype=np.uint64)
    full = np.uint64((1 << m) - 1)
    top = np.uint64(1 << (m - 1))
    up, down = np.full(n, full), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int32)
    best = score.copy()
    for j in range(texts.shape[1]):
        same = (patterns == texts[:, j : j + 1]) & (texts[:, j : j + 1] != 0)
        eq = (same * bits).sum(1, dtype=np.uint64)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus = down | ~(xh | up)
        minus = up & xh
        score += ((plus & top) != 0).astype(np.int32) - ((minus & top) != 0).astype(np.int32)
        plus = (plus << np.uint64(1)) & full
        minus = (minus << np.uint64(1)) & full
        up = (minus | ~(xv | plus)) & full
        down = plus & xv
        best = np.minimum(best, score)
    return best


class Items:
    """A block of items with the index of their pieces."""

    def __init__(self, rows: list[tuple[int, str]], passage: int = PASSAGE, errors: int = ERRORS):
        self.passage, self.errors = passage, errors
        self.piece = passage // (errors + 1)
        self.numbers: dict[str, int] = {}
        self.ids, self.words, self.starts = [], [], [0]
        short: dict[int, list[tuple[int, list[int]]]] = {}
        for item_id, text in rows:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)]
            if len(own) >= passage:
                self.ids.append(item_id)
                self.words += own
                self.starts.append(len(self.words))
            elif own:
                short.setdefault(len(own), []).append((item_id, own))
        #: By number of words: hashes of whole items in order, their words and their ids.
        self.short: dict[int, tuple[np.ndarray, np.ndarray, list[int]]] = {}
        for m, items in short.items():
            w = np.array([x for _, x in items], np.int64)
            h = self.hashes(w.reshape(-1), m)[::m]
            order = np.argsort(h, kind="stable")
            self.short[m] = (h[order], w[order], [items[k][0] for k in order])
        self.words = np.array(self.words, np.int64)
        self.starts = np.array(self.starts, np.int64)
        grams = self.hashes(self.words)
        at = np.arange(len(grams))
        owner = np.searchsorted(self.starts, at, "right") - 1
        whole = at + self.piece <= self.starts[owner + 1] if len(at) else np.zeros(0, bool)
        order = np.argsort(grams[whole], kind="stable")
        self.keys, self.places = grams[whole][order], at[whole][order]

    def hashes(self, w: np.ndarray, length: int | None = None) -> np.ndarray:
        """A number for each run of ``length`` words, of ``piece`` else."""
        length = length or self.piece
        n = len(w) - length + 1
        h = np.zeros(max(0, n), np.uint64)
        for k in range(length):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + max(0, n)].astype(np.uint64)
            h ^= h >> np.uint64(31)
        return h

    def search(self, docs: list[tuple[int, list[str]]]) -> list[tuple]:
        """A row for each document and item within the budget."""
        gap = self.passage + 2 * self.errors
        parts, starts, at = [], [], gap
        get = self.numbers.get
        for _, ws in docs:
            starts.append(at)
            parts += [np.zeros(gap, np.int64), np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))]
            at += len(ws) + gap
        if not (len(self.keys) or self.short) or not parts:
            return []
        text = np.concatenate([*parts, np.zeros(gap, np.int64)])
        starts = np.array(starts)
        known = np.r_[0, np.cumsum(text == 0)]
        out = self._whole(text, starts, known, docs)
        if not len(self.keys):
            return out
        h = self.hashes(text)
        spots = np.flatnonzero(known[self.piece :] - known[: -self.piece] == 0)
        lo = np.searchsorted(self.keys, h[spots], "left")
        hi = np.searchsorted(self.keys, h[spots], "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return out
        rows: dict[tuple[int, int], list] = {}
        times = hi[hit] - lo[hit]
        # A piece that stands in many items gives that many candidates: they are verified in portions.
        portion = np.searchsorted(np.cumsum(times), np.arange(0, int(times.sum()), 500_000), "left")
        for a, b in zip(portion, [*portion[1:], len(hit)]):
            part = hit[a:b]
            if not len(part):
                continue
            t = hi[part] - lo[part]
            place = self.places[np.repeat(lo[part] - np.r_[0, np.cumsum(t)[:-1]], t) + np.arange(int(t.sum()))]
            spot = np.repeat(spots[part], t)
            self._verify(text, starts, spot, place, rows)
        for (d, i), (exact, near, least, covered, first) in rows.items():
            size = int(self.starts[i + 1] - self.starts[i])
            mask = np.zeros(size, bool)
            for p in covered:
                mask[p : p + self.passage] = True
            edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
            out.append((docs[d][0], self.ids[i], len(near), len(exact), int(least), size, int(mask.sum()), int(first[0]), int(first[1]), int((edges[1::2] - edges[::2]).max())))
        return out

    def _whole(self, text: np.ndarray, starts: np.ndarray, known: np.ndarray, docs: list) -> list[tuple]:
        """A row for each document that holds the whole of an item shorter than a passage, at the first place."""
        out = []
        for m, (keys, items, ids) in self.short.items():
            spots = np.flatnonzero(known[m:] - known[:-m] == 0)
            h = self.hashes(text, m)[spots]
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            hit = np.flatnonzero(hi > lo)
            times = hi[hit] - lo[hit]
            item = np.repeat(lo[hit] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(int(times.sum())) if len(hit) else np.zeros(0, np.int64)
            spot = np.repeat(spots[hit], times)
            same = (text[spot[:, None] + np.arange(m)] == items[item]).all(1) if len(spot) else np.zeros(0, bool)
            spot, item = spot[same], item[same]
            doc = np.searchsorted(starts, spot, "right") - 1
            _, first = np.unique(np.stack([doc, item]), axis=1, return_index=True)
            out += [(docs[doc[n]][0], ids[item[n]], 1, 1, 0, m, m, int(spot[n] - starts[doc[n]]), 0, m) for n in first]
        return out

    def _verify(self, text, starts, spot, place, rows) -> None:
        owner = np.searchsorted(self.starts, place, "right") - 1
        cand = []
        for k in range(self.errors + 1):  # the piece as the k-th of its passage
            p, q = place - k * self.piece, spot - k * self.piece
            ok = (p >= self.starts[owner]) & (p + self.passage <= self.starts[owner + 1])
            cand.append(np.stack([q[ok], p[ok], owner[ok]]))
        q, p, owner = np.unique(np.concatenate(cand, 1), axis=1)
        wide = np.arange(-self.errors, self.passage + self.errors)
        for a in range(0, len(q), 100_000):
            qs, ps, os_ = q[a : a + 100_000], p[a : a + 100_000], owner[a : a + 100_000]
            pattern = self.words[ps[:, None] + np.arange(self.passage)]
            around = text[np.clip(qs[:, None] + wide, 0, len(text) - 1)]
            far = distances(pattern, around)
            exact = (pattern == around[:, self.errors : self.errors + self.passage]).all(1)
            for n in np.flatnonzero(far <= self.errors):
                d = int(np.searchsorted(starts, qs[n] + self.passage - 1, "right") - 1)
                i, local = int(os_[n]), int(ps[n] - self.starts[os_[n]])
                row = rows.setdefault((d, i), [set(), set(), self.errors + 1, set(), (1 << 31, 0)])
                row[1].add(local)
                if exact[n]:
                    row[0].add(local)
                row[2] = min(row[2], int(far[n]))
                row[3].add(local)
                row[4] = min(row[4], (max(0, int(qs[n] - starts[d])), local))


def _searcher(items: Items):
    types = {"bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in LEAKS.split(", ")])

    def rows_of(docs):
        rows = items.search(docs)
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(text)
                if ws:
                    docs.append((doc_id, ws))
                    size += len(ws)
                if size > CHUNK:
                    out = rows_of(docs)
                    if out is not None:
                        yield out
                    docs, size = [], 0
        out = rows_of(docs) if docs else None
        if out is not None:
            yield out

    return run


def _item_pieces(passage: int, errors: int):
    """(piece, item_id, words) of each passage of items (item_id, text): the hash of each piece of it, the whole passage, its place and the item's size."""
    size = passage // (errors + 1)
    schema = pa.schema([("piece", pa.int64()), ("nth", pa.int32()), ("item_id", pa.int64()), ("at", pa.int32()), ("item_words", pa.int32()), ("words", pa.string())])

    def run(batches):
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws, rows = words(text), []
                if 0 < len(ws) < passage:
                    rows = [(_hash(ws), -1, item_id, 0, len(ws), " ".join(ws))]
                for at in range(len(ws) - passage + 1):
                    part = ws[at : at + passage]
                    rows += [(_hash(part[k * size : (k + 1) * size]), k, item_id, at, len(ws), " ".join(part)) for k in range(errors + 1)]
                for start in range(0, len(rows), 50_000):
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[start : start + 50_000]), schema)], schema=schema)

    return run, "piece bigint, nth int, item_id bigint, at int, item_words int, words string"


def _hash(ws: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(ws).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _doc_pieces(passage: int, errors: int, lengths: list[int], bits: np.ndarray):
    """(piece, doc_id, at, around) of each run of words of documents that the filter lets through, with the words about it that a passage could cover."""
    size = passage // (errors + 1)
    reach = passage - size + errors
    schema = pa.schema([("piece", pa.int64()), ("length", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int32()), ("lead", pa.int32()), ("around", pa.string())])
    mask = len(bits) * 8 - 1

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ws = words(text)
                for length in lengths:
                    for at in range(len(ws) - length + 1):
                        h = _hash(ws[at : at + length])
                        if bits[(h & mask) >> 3] >> (h & 7) & 1:
                            low = max(0, at - reach)
                            rows.append((h, length, doc_id, at, at - low, " ".join(ws[low : at + length + reach])))
                    if len(rows) > 50_000:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run, "piece bigint, length int, doc_id bigint, at int, lead int, around string"


def _filter_part(table: pa.Table) -> pa.Table:
    at = table.column("_b").to_numpy()
    marks = np.zeros(CHUNK_BITS, np.uint8)
    marks[at % CHUNK_BITS] = 1
    return pa.table({"_c": pa.array([int(at[0] // CHUNK_BITS)], pa.int32()), "bits": pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())})


MET = "doc_id bigint, item_id bigint, item_words int, item_at int, doc_at int, distance int, exact boolean"


def _met(passage: int, errors: int):
    """Verifies passages of items against the words about their pieces in documents, with Myers' distance for a batch at once."""
    size = passage // (errors + 1)
    wide = passage + 2 * errors
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("item_at", pa.int32()), ("doc_at", pa.int32()), ("distance", pa.int32()), ("exact", pa.bool_())])

    def run(batches):
        for batch in batches:
            rows, patterns, texts, kept = [], [], [], []
            for doc_id, at, lead, around, nth, item_id, item_at, item_words, told in zip(*(batch.column(c).to_pylist() for c in range(9))):
                ws, item = around.split(" "), told.split(" ")
                if nth < 0:
                    if ws[lead : lead + len(item)] == item:
                        rows.append((doc_id, item_id, item_words, 0, at, 0, True))
                    continue
                if ws[lead : lead + size] != item[nth * size : (nth + 1) * size]:
                    continue
                numbers: dict[str, int] = {}
                pattern = [numbers.setdefault(w, len(numbers) + 1) for w in item]
                begin = lead - nth * size
                padded = [0] * max(0, errors - begin) + [numbers.get(w, 0) for w in ws[max(0, begin - errors) : begin + passage + errors]]
                patterns.append(pattern)
                texts.append((padded + [0] * wide)[:wide])
                kept.append((doc_id, item_id, item_words, item_at, at - nth * size))
            if kept:
                p, t = np.array(patterns, np.int64), np.array(texts, np.int64)
                far, same = distances(p, t), (p == t[:, errors : errors + passage]).all(1)
                rows += [(*k, int(d), bool(e)) for k, d, e in zip(kept, far, same) if d <= errors]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _joined(documents: DataFrame, items: DataFrame, passage: int, errors: int) -> DataFrame:
    """The rows of LEAKS by a join of pieces; hot pieces are dealt over several tasks. The documents are read once."""
    spark = items.sparkSession
    run, ddl = _item_pieces(passage, errors)
    pieces = materialize(items.mapInArrow(run, ddl), "leaks-pieces")
    lengths = sorted({passage // (errors + 1), *(r[0] for r in pieces.where("nth < 0").select("item_words").distinct().collect())})  # no more than a passage has words
    # The filter has a fixed size whatever the number of items: FILTER_BITS, put together in parts of CHUNK_BITS.
    spot = pieces.select(F.col("piece").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("_b")).distinct()
    parts = spot.groupBy((F.col("_b") / CHUNK_BITS).cast("int").alias("_c")).applyInArrow(_filter_part, "_c int, bits binary")
    bits = np.zeros(FILTER_BITS >> 3, np.uint8)
    for r in parts.toLocalIterator():
        bits[r["_c"] * (CHUNK_BITS >> 3) : (r["_c"] + 1) * (CHUNK_BITS >> 3)] = np.frombuffer(r["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def search(batches):
        return _doc_pieces(passage, errors, lengths, shared.value)[0](batches)

    spots = materialize(documents.mapInArrow(search, _doc_pieces(passage, errors, lengths, bits[:1])[1]), "leaks-spots")
    hot = hot_keys(spots, ["piece"])
    told = pieces.where("nth >= 0").select("piece", "nth", "item_id", F.col("at").alias("item_at"), "item_words", "words", F.lit(passage // (errors + 1)).alias("length"))
    told = told.unionByName(pieces.where("nth < 0").select("piece", "nth", "item_id", F.col("at").alias("item_at"), "item_words", "words", F.col("item_words").alias("length")))
    met = salt_left(spots, ["piece"], hot, ["doc_id", "at"]).join(salt_right(told, ["piece"], hot), ["piece", "length", "_salt"]).select("doc_id", "at", "lead", "around", "nth", "item_id", "item_at", "item_words", "words")
    found = met.mapInArrow(_met(passage, errors), MET)
    by = found.groupBy("doc_id", "item_id", "item_words").agg(
        F.collect_set("item_at").alias("_at"), F.count_distinct(F.when(F.col("exact"), F.col("item_at"))).cast("int").alias("exact_passages"), F.min("distance").alias("distance"), F.min(F.struct(F.greatest("doc_at", F.lit(0)).alias("d"), F.col("item_at").alias("i"))).alias("_f"),
    )  # fmt: skip  # no more places than an item has words
    length = F.least(F.col("item_words"), F.lit(passage))
    covered = F.array_distinct(F.flatten(F.transform("_at", lambda a: F.sequence(a, a + length - 1))))
    runs = F.aggregate(F.array_sort("_at"), F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0).alias("top")), lambda acc, x: F.struct(
        F.when(x <= acc["b"], acc["a"]).otherwise(x).alias("a"), (x + length).alias("b"), F.greatest(acc["top"], x + length - F.when(x <= acc["b"], acc["a"]).otherwise(x)).alias("top")), lambda acc: acc["top"])
    return by.select("doc_id", "item_id", F.size("_at").alias("passages"), "exact_passages", "distance", "item_words", F.size(covered).alias("covered_words"), F.col("_f.d").alias("doc_word"), F.col("_f.i").alias("item_word"), runs.alias("run"))


def leaks(documents: DataFrame, items: DataFrame, passage: int = PASSAGE, errors: int = ERRORS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item that share a passage within the budget: how many, how near, how much of the item.

    Items are a stated set of queries against all documents. Their size is measured first: up to ``block_chars`` characters they
    go to the tasks, beyond that they are joined. The documents are read once in both cases."""
    own = items.select("item_id", "text").where(F.col("text").isNotNull()).distinct()
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    total = own.agg(F.sum(F.length("text"))).first()[0] or 0
    if total > block_chars:
        return _joined(texts, own, passage, errors)
    rows = sorted((r["item_id"], r["text"]) for r in own.collect())
    return texts.mapInArrow(_searcher(Items(rows, passage, errors)), LEAKS).distinct()


def exact(found: DataFrame) -> DataFrame:
    """Documents and items that share a whole passage of PASSAGE words word for word."""
    return found.where((F.col("exact_passages") > 0) & (F.col("item_words") >= PASSAGE)).select("doc_id", "item_id").distinct()
