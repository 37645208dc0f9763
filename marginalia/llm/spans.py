"""Long exact spans shared between records: seed and extend.

Seeds are winnowed anchors: of every SPAN - K + 1 neighbouring runs of K characters the one with the least hash, so
two equal runs of SPAN characters have an anchor in common. Records are joined on anchors; an anchor that stands in
one record only ends there. At each other anchor the text around it, as far as a run of SPAN characters that holds the
anchor can reach, is its context: equal contexts are one, and one that several records have is shared as it is. Where an
anchor has several contexts, each that only one record has is extended against each of the others: character by character
to the left and to the right, and what agrees is kept if it is long enough. Kept pieces are put together into maximal spans.

An anchor may stand in a third of all records. So no pairs of records are made, only pairs of distinct contexts, and
where one anchor has more than MANY of them not these either: there the runs of SPAN characters of the contexts are
joined by hash, and runs that meet are compared character by character. The rows are the same. Equal texts form a class
that is searched once.

Defined results: an entity's text is that of its row that arrived last, a null time of arrival being the earliest; null, empty and shorter texts share
nothing; repeats within one entity don't count; offsets are in code points; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.runtime import forget, hot_keys, materialize, salt_left, salt_right

SPAN, K = 160, 100
#: Distinct contexts of an anchor that are compared pair by pair; with more of them runs are joined instead.
MANY = 64
#: Characters hashed at a time; a longer text is taken in parts that overlap.
CHARS = 1 << 20
#: Multipliers of the two rolling hashes (odd), and of the mixers.
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
MIX = (0x9E3779B97F4A7C15, 0xE7037ED1A0B428DB)


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(by)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


class Sums:
    """Sums of powers modulo 2^64 over a text, from which every run of it can be hashed."""

    def __init__(self, code: np.ndarray, which: int):
        n, base = len(code), BASES[which]
        powers = np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), base, np.uint64)])[:n]
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)])
        self.sums = np.r_[np.uint64(0), np.cumsum(_mixed(code + np.uint64(1), MIX[which]) * powers)]
        self.by = MIX[1 - which]

    def runs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the runs from ``a`` to ``b``."""
        return _mixed((self.sums[b] - self.sums[a]) * self.back[a], self.by)


def rolling(code: np.ndarray, length: int, which: int) -> np.ndarray:
    """Hash of every run of ``length`` characters."""
    n = len(code) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = Sums(code, which)
    return _mixed((sums.sums[length:] - sums.sums[:-length]) * sums.back[:n], sums.by)


def rolling_all(texts: list[np.ndarray], length: int, which: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for many texts at once: hashes, the number of the text of each, and its place there."""
    sizes = np.array([len(t) for t in texts], np.int64)
    code = np.concatenate(texts) if texts else np.zeros(0, np.uint64)
    h = rolling(code, length, which)
    own = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
    ends = np.cumsum(sizes)
    at = np.arange(len(h))
    inside = at + length <= ends[own] if len(h) else np.zeros(0, bool)
    return h[inside], own[inside], at[inside] - (ends - sizes)[own[inside]]


def anchors(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash in every window, of equal ones the leftmost."""
    return anchors_all(hashes, np.zeros(len(hashes), np.int64), window)


def anchors_all(hashes: np.ndarray, own: np.ndarray, window: int) -> np.ndarray:
    """The same for hashes of many texts; no window reaches over the end of a text."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    whole = own[window - 1 :] == own[: len(own) - window + 1]
    out = []
    step = 1 << 16
    for a in range(0, len(whole), step):
        starts = np.flatnonzero(whole[a : a + step])
        if len(starts):
            view = np.lib.stride_tricks.sliding_window_view(hashes[a : a + step + window - 1], window)
            out.append(np.unique(view.argmin(1)[starts] + starts + a))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


SEEDS = "anchor bigint, class_id string, at int, cut int, c1 bigint, c2 bigint"
_KEY = ["anchor", "cut", "c1", "c2"]


def _portions(part: pa.RecordBatch) -> Iterator[tuple[list[int], list[str], list[int]]]:
    """Numbers, texts and beginnings of the rows, up to about CHARS characters at a time; a longer text is one portion."""
    numbers, texts, size = [], [], 0
    for n, text in enumerate(part.column(1).to_pylist()):
        if numbers and size + len(text) > CHARS:
            yield numbers, texts
            numbers, texts, size = [], [], 0
        numbers.append(n)
        texts.append(text)
        size += len(text)
    if numbers:
        yield numbers, texts


def seeds_of(texts: list[str], span: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each text the anchors: hash, number of the text, place, and of the context how far it reaches and its hashes.

    ``cut`` is the reach to the left times 2^15 plus that to the right, both less than SPAN; at a text's end it is cut short."""
    reach = span - k
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    code = codes("".join(texts)) if len(texts) > 1 else codes(texts[0])
    for low in range(0, len(code), CHARS):
        # Windows that begin in this part, with what their anchors' contexts may reach.
        a, b = max(0, low - reach), min(len(code), low + CHARS + 2 * span)
        part = code[a:b]
        first, second = Sums(part, 0), Sums(part, 1)
        n = len(part) - k + 1
        if n <= 0:
            continue
        h = _mixed((first.sums[k:] - first.sums[:-k]) * first.back[:n], first.by)
        own = np.searchsorted(ends, np.arange(a, a + n), "right")
        inside = np.flatnonzero(np.arange(a, a + n) + k <= ends[own])
        inside = inside[(inside + a >= low) & (inside + a < low + CHARS + reach)]
        at = inside[anchors_all(h[inside], own[inside], reach + 1)]
        if not len(at):
            continue
        text = own[at]
        left = np.minimum(reach, at + a - begins[text])
        right = np.minimum(reach, ends[text] - (at + a + k))
        yield h[at], text, at + a - begins[text], left << 15 | right, first.runs(at - left, at + k + right), second.runs(at - left, at + k + right)


def _seeds(span: int, k: int):
    schema = pa.schema([("anchor", pa.int64()), ("class_id", pa.string()), ("at", pa.int32()), ("cut", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, texts in _portions(batch):
                for h, text, at, cut, c1, c2 in seeds_of(texts, span, k):
                    ids = batch.column(0).take(pa.array(np.array(numbers)[text]))
                    yield pa.record_batch([pa.array(h.view(np.int64)), ids, pa.array(at.astype(np.int32)), pa.array(cut.astype(np.int32)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64))], schema=schema)

    return run


CONTEXTS = "anchor bigint, cut int, c1 bigint, c2 bigint, low string, several boolean, contexts bigint, context string"


def _cut_out(k: int):
    """The contexts that one text stands for: rows of CONTEXTS from text and the places that are asked for."""
    schema = pa.schema([("anchor", pa.int64()), ("cut", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("low", pa.string()), ("several", pa.bool_()), ("contexts", pa.int64()), ("context", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part, rows = batch.slice(start, 128), []
                for low, text, asked in zip(*(part.column(c).to_pylist() for c in range(3))):
                    rows += [(r["anchor"], r["cut"], r["c1"], r["c2"], low, r["several"], r["contexts"], text[r["at"] - (r["cut"] >> 15) : r["at"] + k + (r["cut"] & 32767)]) for r in asked]
                for n in range(0, len(rows), 20_000):
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[n : n + 20_000]), schema)], schema=schema)

    return run


def extensions(contexts: list[str], lefts: np.ndarray, first: np.ndarray, second: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the contexts of each pair agree to the left and to the right of their anchor, character by character."""
    reach = span - k
    left, right = np.zeros((len(contexts), reach + 1), np.uint32), np.zeros((len(contexts), reach + 1), np.uint32)  # 0 is the end
    for n, (text, size) in enumerate(zip(contexts, lefts)):
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) + np.uint32(1)
        left[n, :size] = code[:size][::-1]
        tail = code[size + k :]
        right[n, : len(tail)] = tail
    out = []
    for side in (left, right):
        agree = np.empty(len(first), np.int64)
        for a in range(0, len(first), 50_000):
            x, y = side[first[a : a + 50_000]], side[second[a : a + 50_000]]
            agree[a : a + 50_000] = ((x != y) | (x == 0)).argmax(1)
        out.append(agree)
    return out[0], out[1]


PARTS = "anchor bigint, cut int, c1 bigint, c2 bigint, a int, b int"


def _extend(span: int, k: int):
    """Of each context that one record has, what of it another context of its anchor holds too: rows of PARTS, places relative to the anchor."""
    schema = pa.schema([("anchor", pa.int64()), ("cut", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])

    def put(members: list[dict], groups: list[int], numbers: list[int]) -> pa.RecordBatch | None:
        first, second = [], []
        owner = {}
        begin = 0
        for anchor, size in zip(numbers, groups):
            for i in range(begin, begin + size):
                owner[i] = anchor
                if not members[i]["several"]:
                    for j in range(begin, begin + size):
                        # Contexts of one record alone don't make a shared span.
                        if i != j and (members[j]["several"] or members[i]["low"] != members[j]["low"]):
                            first.append(i)
                            second.append(j)
            begin += size
        if not first:
            return None
        first_, second_ = np.array(first), np.array(second)
        left, right = extensions([m["context"] for m in members], np.array([m["cut"] >> 15 for m in members]), first_, second_, span, k)
        long = left + k + right >= span
        found = np.unique(np.stack([first_[long], -left[long], k + right[long]], 1), axis=0)
        if not len(found):
            return None
        rows = [(owner[i], members[i]["cut"], members[i]["c1"], members[i]["c2"], a, b) for i, a, b in found.tolist()]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, groups, numbers = [], [], []
            for anchor, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                members += own
                groups.append(len(own))
                numbers.append(anchor)
                if len(members) > 4000:
                    out = put(members, groups, numbers)
                    if out is not None:
                        yield out
                    members, groups, numbers = [], [], []
            out = put(members, groups, numbers) if members else None
            if out is not None:
                yield out

    return run


RUNS = "w1 bigint, w2 bigint, anchor bigint, cut int, c1 bigint, c2 bigint, off int, low string, several boolean"


def _runs(span: int):
    schema = pa.schema([("w1", pa.int64()), ("w2", pa.int64()), ("anchor", pa.int64()), ("cut", pa.int32()), ("c1", pa.int64()), ("c2", pa.int64()), ("off", pa.int32()), ("low", pa.string()), ("several", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [codes(t) for t in part.column(7).to_pylist()]
                w1, own, off = rolling_all(texts, span, 0)
                if len(w1):
                    take = lambda c: part.column(c).take(pa.array(own))  # noqa: E731, B023
                    w2 = rolling_all(texts, span, 1)[0]
                    yield pa.record_batch([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), *(take(c) for c in range(4)), pa.array(off.astype(np.int32)), take(4), take(5)], schema=schema)

    return run


def _hashed(contexts: DataFrame, span: int) -> DataFrame:
    """The same rows as ``_extend`` for anchors with many contexts: runs are joined by hash, and those that meet are compared."""
    runs = materialize(contexts.mapInArrow(_runs(span), RUNS), "spans-runs")
    differ = (F.min("low") != F.max("low")) | F.max("several")
    hot = hot_keys(runs, ["w1", "w2"])
    known = runs.groupBy("w1", "w2").agg(differ.alias("_d")).where("_d").select("w1", "w2")
    met = salt_left(runs, ["w1", "w2"], hot, [*_KEY, "off"]).join(salt_right(known, ["w1", "w2"], hot), ["w1", "w2", "_salt"])
    asked = met.groupBy(*_KEY, "low", "several").agg(F.collect_set("off").alias("_o"))  # no more than SPAN - K + 1 places
    texts = asked.join(contexts.select(*_KEY, "context"), _KEY).withColumn("off", F.explode("_o")).withColumn("_t", F.substr("context", F.col("off") + 1, F.lit(span)))
    same = texts.groupBy("_t").agg(differ.alias("_d")).where("_d").select("_t")
    return texts.where("not several").join(same, "_t").select(*_KEY, (F.col("off") - F.shiftright("cut", 15)).alias("a"), (F.col("off") - F.shiftright("cut", 15) + span).alias("b"))


def merged(rows: DataFrame, key: str) -> DataFrame:
    """Intervals (a, b) of each key put together where they overlap or touch: a window in the order of their beginnings, no lists."""
    order = Window.partitionBy(key).orderBy("a", "b")
    begins = F.coalesce(F.col("a") > F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = rows.withColumn("_n", begins.cast("int")).withColumn("_n", F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_n").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_n")


def texts_of(entities: DataFrame) -> DataFrame:
    """entity_id and text: details, or raw where details is null."""
    text = F.coalesce(F.col("doc.details"), F.col("doc.raw"))
    return entities.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.max_by(text, F.struct("ingested_at")).alias("text"))


def shared_spans(records: DataFrame, span: int = SPAN, k: int = K, many: int = MANY) -> DataFrame:
    """entity_id, text_chars, a and b: the maximal spans of every record (entity_id, text) that shares anything."""
    whole = materialize(records.where(F.length("text") >= span).select("entity_id", F.length("text").alias("text_chars"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), F.col("text")).alias("h2"), "text"), "spans-records")
    classes = materialize(whole.groupBy("h1", "h2").agg(F.min("entity_id").alias("class_id"), F.max("entity_id").alias("_last"), F.first("text").alias("text")).select("class_id", "h1", "h2", (F.col("class_id") != F.col("_last")).alias("several"), "text"), "spans-classes")
    own = materialize(whole.drop("text"), "spans-own")
    forget(whole)
    seeds = materialize(classes.select("class_id", "text").mapInArrow(_seeds(span, k), SEEDS), "spans-seeds")
    common = seeds.groupBy("anchor").agg(F.min("class_id").alias("_a"), F.max("class_id").alias("_b")).where("_a != _b").select("anchor")
    hot = materialize(hot_keys(seeds, ["anchor"]), "spans-hot")
    met = materialize(salt_left(seeds, ["anchor"], hot, ["class_id", "at"]).join(salt_right(common, ["anchor"], hot), ["anchor", "_salt"]).drop("_salt"), "spans-met")
    forget(seeds)
    # Equal contexts are one; ``place`` is one of the places where it stands.
    distinct = materialize(met.groupBy(*_KEY).agg(F.min(F.struct("class_id", "at")).alias("_p"), F.max("class_id").alias("_high")).select(*_KEY, F.col("_p.class_id").alias("low"), F.col("_p.at").alias("at"), (F.col("_p.class_id") != F.col("_high")).alias("several")), "spans-distinct")
    varied = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("contexts"), F.min("several").alias("_all")).where("contexts > 1 and not _all").select("anchor", "contexts")
    open_ = salt_left(distinct, ["anchor"], hot, ["c1", "c2"]).join(salt_right(varied, ["anchor"], hot), ["anchor", "_salt"])
    asked = open_.groupBy("low").agg(F.collect_list(F.struct(*_KEY, "several", "contexts", "at")).alias("asked"))  # no more than a text has characters
    texts = materialize(asked.join(classes.select(F.col("class_id").alias("low"), "text"), "low").select("low", "text", "asked").mapInArrow(_cut_out(k), CONTEXTS), "spans-contexts")
    few = texts.where(F.col("contexts") <= many).groupBy("anchor").agg(F.collect_list(F.struct("cut", "c1", "c2", "low", "several", "context")).alias("own"))  # at most ``many``
    parts = few.mapInArrow(_extend(span, k), PARTS).unionByName(_hashed(texts.where(F.col("contexts") > many), span))
    parts = materialize(parts.unionByName(distinct.where("several").select(*_KEY, (-F.shiftright("cut", 15)).alias("a"), (F.col("cut").bitwiseAND(F.lit(32767)) + k).alias("b"))), "spans-parts")
    hot_contexts = hot_keys(met, _KEY)
    placed = salt_left(met, _KEY, hot_contexts, ["class_id", "at"]).join(salt_right(parts, _KEY, hot_contexts), [*_KEY, "_salt"]).select("class_id", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("b")).alias("b"))
    single = classes.where("not several").select("class_id")  # a class of one is named by its record
    alone = merged(placed.distinct().join(single, "class_id"), "class_id").withColumnRenamed("class_id", "entity_id")
    one = own.select("entity_id", "text_chars").join(alone, "entity_id")
    groups = classes.where("several").select("h1", "h2")
    hot_texts = hot_keys(own.select("h1", "h2"), ["h1", "h2"])
    copies = salt_left(own.select("entity_id", "text_chars", "h1", "h2"), ["h1", "h2"], hot_texts, ["entity_id"]).join(salt_right(groups, ["h1", "h2"], hot_texts), ["h1", "h2", "_salt"])
    return one.select("entity_id", "text_chars", "a", "b").unionByName(copies.select("entity_id", "text_chars", F.lit(0).alias("a"), F.col("text_chars").alias("b")))


def rows(shared: DataFrame) -> DataFrame:
    return shared.select("entity_id", F.col("a").alias("span_start"), F.col("b").alias("span_end"))


def shares(shared: DataFrame) -> DataFrame:
    """How many characters of each record stand elsewhere, and their share."""
    chars = F.sum(F.col("b") - F.col("a"))
    return shared.groupBy("entity_id", "text_chars").agg(chars.cast("int").alias("shared_chars"), F.round(chars / F.col("text_chars"), 6).alias("share"))
