"""Missing or wrong language labels.

Sparse multinomial logistic regression on TF-IDF character n-grams, trained with follow-the-regularised-leader
(per-coordinate rates, elastic-net penalties) and calibrated by a temperature on held-out paragraphs. Document
frequencies are counted over all documents; only the weights are fitted on a bounded sample of labelled rows
(``langtext.SAMPLE_DOCS`` a language). Labels of the sample may be wrong: paragraphs that
a fit on the other half of the sample contradicts are left out.

Defined results: null, empty and blank texts have no paragraphs; a paragraph without a sentence of natural language
has no language; a null, empty or unlisted label names no language; equal rows give equal rows once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.langtext import SENTENCE_CJK, SENTENCE_WORDS, labelled_sample, labels, paragraphs, prose
from marginalia.runtime import broadcast_if_small, materialize

BITS = 16
ORDERS = (1, 2, 3, 4)
#: Follow-the-regularised-leader: rate, smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.1, 1.0, 0.01, 0.05, 2
#: Share of held-out labels that may still be wrong, for the calibration.
DOUBT = 0.01
#: Characters handled at a time, so that a batch's arrays stay small.
CHUNK = 200_000
NATURALS = "doc_id bigint, seg_no int, label string, text_chars int, natural string"
SEGMENTS = "doc_id bigint, seg_no int, label string, text_chars int, lang string, confidence double"


def ngrams(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed character n-grams of all texts: for each order (number of the text, in order; bucket) of every occurrence."""
    joined = "\n".join(f" {t.lower()} " for t in texts)
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    own = np.cumsum(code == 10).astype(np.int32)
    inner = code != 10
    out = []
    h = np.zeros(len(code), np.uint64)
    ok = np.ones(len(code), bool)
    for n in range(1, max(ORDERS) + 1):
        if len(code) < n:
            break
        h = (h[: len(code) - n + 1] + code[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        ok = ok[: len(code) - n + 1] & inner[n - 1 :]
        if n in ORDERS:
            out.append((own[: len(code) - n + 1][ok], ((h[ok] * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)).astype(np.int32)))
    return out


def totals(grams: list[tuple[np.ndarray, np.ndarray]], texts: int) -> np.ndarray:
    """Number of n-grams of each text."""
    return sum((np.bincount(doc, minlength=texts) for doc, _ in grams), np.zeros(texts, np.int64))


def tfidf(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (row pointers, buckets, values): count times IDF over the root of the text's number of n-grams."""
    sizes, cols, vals = [], [], []
    at = 0
    while at < len(texts):
        part, chars = [], 0
        while at < len(texts) and (not part or chars < CHUNK) and len(part) < 1 << (32 - BITS):
            part.append(texts[at])
            chars += len(texts[at])
            at += 1
        grams = ngrams(part)
        keys = np.concatenate([d.astype(np.uint32) << np.uint32(BITS) | b.astype(np.uint32) for d, b in grams])
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        count = np.diff(np.r_[first, len(keys)])
        row, col = keys[first] >> np.uint32(BITS), (keys[first] & np.uint32((1 << BITS) - 1)).astype(np.int32)
        sizes.append(np.bincount(row, minlength=len(part)))
        cols.append(col)
        vals.append((count * idf[col] / np.sqrt(np.maximum(totals(grams, len(part)), 1))[row]).astype(np.float32))
    none = np.zeros(0, np.int32)
    return np.r_[0, np.cumsum(np.concatenate(sizes))] if sizes else np.zeros(1, np.int64), np.concatenate(cols) if cols else none, np.concatenate(vals) if vals else none.astype(np.float32)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets x languages
    idf: np.ndarray
    temperature: float = 1.0
    table: np.ndarray | None = None

    def logits(self, texts: list[str]) -> np.ndarray:
        """As the product of tfidf(texts) and the weights, but summed over occurrences, which needs no sorting."""
        if self.table is None:
            self.table = (self.weights * self.idf[:, None]).astype(np.float32)
        grams = ngrams(texts)
        out = np.zeros((len(texts), self.table.shape[1]), np.float32)
        step = 200_000  # occurrences at a time, so that a long text doesn't need all its terms at once
        for doc, bucket in grams:
            for a in range(0, len(doc), step):
                rows = doc[a : a + step]
                first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                out[rows[first]] += np.add.reduceat(self.table[bucket[a : a + step]], first)
        return out / np.sqrt(np.maximum(totals(grams, len(texts)), 1))[:, None].astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language and calibrated confidence for each text."""
        z = self.logits(texts) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def _dot(ptr, col, val, weights) -> np.ndarray:
    out = np.zeros((len(ptr) - 1, weights.shape[1]), np.float32)
    step = 200_000  # entries at a time, so that the products don't all stand in memory
    for a in range(0, len(col), step):
        part = val[a : a + step, None] * weights[col[a : a + step]]
        rows = np.searchsorted(ptr, np.arange(a, a + len(part)), "right") - 1
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        out[rows[first]] += np.add.reduceat(part, first)
    return out


def ftrl(ptr, col, val, y: np.ndarray, chosen: np.ndarray, classes: int, passes: int = PASSES, batch: int = 128, seed: int = 1) -> np.ndarray:
    """Weights by follow-the-regularised-leader over the chosen rows; gradients of a small batch are taken together."""
    z = np.zeros((1 << BITS, classes), np.float32)
    n = np.zeros((1 << BITS, classes), np.float32)
    order = np.random.default_rng(seed)

    def weights_of(c):
        zc = z[c]
        return np.where(np.abs(zc) <= L1, 0, -(zc - np.sign(zc) * L1) / ((BETA + np.sqrt(n[c])) / ALPHA + L2)).astype(np.float32)

    for _ in range(passes):
        perm = chosen[order.permutation(len(chosen))]
        for a in range(0, len(perm), batch):
            rows = perm[a : a + batch]
            idx = np.concatenate([np.arange(ptr[r], ptr[r + 1]) for r in rows])
            if not len(idx):
                continue
            which = np.repeat(np.arange(len(rows)), [ptr[r + 1] - ptr[r] for r in rows])
            c, where = np.unique(col[idx], return_inverse=True)
            w = weights_of(c)
            logits = np.zeros((len(rows), classes), np.float32)
            first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
            logits[which[first]] = np.add.reduceat(val[idx, None] * w[where], first)
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            by = np.argsort(where, kind="stable")
            g = np.add.reduceat(val[idx[by], None] * p[which[by]], np.flatnonzero(np.r_[True, np.diff(where[by]) > 0]))
            sigma = (np.sqrt(n[c] + g * g) - np.sqrt(n[c])) / ALPHA
            z[c] += g - sigma * w
            n[c] += g * g
    out = np.zeros_like(z)
    step = 1 << 12
    for a in range(0, len(z), step):
        out[a : a + step] = weights_of(np.arange(a, min(a + step, len(z))))
    return out


def fit(sample: dict[str, list[str]], idf: np.ndarray) -> Model:
    """Fit on labelled texts, paragraph by paragraph; a fifth of the paragraphs is held out for the temperature."""
    langs = sorted(sample)
    texts, y, own = [], [], []
    docs = 0
    for k, lang in enumerate(langs):
        for text in sample[lang]:
            docs += 1
            for p in paragraphs(text):
                natural, words, cjk = prose(p)
                if words >= SENTENCE_WORDS or cjk >= SENTENCE_CJK:
                    texts.append(natural)
                    y.append(k)
                    own.append(docs)
    y, own = np.array(y, np.int64), np.array(own, np.int64)
    if not langs or not len(y):
        return Model(langs or ["en"], np.zeros((1 << BITS, max(1, len(langs))), np.float32), idf)
    ptr, col, val = tfidf(texts, idf)
    keep = np.arange(len(y))
    for _ in range(2):  # labels that the model of the other half contradicts are taken for wrong
        told = np.full(len(y), -1)
        for fold in (0, 1):
            weights = ftrl(ptr, col, val, y, keep[own[keep] % 2 == fold], len(langs), passes=1)
            told = np.where(own % 2 == fold, told, _dot(ptr, col, val, weights).argmax(1))
        agree = np.flatnonzero(told == y)
        keep = agree if len(agree) > len(y) / 2 else keep
    held = keep[keep % 5 == 0]
    train = np.setdiff1d(keep, held)
    weights = ftrl(ptr, col, val, y, train, len(langs))
    z_held = _dot(ptr, col, val, weights)[held]
    model = Model(langs, weights, idf)
    if len(held):
        z = z_held
        grid = np.geomspace(0.05, 5, 40)

        def loss(t):
            s = z / t
            s = s - s.max(1, keepdims=True)
            own_share = 1 - DOUBT + DOUBT / len(langs)
            told = own_share * s[np.arange(len(held)), y[held]] + (1 - own_share) * (s.sum(1) - s[np.arange(len(held)), y[held]]) / max(1, len(langs) - 1)
            return float((np.log(np.exp(s).sum(1)) - told).mean())

        model.temperature = float(min(grid, key=loss))
    return model


def _natural(text: str | None) -> list[tuple[int, str, str]]:
    """(number, paragraph, natural words) of the paragraphs that hold a sentence."""
    out = []
    for n, p in enumerate(paragraphs(text)):
        natural, words, cjk = prose(p)
        if words >= SENTENCE_WORDS or cjk >= SENTENCE_CJK:
            out.append((n, p, natural))
    return out


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("seg_no", pa.int32()), ("label", pa.string()), ("text_chars", pa.int32()), ("natural", pa.string())])
    for batch in batches:
        rows, chars = [], 0
        for doc_id, text, label in zip(*(c.to_pylist() for c in batch.columns)):
            for n, p, natural in _natural(text):
                rows.append((doc_id, n, label, len(p), natural))
                chars += len(natural)
            if chars > 4 * CHUNK:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, chars = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def naturals(documents: DataFrame) -> DataFrame:
    """The paragraphs that hold a sentence, with their natural-language words."""
    return documents.select("doc_id", "text", "lang").mapInArrow(_split, NATURALS)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about CHUNK characters in the last column."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = int(sizes[at - 1]) if at else 0
            end = min(max(at + 1, int(np.searchsorted(sizes, done + CHUNK))), at + (1 << (32 - BITS)) - 1, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(1 << BITS, np.int64)
    total = 0
    for part in _portions(batches):
        keys = np.concatenate([doc.astype(np.uint32) << np.uint32(BITS) | bucket.astype(np.uint32) for doc, bucket in ngrams(part.column(0).to_pylist())])
        keys.sort()
        df += np.bincount(keys[np.r_[True, keys[1:] != keys[:-1]]] & np.uint32((1 << BITS) - 1), minlength=1 << BITS)
        total += part.num_rows
    at = np.flatnonzero(df)
    yield pa.record_batch([pa.array(np.r_[at, -1].astype(np.int32)), pa.array(np.r_[df[at], total])], names=["bucket", "df"])


def inverse_frequencies(natural: DataFrame) -> np.ndarray:
    """IDF of each bucket over all paragraphs of ``naturals``. At most 2^BITS + 1 rows reach the driver, whatever the corpus."""
    rows = natural.select("natural").mapInArrow(_frequencies, "bucket int, df bigint").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    bucket, df = rows.column("bucket").to_numpy(), rows.column("df").to_numpy()
    total = int(df[bucket == -1].sum())
    idf = np.full(1 << BITS, np.log(1 + total) + 1, np.float32)
    seen = bucket >= 0
    idf[bucket[seen]] = np.log((1 + total) / (1 + df[seen])) + 1
    return idf


def _classifier(model: Model):
    schema = pa.schema([("doc_id", pa.int64()), ("seg_no", pa.int32()), ("label", pa.string()), ("text_chars", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.langs)
        for part in _portions(batches):
            best, sure = model.predict(part.column(4).to_pylist())
            yield pa.record_batch([*part.columns[:4], names.take(pa.array(best)), pa.array(sure.astype(np.float64))], schema=schema)

    return run


def train(documents: DataFrame, aliases: DataFrame, natural: DataFrame | None = None) -> Model:
    return fit(labelled_sample(documents, aliases), inverse_frequencies(natural if natural is not None else naturals(documents)))


def segments(documents: DataFrame, aliases: DataFrame, model: Model | None = None) -> DataFrame:
    """Language and confidence of every paragraph that has one, with the language ``named`` that its document's label names.

    Texts are cleaned of code once: the natural words go to the shared folder, compressed, and are counted and classified from there."""
    natural = naturals(documents)
    if model is None:
        natural = materialize(natural, "naturals")
        model = train(documents, aliases, natural)
    found = natural.mapInArrow(_classifier(model), SEGMENTS)
    named = broadcast_if_small(labels(aliases))  # a row for each spelling of a label
    return found.join(named, F.col("label") == F.col("_label"), "left").select("doc_id", "seg_no", "label", F.col("_named").alias("named"), "text_chars", "lang", "confidence")


def wrong(segmented: DataFrame) -> DataFrame:
    """The paragraphs whose language isn't the one that the label names."""
    return segmented.where(F.col("named").isNull() | (F.col("named") != F.col("lang"))).select("doc_id", "seg_no", "lang").distinct()


def documents_languages(segmented: DataFrame) -> DataFrame:
    """Of each document the language of most of its characters, its share as confidence-weighted part, and whether it is mixed."""
    by = segmented.groupBy("doc_id", "lang").agg(F.sum("text_chars").alias("chars"), F.sum(F.col("text_chars") * F.col("confidence")).alias("sure"), F.first("named").alias("named"))
    return by.groupBy("doc_id").agg(
        F.max_by("lang", F.struct("chars", "lang")).alias("lang"), F.round(F.max_by(F.col("sure") / F.col("chars"), F.struct("chars", "lang")), 6).alias("confidence"), (F.count(F.lit(1)) > 1).alias("mixed"), F.first("named").alias("named")
    )
