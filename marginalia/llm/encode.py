"""Encoding with a byte-level BPE vocabulary: speculate and verify.

A text is divided by the vocabulary's pattern. For each word not yet known, greedy longest match proposes tokens;
then every adjacent pair of proposed tokens is tested, all pairs of a batch at once, for whether merging could have
left the two side by side. If all pairs of a word pass, the proposal is the BPE encoding; only the words of which a
pair fails are merged step by step.

Defined results: empty and null texts have an empty list of ids; strings of special tokens in a text are ordinary
text; every row gives a row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed: the pattern by which a byte-level tokenizer divides a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words, and pairs of tokens, that a worker remembers; longer words aren't kept.
CACHE_WORDS, CACHE_PAIRS, CACHE_LENGTH = 200_000, 400_000, 64


def byte_of_char() -> dict[str, int]:
    """The vocabulary files spell bytes as characters: printable ones as themselves, the others from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in kept}
    return out | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(kept))}


class Vocabulary:
    """Tokens, merges and the tests on them. ``path``: a tokenizer file in JSON with ``model.vocab`` and ``model.merges``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model = whole["model"]
        before = whole.get("pre_tokenizer") or {"type": "ByteLevel"}
        # The file names the division of texts, not its pattern; another one than that of PATTERN would give other ids.
        if before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space", False) or whole.get("normalizer"):
            raise ValueError(f"{path}: texts are divided in another way: {before}, {whole.get('normalizer')}")
        at = byte_of_char()
        names: dict[str, int] = model["vocab"]
        special = {n for n in names if not all(c in at for c in n)}
        self.ids = {bytes(at[c] for c in name): i for name, i in names.items() if name not in special}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = max(names.values()) + 1
        # The id of a merged token gives the order of merges; bytes come first.
        left = np.arange(size, dtype=np.int64)
        right = np.arange(size, dtype=np.int64)
        rank = np.full(size, -1, np.int64)
        keys, made = [], []
        for n, (a, b) in enumerate(pairs):
            token = names[a + b]
            keys.append(names[a] << 32 | names[b])
            made.append(n)
            if rank[token] < 0:
                left[token], right[token], rank[token] = names[a], names[b], n
        order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
        self.left, self.right, self.rank = left, right, rank
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = np.array(made, np.int64)[order]
        self.merges = {(k >> 32, k & 0xFFFFFFFF): n for k, n in zip(keys, made)}
        self.token_of = [names[a + b] for a, b in pairs]
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.longest = max(map(len, self.ids))
        # A token that merging its own bytes wouldn't give may not be proposed.
        self.sound = {t for t in self.ids.values() if rank[t] < 0}
        made_ids = np.flatnonzero(rank >= 0)
        sound = self.beside(left[made_ids], right[made_ids], rank[made_ids])
        ok = dict(zip(made_ids.tolist(), sound.tolist()))
        for t in made_ids[np.argsort(rank[made_ids])].tolist():
            if ok[t] and int(left[t]) in self.sound and int(right[t]) in self.sound:
                self.sound.add(t)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or a value above all ranks."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)

    def beside(self, first: np.ndarray, second: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """For each pair of tokens, whether merging leaves them side by side (up to the merge ``before``, if given).

        The merges that made the two tokens are undone, the latest first. ``limit`` is the time of the merge undone
        last: until then the two parts that now touch stood side by side, so a merge of them that comes earlier would
        have been made instead. What touches at the seam is the right part of the first and the left part of the second."""
        a, b = first.astype(np.int64).copy(), second.astype(np.int64).copy()
        n = len(a)
        good = np.ones(n, bool)
        limit = np.full(n, np.iinfo(np.int64).max) if before is None else before.astype(np.int64).copy()
        # On a tie of ranks the merge further left is made first, so a merge of the seam also beats one in the second token of equal rank.
        live = np.arange(n)
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            wrong = self.lookup(x, y) < top
            good[live[wrong]] = False
            rx, ry = self.rank[x], self.rank[y]
            done = wrong | ((rx < 0) & (ry < 0))
            undo_first = rx > ry
            a[live] = np.where(undo_first, self.right[x], x)
            b[live] = np.where(undo_first, y, self.left[y])
            limit[live] = np.where(undo_first, rx, ry + 1)
            live = live[~done]
        return good

    def greedy(self, word: bytes) -> list[int]:
        out, i, n, ids = [], 0, len(word), self.ids
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                t = ids.get(word[i:j])
                if t is not None and t in self.sound:
                    out.append(t)
                    i = j
                    break
        return out

    def merged(self, word: bytes) -> list[int]:
        """The encoding by definition: the earliest merge first, the leftmost of equal ones. A heap, so that long words don't take quadratic time."""
        import heapq

        ids = [self.byte_ids[b] for b in word]
        after, back = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.merges.get((a, b))) is not None]
        heapq.heapify(heap)
        gone = bytearray(len(ids))
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if not gone[i] else len(ids)
            if gone[i] or j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i] = self.token_of[r]
            gone[j] = 1
            after[i] = after[j]
            if after[i] < len(ids):
                back[after[i]] = i
                q = self.merges.get((ids[i], ids[after[i]]))
                if q is not None:
                    heapq.heappush(heap, (q, i, ids[i], ids[after[i]]))
            if back[i] >= 0:
                q = self.merges.get((ids[back[i]], ids[i]))
                if q is not None:
                    heapq.heappush(heap, (q, back[i], ids[back[i]], ids[i]))
        return [t for t, g in zip(ids, gone) if not g]


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.v = vocabulary
        self.find = regex.compile(PATTERN).findall
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.exact = 0  # words that had to be merged

    def learn(self, new: list[str]) -> dict[str, list[int]]:
        """Encodings of words."""
        proposed = [self.v.greedy(w.encode("utf-8", "replace")) for w in new]
        keys = [[a << 32 | b for a, b in zip(p, p[1:])] for p in proposed]
        unseen = list({k for ks in keys for k in ks if k not in self.pairs})
        if unseen:
            if len(self.pairs) > CACHE_PAIRS:
                self.pairs.clear()
                unseen = list({k for ks in keys for k in ks})
            k = np.array(unseen, np.int64)
            self.pairs |= zip(unseen, self.v.beside(k >> 32, k & 0xFFFFFFFF).tolist())
        out = {}
        for w, p, ks in zip(new, proposed, keys):
            if not all(self.pairs[k] for k in ks):
                self.exact += 1
                p = self.v.merged(w.encode("utf-8", "replace"))
            out[w] = p
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.find(t) if t else [] for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        known = self.words
        new = self.learn(list({w for ws in split for w in ws if w not in known}))
        known |= {w: p for w, p in new.items() if len(w) <= CACHE_LENGTH}
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += known[w] if w in known else new[w]
            out.append(ids)
        return out


#: Characters of text encoded at a time.
CHUNK = 500_000


def _encoder(vocabulary: Vocabulary):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)

        def rows(keys, texts):
            ids = encoder.encode(texts)
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.fromiter((t for x in ids for t in x), np.int32, int(offsets[-1]))
            return pa.record_batch([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=schema)

        for batch in batches:
            keys, texts, chars = [], [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(key)
                texts.append(text)
                chars += len(text or "")
                if chars > CHUNK:
                    yield rows(keys, texts)
                    keys, texts, chars = [], [], 0
            if keys:
                yield rows(keys, texts)

    return run


def encode(documents: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every document. No shuffle; the vocabulary (a few MB) travels with the task."""
    return documents.select("doc_id", "text").mapInArrow(_encoder(Vocabulary(path)), "doc_id bigint, ids array<int>")
