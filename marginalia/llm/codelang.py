"""Natural language hidden inside code.

A lexer takes comments and string literals from each file; code-like parts are removed; the language of what is
left is identified by naive Bayes over character n-grams of words, and a shortest path over the words (changing
language has a price) cuts a comment into passages of one language. Each passage keeps the place in its file where it
begins and ends; the bytes of the file between these, marks and escapes as they stand there, are totalled per language.

Defined results: null and empty content have no passages; a file sent twice counts once; a file without natural
language has no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.clex import Token, comment_text, string_value, tokens
from marginalia.llm.langtext import CJK, CJK_CHAR, SENTENCE_CJK, SENTENCE_WORDS, _FENCE, _LINK, labelled_sample, paragraphs, prose, prose_word, uncoded

#: Fixed: a passage has at least so many blank-divided words, or characters of CJK scripts.
PASSAGE_WORDS, PASSAGE_CJK = 8, 15
ORDERS = (1, 2, 3, 4)
#: Additive smoothing; weight of a word's evidence (its n-grams overlap); price of a change of language; evidence that one word can give.
SMOOTH, WEIGHT, CHANGE, MOST = 0.5, 0.35, 9.0, 8.0
#: Words remembered by a worker.
CACHE = 200_000
PASSAGES = "path string, kind string, line int, start int, part int, lang string, words int, chars int, from_char int, to_char int, bytes int, content_bytes bigint, text string"
_RUN = re.compile(rf"[{CJK}]+")


def grams(word: str) -> list[str]:
    w = f" {word.lower()} "
    if CJK_CHAR.search(word):
        w = w.strip()
    return [w[i : i + n] for n in ORDERS for i in range(len(w) - n + 1)]


class Bayes:
    """Naive Bayes over character n-grams."""

    def __init__(self, langs: list[str], table: dict[str, int], logs: np.ndarray):
        self.langs, self.table, self.logs = langs, table, logs
        self.known: dict[str, np.ndarray] = {}

    @classmethod
    def fit(cls, sample: dict[str, list[str]], rounds: int = 2) -> Bayes:
        """Counts n-grams of the words of labelled paragraphs; paragraphs that the counts of the round before contradict are left out."""
        langs = sorted(sample)
        rows = []
        for k, lang in enumerate(langs):
            for n, text in enumerate(sample[lang]):
                for p in paragraphs(text):
                    natural, words, cjk = prose(p)
                    if words >= SENTENCE_WORDS or cjk >= SENTENCE_CJK:
                        rows.append((k, n % 2, [x for w in natural.split() for x in (_RUN.findall(w) if CJK_CHAR.search(w) else [w])]))
        model = None
        for turn in range(rounds + 1):
            kept = rows
            if turn:
                folds = [cls._count(langs, [r for r in kept_before if r[1] == f]) for f in (0, 1)]
                kept = [r for r in rows if int(np.argmax(sum((folds[1 - r[1]].word(w) for w in r[2]), np.zeros(len(langs))))) == r[0]] or rows
            kept_before = kept
        model = cls._count(langs, kept_before)
        return model

    @classmethod
    def _count(cls, langs, rows) -> Bayes:
        seen: dict[tuple[int, str], int] = {}
        for k, _, words in rows:
            for w in words:
                seen[k, w] = seen.get((k, w), 0) + 1
        table: dict[str, int] = {}
        at, lang, times = [], [], []
        for (k, w), n in seen.items():
            for g in grams(w):
                at.append(table.setdefault(g, len(table)))
                lang.append(k)
                times.append(n)
        counts = np.zeros((len(table) + 1, max(1, len(langs))))
        np.add.at(counts, (at, lang), times)
        total = counts.sum(0)
        share = counts / np.maximum(total, 1)  # languages have samples of different size
        logs = np.log(share * total.max() + SMOOTH) if len(table) else counts
        logs -= logs.max(1, keepdims=True)
        logs[-1] = 0
        return cls(list(langs), table, logs.astype(np.float32))

    def word(self, word: str) -> np.ndarray:
        """Evidence of one word for each language, 0 for the best."""
        e = self.known.get(word)
        if e is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            at = [self.table[g] for g in grams(word) if g in self.table]
            e = self.logs[at].sum(0) * WEIGHT if at else np.zeros(len(self.langs), np.float32)
            e = np.maximum(e - e.max(), -MOST if not CJK_CHAR.search(word) else -4 * MOST)
            self.known[word] = e
        return e

    def path(self, evidence: np.ndarray) -> np.ndarray:
        """The language of each word on the best path."""
        best = int(evidence.sum(0).argmax())
        gain = evidence - evidence[:, best : best + 1]
        run = np.cumsum(gain, 0)
        low = np.minimum.accumulate(np.vstack([np.zeros((1, run.shape[1]), run.dtype), run[:-1]]), 0)
        if float((run - low).max()) <= CHANGE:  # no stretch of words speaks enough for another language
            return np.full(len(evidence), best)
        n, k = evidence.shape
        score, back = evidence[0].copy(), np.zeros((n, k), np.int32)
        for i in range(1, n):
            top = int(score.argmax())
            move = score[top] - CHANGE
            back[i] = np.where(score >= move, np.arange(k), top)
            score = np.maximum(score, move) + evidence[i]
        out = np.zeros(n, np.int64)
        out[-1] = int(score.argmax())
        for i in range(n - 1, 0, -1):
            out[i - 1] = back[i, out[i]]
        return out


def literals(content: str) -> list[tuple[str, int, str, list[tuple[Token, int]]]]:
    """(kind, offset, text, tokens with their offsets) of comments, runs of line comments being one, and of string literals, adjacent ones being joined."""
    out: list[tuple[str, int, str, list[tuple[Token, int]]]] = []
    last: Token | None = None
    lines: list[str] = []
    start, alone, first_column = 0, True, 0
    joined = -1
    queue = tokens(content)
    n = 0
    while n < len(queue):
        t = queue[n]
        n += 1
        if t.kind == "pp":
            if not re.match(r"\s*#\s*(include|import|line|pragma)", t.text):
                inner = tokens(re.sub(r"^(\s*)#", r"\1 ", t.text))
                out += [("string", t.start + x.start, string_value(x), [(x, t.start + x.start)]) for x in inner if x.kind in ("str", "raw")]
            continue
        if t.kind == "lc":
            gap = content[last.start + len(last.text) : t.start] if last is not None and last.kind == "lc" else None
            line_at = content.rfind("\n", 0, t.start) + 1
            own_line, column = not content[line_at : t.start].strip(), t.start - line_at
            # A comment behind code goes on where the next line's begins in the same column.
            if gap is not None and own_line and gap.count("\n") == 1 and not gap.strip() and (alone or column == first_column):
                lines.append(t.text)
                out[-1] = ("comment", start, "\n".join(comment_text(x) for x in lines), [*out[-1][3], (t, t.start)])
            else:
                lines, start, alone, first_column = [t.text], t.start, own_line, column
                out.append(("comment", start, comment_text(t.text), [(t, start)]))
        elif t.kind == "bc":
            out.append(("comment", t.start, comment_text(t.text), [(t, t.start)]))
        elif t.kind in ("str", "raw"):
            if joined >= 0:
                kind, at, text, parts = out[joined]
                out[joined] = (kind, at, text + string_value(t), [*parts, (t, t.start)])
            else:
                out.append(("string", t.start, string_value(t), [(t, t.start)]))
                joined = len(out) - 1
        if t.kind not in ("str", "raw", "lc", "bc"):
            joined = -1
        last = t
    return out


_TAG = re.compile(r"^\s*[@\\]([A-Za-z]+)(?:\[[\w, ]*\])?\s*")
_NAMED = {"param", "tparam", "retval", "throw", "throws", "exception", "see", "sa", "ref", "copydoc", "anchor", "file", "defgroup", "ingroup", "addtogroup", "page", "section"}
_TOKEN = re.compile(r"\S+")
_ESCAPED = re.compile(r"\\(\r?\n|x[0-9a-fA-F]+|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{1,3}|.)", re.S)
_SKIPPED = {"code": "endcode", "verbatim": "endverbatim", "mermaid": "endmermaid", "dot": "enddot"}


def _without_fence(m: re.Match) -> str:
    return "\n\n" + " " * (len(m.group()) - 2)


def blocks(text: str) -> list[list[tuple[str, int]]]:
    """The stretches of a literal in which a passage may lie: blank-divided tokens, with their places, between blank lines, tags and code."""
    out: list[list[tuple[str, int]]] = [[]]
    until = None
    if "```" in text:
        text = _FENCE.sub(_without_fence, text)
    at = 0
    for line in text.split("\n"):
        place = at
        at += len(line) + 1
        m = _TAG.match(line)
        if until is not None:
            if m and m.group(1) == until:
                until = None
            continue
        if m and m.group(1) in _SKIPPED:
            until = _SKIPPED[m.group(1)]
            out.append([])
            continue
        if m:
            out.append([])
            whole, line = line, line[m.end() :]
            if m.group(1) in _NAMED:
                line = line.partition(" ")[2]
            place += len(whole) - len(line)
        left = uncoded(line)  # what is behind the code
        if left != line or not line.strip():
            out.append([])
        place += len(line) - len(left)
        out[-1] += [(x.group(), place + x.start()) for x in _TOKEN.finditer(_LINK.sub(lambda m: " " * len(m.group()), left))]
    return [b for b in out if b]


def _line_places(text: str, start: int, mark: str, first: bool = False) -> list[int]:
    """Where each character of the lines of a comment stands, without what ``mark`` matches and blanks at their ends; a place for each line end too."""
    out: list[int] = []
    at = start
    for n, line in enumerate(re.split("(\r?\n)", text)):
        if n % 2 == 0:
            if first and n == 0:
                begin = len(line) - len(line.lstrip())
            else:
                m = re.match(mark, line)
                begin = m.end() if m else 0
            out += range(at + begin, at + max(begin, len(line.rstrip())))
        else:
            out.append(at)
        at += len(line)
    return out


def _string_places(token: Token, start: int) -> list[int]:
    """Where each character of a string literal's value stands; one that an escape spells where the escape begins."""
    text = token.text
    if token.kind == "raw":
        begin = text.index("(") + 1
        return list(range(start + begin, start + begin + len(string_value(token))))
    begin, value = text.index('"') + 1, string_value(token)
    inner = text[begin:].removesuffix('"')
    if "\\" not in inner:
        return list(range(start + begin, start + begin + len(value)))
    out, at, run = [], 0, 0

    def bytes_until(end: int) -> None:  # a run of byte escapes is read as UTF-8
        nonlocal run
        if end > run:
            out.extend(start + begin + run for _ in range(len(string_value(Token("str", '"' + inner[run:end] + '"', 0)))))
        run = end

    for m in _ESCAPED.finditer(inner):
        byte = m.group(1)[0] in "x01234567"
        if m.start() > at or not byte:
            bytes_until(at)
            out.extend(range(start + begin + at, start + begin + m.start()))
            run = m.start()
        at = m.end()
        if not byte:
            bytes_until(at)
    bytes_until(at)
    out.extend(range(start + begin + at, start + begin + len(inner)))
    return out


def places(kind: str, parts: list[tuple[Token, int]]) -> list[int]:
    """Where each character of a literal's text stands in its file, and where the literal ends."""
    out: list[int] = []
    for n, (t, start) in enumerate(parts):
        if kind == "string":
            out += _string_places(t, start)
        else:
            out += [start - 1] * (n > 0)  # the line end that joins two line comments
            if t.kind == "bc":
                body = re.sub(r"\*+/\Z", "", t.text)
                opened = re.match(r"/\*+[!<]*<?", body)
                begin = opened.end() if opened else len(body)
                out += _line_places(body[begin:], start + begin, r"^\s*\*+ ?|^\s+", True)
            else:
                out += _line_places(t.text, start, r"^\s*//[/!]*<? ?")
    last, start = parts[-1]
    return [*out, start + len(last.text)]


def passages(model: Bayes, content: str | None) -> list[tuple]:
    """(kind, offset, language, words, CJK characters, text, first place, last place) of each passage that is long enough."""
    out = []
    for kind, offset, text, parts in literals(content or ""):
        where = None
        for block in blocks(text):
            units: list[tuple[int, str, int]] = []  # token, word or CJK run, CJK characters
            for n, (token, _) in enumerate(block):
                if CJK_CHAR.search(token):
                    units += [(n, run, len(run)) for run in _RUN.findall(token)]
                else:
                    word = prose_word(token)
                    if word is not None:
                        units.append((n, word, 0))
            if not units or (len(block) < PASSAGE_WORDS and sum(u[2] for u in units) < PASSAGE_CJK):
                continue
            way = model.path(np.stack([model.word(u[1]) for u in units]))
            cuts = [0, *(np.flatnonzero(way[1:] != way[:-1]) + 1), len(units)]
            for a, b in zip(cuts, cuts[1:]):
                lang = model.langs[way[a]]
                # Identifiers and numbers at either end of the stretch belong to the passage beside them.
                first = units[a][0] if a else 0
                last = units[b - 1][0] if b < len(units) else len(block) - 1
                words, cjk = last - first + 1, sum(u[2] for u in units[a:b])
                natural = sum(1 for u in units[a:b] if len(u[1]) > 1)
                if cjk >= PASSAGE_CJK if lang in ("zh", "ja") else (words >= PASSAGE_WORDS and natural >= SENTENCE_WORDS):
                    where = where or places(kind, parts)
                    end = block[last][1] + len(block[last][0])
                    shown = " ".join([t for t, _ in block[first : last + 1]])
                    # The last character may be spelt by several: the passage ends where the next one, or the line, does.
                    to = where[end] if where[end] > where[end - 1] + 1 and content[where[end - 1]] == "\\" else where[end - 1] + 1
                    out.append((kind, offset, lang, words, cjk, shown, where[block[first][1]], to))
    return out


def _finder(model: Bayes):
    types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in PASSAGES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part, rows = batch.slice(start, 128), []
                for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    size = len(content.encode("utf-8", "replace"))
                    for n, (kind, offset, lang, words, cjk, text, a, b) in enumerate(passages(model, content)):
                        rows.append((path, kind, content.count("\n", 0, offset) + 1, offset, n, lang, words, len(text), a, b, len(content[a:b].encode("utf-8", "replace")), size, text))
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def train(documents: DataFrame, aliases: DataFrame) -> Bayes:
    """Fitted on the bounded sample of labelled documents (langtext.SAMPLE_DOCS a language)."""
    return Bayes.fit(labelled_sample(documents, aliases))


def find(sources: DataFrame, model: Bayes) -> DataFrame:
    """Every passage of natural language in the files of ``sources`` (path, content); those of a copied file once for each copy.

    No shuffle: what is made of the passages is made distinct afterwards, so that contents never travel."""
    return sources.where(F.col("content").isNotNull()).select("path", "content").mapInArrow(_finder(model), PASSAGES)


def languages(found: DataFrame) -> DataFrame:
    return found.select("path", "lang").distinct()


def distinct(found: DataFrame) -> DataFrame:
    """Each passage of a file once."""
    return found.dropDuplicates(["path", "start", "part", "lang", "bytes"])


def shares(found: DataFrame) -> DataFrame:
    """Bytes of each language in each file and their share of the file; takes each passage once (see ``distinct``)."""
    return found.groupBy("path", "lang").agg(F.count(F.lit(1)).alias("passages"), F.sum("bytes").alias("bytes"), F.round(F.sum("bytes") / F.max("content_bytes"), 6).alias("share"))
