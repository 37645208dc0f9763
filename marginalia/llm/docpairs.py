"""Functions paired with their documentation.

Files are parsed into syntax trees; the nodes of functions and methods are visited, each with the comment attached
to it and its exact range in the source; pairs whose documentation says nothing are dropped.

Defined results: null or empty content has no pairs; a file sent twice gives its pairs once; a file that can't be
parsed as a whole gives the declarations that can; of several declarations with one name on one line (path, line,
name, start) tells them apart; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions import cdecl

#: Fixed: words that say nothing in a description, and the least number of other words.
EMPTY_WORDS = {"a", "an", "the", "this", "that", "of", "for", "to", "in", "and", "it", "is", "function", "method", "todo", "tbd", "fixme", "xxx"}
LEAST_WORDS = 3
#: Chinese and Japanese scripts: each character is a word.
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿々〆ｦ-ﾟ\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{CJK}]|[^\W\d_{CJK}]+")
_TAG = re.compile(r"^[ \t]*[@\\]([A-Za-z]+)", re.M)
_OWN = re.compile(r"^([ \t]*)[@\\](brief|details|short)(?![A-Za-z])", re.M)
_NAME = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[^\W\d_A-Za-z]+")
PAIRS = "path string, line int, name string, qualified_name string, kind string, begin_line int, end_line int, start int, end int, code string, brief string, details string, words int"


def description(text: str) -> tuple[str, str]:
    """Brief and details of a comment's text: what stands before the first tag other than brief, details and short."""
    for m in _TAG.finditer(text):
        if m.group(1) not in ("brief", "details", "short"):
            text = text[: m.start()]
            break
    details_at = re.search(r"^[ \t]*[@\\]details(?![A-Za-z])", text, re.M)
    clean = lambda s: _OWN.sub(r"\1", s).strip()
    if details_at and clean(text[: details_at.start()]):
        return clean(text[: details_at.start()]), clean(text[details_at.start() :])
    brief, _, details = clean(text).partition("\n\n")
    return brief.strip(), details.strip()


def telling_words(text: str, name: str) -> int:
    """The words of ``text`` without those of ``name`` and without EMPTY_WORDS."""
    own = {w.lower() for w in _NAME.findall(name)}
    return sum(w.lower() not in own and w.lower() not in EMPTY_WORDS for w in _WORD.findall(text))


def pairs_of(path: str, content: str | None, is_cpp: bool = True) -> list[tuple]:
    out = []
    for node in cdecl.parse(content, is_cpp):
        if node.kind not in ("function", "method") or node.doc is None:
            continue
        brief, details = description(cdecl.documentation(node))
        words = telling_words(f"{brief}\n{details}", node.name)
        if words >= LEAST_WORDS:
            out.append((path, node.line, node.name, node.qualified, node.kind, node.begin_line, node.end_line, node.start, node.end, content[node.start : node.end], brief, details or None, words))
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PAIRS.split(", ")]
    types = {"string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in PAIRS.split(", ")])
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            rows = [r for path, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in pairs_of(path, content)]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=names)


def pairs(sources: DataFrame) -> DataFrame:
    """Code and description of each documented function of ``sources`` (path, content).

    Copies of a file are parsed again and their equal pairs dropped, combined before the shuffle: contents never travel."""
    found = sources.where(F.col("content").isNotNull()).select("path", "content").mapInArrow(_batches, PAIRS)
    return found.dropDuplicates(["path", "line", "name", "start", "end", "words"])


def places(sources: DataFrame) -> DataFrame:
    """Only path, line and name of each pair; the texts don't leave the task."""
    return sources.where(F.col("content").isNotNull()).select("path", "content").mapInArrow(_batches, PAIRS).select("path", "line", "name").distinct()
