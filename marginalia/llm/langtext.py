"""What of a text is natural language, and the labelled sample from which the language models are fitted."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.runtime import broadcast_if_small

#: Bounds of the training sample: documents for each language, and characters of each such document.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 2000

#: Chinese and Japanese scripts.
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿々〆ｦ-ﾟ\U00020000-\U0003ffff"
CJK_CHAR = re.compile(f"[{CJK}]")
#: A word of prose: letters, with inner apostrophes or hyphens, and punctuation around it.
PROSE = re.compile(r"""^[(\["'«„“‘¿¡*_-]*([^\W\d_]+(?:['’-][^\W\d_]+)*)[)\]"'»”’.,;:!?…*_-]*$""")
_CAMEL = re.compile(r"[a-z][A-Z]")
_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")
_CODE_TAG = re.compile(r"(?s)[@\\](code|verbatim|dot|mermaid)\b.*?(?:[@\\]end\1\b|\Z)")
#: What may be a line of code; ``uncoded`` decides.
_CODE_LINE = re.compile(
    r"""^\s*(?:[*/]+\s*)?(?:
      [\w:<>*&,~\s]*[\w:~>]\s*\([^()]*(?:\([^()]*\)[^()]*)*\)[^.!?。]{0,40};       # a call or a prototype
    | (?:if|for|while|switch|else|do|return|case|goto|using|typedef|extern|static|struct|enum|class|namespace|template|public|private|protected)\b.*(?:[;{}]|:$)
    | [\w:<>*&\s]+[\w\]]\s*(?:=|\+=|-=|\+\+|--)\s*[^.!?。]*;
    | \#\s*(?:include|define|if|ifdef|ifndef|endif|else|pragma|undef)\b
    | [{}();\s]+$
    | \w+(?:\+\+|--);?\s*$
    )""",
    re.X,
)
_LINK = re.compile(r"\w+://\S+|</?\w[^<>\n]*>|&\w+;")


_BREAK = re.compile(r"[(){};]")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"")
_FIRST = re.compile(r"[\s*/]*([A-Za-z]+)\b(\s*[({])?")
_WHOLE_LINE = re.compile(r"[\s*/]*(?:#|[{}();\s]+$|\w+(?:\+\+|--);?\s*$)")
_C_WORDS = frozenset(
    "auto bool break case catch char class const constexpr continue default delete do double else enum explicit extern final float for friend goto if inline int long "
    "namespace new noexcept operator override private protected public register return short signed sizeof static struct switch template throw try typedef typename union unsigned using virtual void volatile while".split()
)
#: Adjacent words beyond the first that code can hold outside parentheses; ``return`` and the words below have their own bounds.
_BESIDE, _BESIDE_AFTER = 1, {"return": 2, "do": 0, "else": 0, "case": 0, "goto": 0}
#: Adjacent words that an argument can hold.
_IN_ARGUMENT = 3


def _runs(text: str) -> list[int]:
    """Lengths of the runs of adjacent plain words; commas, operators, and words of the C language end a run. A called name (before \\0) ends the run it belongs to."""
    out, run = [], 0
    for token in text.split():
        name, called, _ = token.partition("\0")
        if name in _C_WORDS or (len(name) > 1 and name.isupper()):
            plain = False
        else:
            plain = (name.lstrip("*&").isidentifier() and run > 0) if called else prose_word(token) is not None
        if plain:
            run += 1
        if run and (not plain or called or token[-1] in ",:"):
            out.append(run)
            run = 0
    return [*out, run] if run else out


def _statement(line: str) -> tuple[int, str, list[str]]:
    """Where the first statement of a line ends, the statement with \\0 for what stands in parentheses, and what stands there."""
    depth, at, opened, outer, inner = 0, 0, 0, [], []
    for m in _BREAK.finditer(line):
        c = m.group()
        if c == "(":
            if depth == 0:
                outer.append(line[at : m.start()])
                opened = m.end()
            depth += 1
        elif c == ")":
            depth -= depth > 0
            if depth == 0 and opened:
                outer.append("\0")
                inner.append(line[opened : m.start()])
                at, opened = m.end(), 0
        elif depth == 0:
            return m.end(), "".join(outer) + line[at : m.end()], inner
    return len(line), "".join(outer) + line[opened or at :], inner


def _is_statement(told: str, inner: list[str]) -> bool:
    """Whether a statement is code, by the plain words that stand side by side in it."""
    told, inner = _STRING.sub('""', told), [_STRING.sub('""', x) for x in inner]
    if CJK_CHAR.search(told):
        return False
    first = _FIRST.match(told.replace("\0", "("))
    word = first.group(1) if first else ""
    if word in ("if", "for", "while", "switch") and not first.group(2):
        return False
    return sum(n - 1 for n in _runs(told)) <= _BESIDE_AFTER.get(word, _BESIDE) and max((n for x in inner for n in _runs(x)), default=0) <= _IN_ARGUMENT


def uncoded(line: str) -> str:
    """What is left of a line without the statements at its beginning; a sentence that only looks like one stays, with all behind it."""
    while _CODE_LINE.match(line):
        if _WHOLE_LINE.match(line):
            return ""
        end, told, inner = _statement(line)
        if not _is_statement(told, inner):
            break
        line = line[end:].lstrip(" \t\r*/{}();")
    return line


def is_code(line: str) -> bool:
    """Whether a line is nothing but code."""
    return bool(_CODE_LINE.match(line)) and not uncoded(line)


def without_code(text: str) -> str:
    """The text without fenced code, code between tags, and statements at the beginning of lines."""
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "code" in text or "verbatim" in text or "mermaid" in text or "dot" in text:
        text = _CODE_TAG.sub("\n", text)
    return "\n".join(uncoded(x) for x in text.split("\n"))


def prose_word(token: str) -> str | None:
    """The letters of a blank-divided token if it is a word of prose and no identifier, number, path or format."""
    m = PROSE.match(token)
    if m is None:
        return None
    word = m.group(1)
    return None if _CAMEL.search(word) else word


@lru_cache(maxsize=1 << 16)
def _unit(token: str) -> tuple[str, int, int]:
    """What of a token is natural language, its words, and its characters in CJK scripts."""
    if token[0] in "@\\" and len(token) > 1:
        return "", 0, 0
    if not token.isascii() and CJK_CHAR.search(token):
        kept = re.sub(r"[A-Za-z_][\w:]*(?:\(\))?|\d+", " ", token).strip()
        return kept, 0, len(CJK_CHAR.findall(kept))
    word = prose_word(token)
    return (word, int(len(word) > 1), 0) if word is not None else ("", 0, 0)


def prose(text: str) -> tuple[str, int, int]:
    """The natural-language words of a text, joined by blanks, their number, and the number of characters in CJK scripts."""
    words, count, cjk = [], 0, 0
    if not text.isascii() or not text.isprintable() or any(c in text for c in "<&/;`@{#"):
        text = _LINK.sub(" ", without_code(text))
    for token in text.split():
        kept, n, c = _unit(token) if len(token) < 64 else _unit.__wrapped__(token)  # long tokens aren't worth remembering
        if kept:
            words.append(kept)
            count += n
            cjk += c
    return " ".join(words), count, cjk


#: The fewest words, or characters of CJK scripts, that make a sentence.
SENTENCE_WORDS, SENTENCE_CJK = 4, 6


def paragraphs(text: str | None) -> list[str]:
    """Paragraphs divided by blank lines; only paragraphs that aren't blank."""
    out, cur = [], []
    for line in (text or "").split("\n"):
        if line.strip():
            cur.append(line)
        elif cur:
            out.append("\n".join(cur))
            cur = []
    if cur:
        out.append("\n".join(cur))
    return out


def labels(aliases: DataFrame) -> DataFrame:
    """Spelling of a label -> language, each spelling once; a handful of rows whatever the corpus."""
    return aliases.where(F.col("label").isNotNull()).groupBy(F.col("label").alias("_label")).agg(F.min("lang").alias("_named"))


def labelled_sample(documents: DataFrame, aliases: DataFrame, docs: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """At most ``docs`` labelled documents of each language, picked by the hash of their ids, cut to ``chars`` characters.

    Labels are counted first (a row a language reaches the driver), then the hash range that holds about as many as are wanted is read."""
    named = documents.where(F.col("text").isNotNull()).join(broadcast_if_small(labels(aliases)), F.col("lang") == F.col("_label"))
    counts = {r["_named"]: r["count"] for r in named.groupBy("_named").count().collect()}
    if not counts:
        return {}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1_000_000, int(1_000_000 * (1.3 * docs + 30) / n) + 1))])
    rows = named.where(place < limit[F.col("_named")]).select("_named", place.alias("_p"), "doc_id", F.substring("text", 1, chars).alias("text")).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["_p"], str(r["doc_id"]))):
        if len(out.setdefault(r["_named"], [])) < docs:
            out[r["_named"]].append(r["text"])
    return dict(sorted(out.items()))
