"""Tokens of C and C++ text."""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

_TOKEN = re.compile(
    r"""
 (?P<pp>^[ \t]*\#(?:[^\n\\/]|\\\r?\n|\\.|\\|/(?![/*]))*)
|(?P<ws>\n+|[^\S\n]+|\\\r?\n)
|(?P<lc>//(?:[^\\\n]|\\\r?\n|\\[^\n]|\\(?=\n|\Z))*)
|(?P<bc>/\*.*?(?:\*/|\Z))
|(?P<raw>(?:u8|[uUL])?R"(?P<tag>[^()\\\s"]{0,16})\(.*?(?:\)(?P=tag)"|\Z))
|(?P<str>(?:u8|[uUL])?"(?:[^"\\\n]|\\(?:\r\n|.))*(?:"|(?=\n)|\Z))
|(?P<chr>(?:u8|[uUL])?'(?:[^'\\\n]|\\.)*(?:'|(?=\n)|\Z))
|(?P<num>\.?\d(?:[eEpP][+-]|'(?=\w)|[\w.])*)
|(?P<id>[^\W\d]\w*)
|(?P<p>::|->\*?|\.\.\.|<=>|<<=|>>=|[-+*/%^&|=!<>]=|&&|\|\||\+\+|--|<<|.)
""",
    re.X | re.S | re.M,
)


class Token(NamedTuple):
    kind: str  # pp, lc, bc, raw, str, chr, num, id, p
    text: str
    start: int


class Lines:
    """1-based lines and columns of offsets."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def column(self, offset: int) -> int:
        return offset - self.starts[self.line(offset) - 1] + 1


def tokens(text: str) -> list[Token]:
    """All tokens but white space; comments and directives are tokens too."""
    return [Token(m.lastgroup, m.group(), m.start()) for m in _TOKEN.finditer(text) if m.lastgroup != "ws"]


def doc_kind(comment: str) -> str | None:
    """``block`` or ``line`` for documentation before a declaration, ``trailing`` for that behind one, else None."""
    if comment.startswith(("///<", "/**<", "//!<", "/*!<")):
        return "trailing"
    if comment.startswith(("/**", "/*!")):
        return None if comment.startswith(("/***", "/**/")) else "block"
    if comment.startswith(("///", "//!")):
        return None if comment.startswith("////") else "line"
    return None


def comment_text(comment: str) -> str:
    """The text of a comment without its delimiters and the decoration at the start of its lines."""
    if comment.startswith("/*"):
        body = re.sub(r"^/\*+[!<]*<?", "", comment)
        body = re.sub(r"\*+/\Z", "", body)
        lines = re.split(r"\r?\n", body)
        return "\n".join([lines[0].strip(), *(re.sub(r"^\s*\*+ ?|^\s+", "", x).rstrip() for x in lines[1:])])
    return "\n".join(re.sub(r"^\s*//[/!]*<? ?", "", x).rstrip() for x in re.split(r"\r?\n", comment))


_ESCAPE = re.compile(r"\\(?:(\r?\n)|x([0-9a-fA-F]+)|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{1,3})|(.))", re.S)
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}


def string_value(token: Token) -> str:
    """What a string literal stands for. Runs of byte escapes are read as UTF-8."""
    text = token.text
    if token.kind == "raw":
        inner = text[text.index("(") + 1 :]
        tag = text[text.index('"') + 1 : text.index("(")]
        return inner.removesuffix(f"){tag}\"")
    inner = text[text.index('"') + 1 :].removesuffix('"')
    if "\\" not in inner:
        return inner

    out: list[str] = []
    raw = bytearray()

    def flush() -> None:
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()

    at = 0
    for m in _ESCAPE.finditer(inner):
        if m.start() > at:
            flush()
            out.append(inner[at : m.start()])
        at = m.end()
        if m.group(2) or m.group(5):
            raw.append(int(m.group(2) or m.group(5), 16 if m.group(2) else 8) & 255)
            continue
        flush()
        if m.group(1):
            continue
        code = m.group(3) or m.group(4)
        if code:
            n = int(code, 16)
            out.append(chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else "�")
        else:
            out.append(_SIMPLE.get(m.group(6), m.group(6)))
    flush()
    out.append(inner[at:])
    return "".join(out)
