"""Scalar functions and predicates on columns. All stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: file names that are headers, and those read as C++.
HEADERS, CPP = r"\.(h|hpp|hxx|hh|H)$", r"\.(cpp|cxx|cc|hpp|hxx|hh|C|H)$"
#: Fixed: distance of strings of which one is longer than FAR_BYTES.
FAR, FAR_BYTES = 100, 20
#: Fixed: comment styles by the end of a file's name: opening and closing mark; all other files have LINE_STYLE.
COMMENT_STYLES = (
    ((".py", ".sh", ".bash", ".zsh", ".rb", ".pl", ".yaml", ".yml", ".toml", "Makefile", ".mk", ".cmake", ".conf", ".ini", ".dockerfile", "Dockerfile"), ("#", "")),
    ((".css", ".scss", ".less"), ("/*", "*/")),
    ((".html", ".htm", ".xml", ".svg", ".xhtml"), ("<!--", "-->")),
    ((".sql",), ("--", "")),
    ((".lua",), ("--", "")),
    ((".lisp", ".scm", ".clj", ".el"), (";", "")),
)
LINE_STYLE = ("//", "")
#: Fixed: languages by the end of a file's name; DEFAULT_LANGUAGE else.
LANGUAGES = ((("cpp", "hpp", "cc", "cxx", "hxx", "hh"), "cpp"), (("c", "h"), "c"), (("py",), "python"), (("rs",), "rust"), (("zig",), "zig"), (("js", "ts"), "javascript"))
DEFAULT_LANGUAGE = "cpp"
#: Fixed: where compiled examples are shown.
EXPLORER = "https://godbolt.org"


def is_header(path: Column) -> Column:
    return path.rlike(HEADERS)


def is_cpp(path: Column) -> Column:
    return path.rlike(CPP)


def glob_regex(pattern: str) -> str:
    """``*`` is any run of characters, ``?`` any one, also ``/``; all else stands for itself."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def glob(text: Column, pattern: str) -> Column:
    return text.rlike(glob_regex(pattern))


def glob_any(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (glob(text, p) for p in patterns), F.lit(False))


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance; if one is empty the other's length, if one is longer than FAR_BYTES then FAR."""
    la, lb = F.octet_length(a), F.octet_length(b)
    return F.when(la == 0, lb).when(lb == 0, la).when(F.greatest(la, lb) > FAR_BYTES, F.lit(FAR)).otherwise(F.levenshtein(a, b))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def anchor(name: Column) -> Column:
    """ASCII letters in lower case, ``_`` and blank as ``-``."""
    return F.translate(name, _UPPER + "_ ", _LOWER + "--")


def index_anchor(name: Column) -> Column:
    return F.translate(name, _UPPER, _LOWER)


def short_name(name: Column) -> Column:
    return F.substring_index(name, "::", -1)


def short_key(key: Column) -> Column:
    """The short name of a symbol's key; a signature keeps its parameters, whose ``::`` don't count."""
    return F.regexp_replace(key, r"^[^(]*::", "")


def signature(name: Column, types: Column) -> Column:
    """``f(T1, T2)``; without parameters the name alone."""
    return F.when(F.size(types) > 0, F.concat(name, F.lit("("), F.array_join(types, ", "), F.lit(")"))).otherwise(name)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def header_title(path: Column) -> Column:
    """The file's name without ``.h`` or ``.hpp``."""
    return F.regexp_replace(basename(path), r"\.(h|hpp)$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def relative_link(target: Column, here: Column) -> Column:
    """Empty within one file, else the target's stem as a page."""
    return F.when(basename(target) == basename(here), F.lit("")).otherwise(F.concat(F.regexp_replace(basename(target), r"\.(h|hpp|hxx)$", ""), F.lit(".md")))


def html_escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def percent_encode(text: Column) -> Column:
    """All bytes but letters, digits and ``-_.~``."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def explorer_url(code: Column, compiler: str = "g132", options: str = "-O2 -std=c++20") -> Column:
    return F.concat(F.lit(f"{EXPLORER}/#{compiler}:"), percent_encode(F.lit(options)), F.lit(":"), percent_encode(code))


def explorer_markdown(code: Column, **options) -> Column:
    return F.concat(F.lit("[Try on Compiler Explorer]("), explorer_url(code, **options), F.lit(")"))


def explorer_html(code: Column, **options) -> Column:
    return F.concat(F.lit('<a href="'), explorer_url(code, **options), F.lit('" target="_blank">Try on Compiler Explorer</a>'))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def path_to_uri(path: Column) -> Column:
    return F.concat(F.lit("file://"), path)


def uri_to_path(uri: Column) -> Column:
    return F.regexp_replace(uri, "^file://", "")


def text_offset(text: Column, line: Column, character: Column) -> Column:
    """Byte offset of a 0-based line and character, both counted in bytes; not beyond the text."""
    before = F.slice(F.split(text, "\n"), F.lit(1), line)
    start = F.aggregate(before, F.lit(0), lambda n, x: n + F.octet_length(x) + 1)
    return F.least(start + character, F.octet_length(text))


def splice(text: Column, start: Column, end: Column, new: Column) -> Column:
    """Bytes ``start`` to ``end`` replaced."""
    raw = F.encode(text, "UTF-8")
    size = F.octet_length(text)
    return F.make_valid_utf8(F.concat(F.substring(raw, F.lit(1), start), F.encode(new, "UTF-8"), F.substring(raw, end + 1, size)).cast("string"))


def comment_marks(path: Column) -> tuple[Column, Column]:
    """Opening and closing mark of comments in a file."""
    out = [F.lit(LINE_STYLE[0]), F.lit(LINE_STYLE[1])]
    for ends, marks in reversed(COMMENT_STYLES):
        hit = reduce(lambda a, b: a | b, (path.endswith(e) for e in ends))
        out = [F.when(hit, F.lit(m)).otherwise(o) for m, o in zip(marks, out)]
    return out[0], out[1]


def snippet_marker(path: Column, name: Column) -> Column:
    """The comment that marks an excerpt in a file."""
    head, tail = comment_marks(path)
    return F.concat(head, F.lit(" ["), name, F.lit("]"), F.when(tail != "", F.concat(F.lit(" "), tail)).otherwise(F.lit("")))


def language(path: Column) -> Column:
    ext = F.regexp_extract(path, r"\.([^./]*)$", 1)
    out = F.lit(DEFAULT_LANGUAGE)
    for ends, name in LANGUAGES:
        out = F.when(ext.isin(*ends), F.lit(name)).otherwise(out)
    return out


def between_markers(text: Column, marker: Column) -> Column:
    """What stands between the first and the second marker, without line ends around it; null if there are not two."""
    a = F.instr(text, marker)
    rest = F.substr(text, a + F.length(marker))
    b = F.instr(rest, marker)
    return F.when((a > 0) & (b > 0), F.regexp_replace(F.substr(rest, F.lit(1), b - 1), r"^[\r\n]+|[\r\n]+$", ""))


def snippet(path: Column, text: Column, name: Column) -> Column:
    """An excerpt by the file's own comment style, else by ``//``."""
    return F.coalesce(between_markers(text, snippet_marker(path, name)), between_markers(text, F.concat(F.lit("// ["), name, F.lit("]"))))


def class_simple_name(name: Column) -> Column:
    """Without template arguments and namespaces."""
    return F.substring_index(F.regexp_replace(F.substring_index(name, "<", 1), r"\s+$", ""), "::", -1)


def namespace_hidden(qualified: Column, names: list[str]) -> Column:
    """Whether one of ``names`` is a component of the qualified name; only its first occurrence is looked at."""
    out = F.lit(False)
    for n in names:
        at = F.instr(qualified, F.lit(n))
        ahead = (at == 1) | (F.substr(qualified, at - 2, F.lit(2)) == "::")
        behind = (F.substr(qualified, at + len(n), F.lit(2)) == "::") | (at + len(n) > F.length(qualified))
        out = out | ((at > 0) & ahead & behind)
    return out


def is_void(return_type: Column) -> Column:
    return F.trim(F.translate(return_type, "\t", " ")).isin("", "void")


def has_docs(doc: Column) -> Column:
    return F.coalesce(doc.isNotNull() & (doc["brief"].isNotNull() | doc["details"].isNotNull() | (doc["raw"] != "")), F.lit(False))


def is_anchor_id(text: Column) -> Column:
    return text.rlike("^[A-Za-z0-9_-]+$")


def base_type(text: Column) -> Column:
    """A type without qualifiers, pointers, references and template arguments."""
    bare = F.regexp_replace(text, r"\b(const|volatile|struct|enum|union|class)\b", "")
    return F.trim(F.regexp_replace(F.substring_index(F.regexp_replace(bare, r"[*&].*$", ""), "<", 1), r"\s+", " "))


def external_url(template: Column, rest: Column) -> Column:
    return F.replace(template, F.lit("$$"), rest)


def truncate_brief(brief: Column, limit: int = 60) -> Column:
    """A text longer than ``limit`` bytes is cut, on a character's edge, and gets ``...``."""
    begun = F.length(F.make_valid_utf8(F.substring(F.encode(brief, "UTF-8"), 1, limit).cast("string")))  # the last of these characters may be a part
    cut = F.substring(brief, F.lit(1), begun - (F.octet_length(F.substring(brief, F.lit(1), begun)) > limit).cast("int"))
    cut = F.when(F.octet_length(brief) == F.length(brief), F.substring(brief, 1, limit)).otherwise(cut)
    return F.when(F.octet_length(brief) > limit, F.concat(cut, F.lit("..."))).otherwise(brief)


def prefix_group(name: Column) -> Column:
    """What stands before the first ``_`` if it is at least two bytes long, else ``misc``."""
    return F.when(F.instr(name, F.lit("_")) >= 3, F.substring_index(name, "_", 1)).otherwise(F.lit("misc"))


def percentage(part: Column, total: Column) -> Column:
    """100 if there is nothing."""
    return F.when(total == 0, F.lit(100.0)).otherwise(part * 100.0 / total)


def enum_value(text: Column) -> Column:
    """Numbers in decimal, ``0x``, ``0b`` and ``0o``; null if it is none."""
    t = F.lower(F.regexp_replace(F.trim(text), "'", ""))
    sign = F.when(t.startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    t = F.regexp_replace(t, r"^[-+]", "")
    num = F.when(t.rlike("^0x[0-9a-f]+$"), F.conv(F.substr(t, F.lit(3)), 16, 10)).when(t.rlike("^0b[01]+$"), F.conv(F.substr(t, F.lit(3)), 2, 10)).when(t.rlike("^0o[0-7]+$"), F.conv(F.substr(t, F.lit(3)), 8, 10)).when(t.rlike(r"^\d+$"), t)
    return sign * num.try_cast("bigint")
