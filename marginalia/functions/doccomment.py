"""Documentation comments read into records: format, brief, details, tags, inline references, pages and groups.

``parse`` takes the text of a comment and gives a dictionary with the fields of DOC; ``parse_doc`` is the same as a
Spark function over a column. A null text gives null, an empty one a record without content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.clex import comment_text

_LISTS = ("notes", "warnings", "see_also", "examples", "preconditions", "postconditions", "remarks", "invariants", "todos", "bugs", "attentions", "importants")
_SCALARS = (
    "raw", "brief", "details", "returns", "deprecated", "since", "author", "version", "effects", "requires_text", "complexity", "sync", "ingroup", "exclude", "synopsis", "unique_name", "group_name", "group_heading",
    "module", "entity", "output_section", "copydoc", "copyright", "format",
)
_RECORDS = {
    "params": ("name", "description"), "tparams": ("name", "description"), "retvals": ("value", "description"), "exceptions": ("type", "description"), "tests": ("name", "file"), "snippets": ("file", "anchor", "language"),
    "dates": ("date", "description"), "refs": ("target", "display_text", "kind"), "diagrams": ("content", "caption"), "code_blocks": ("code", "language", "lineno"),
}
DOC = "struct<" + ", ".join(
    [*(f"{x}: string" for x in _SCALARS), "is_file_doc: boolean", *(f"{x}: array<string>" for x in _LISTS), *(f"{k}: array<struct<{', '.join(f'{f}: string' for f in v)}>>" for k, v in _RECORDS.items())]
) + ">"

#: Fixed: the tags that end the details.
END_TAGS = (
    "param", "tparam", "return", "returns", "retval", "deprecated", "note", "warning", "see", "sa", "since", "author", "version", "example", "pre", "post", "effects", "requires", "complexity", "remarks", "sync", "threadsafety",
    "invariant", "ensures", "ingroup", "defgroup", "exclude", "synopsis", "group", "unique_name", "module", "entity", "file", "output_section", "copydoc", "todo", "bug", "test", "snippet", "attention", "important", "date",
    "copyright", "mermaid", "code", "endcode",
)
#: Fixed: tags whose texts are appended, and tags of which the last counts, with their fields.
APPENDED = {
    "note": "notes", "warning": "warnings", "see": "see_also", "sa": "see_also", "example": "examples", "pre": "preconditions", "post": "postconditions", "ensures": "postconditions", "remarks": "remarks", "invariant": "invariants",
    "todo": "todos", "bug": "bugs", "attention": "attentions", "important": "importants",
}
LAST = {
    "since": "since", "author": "author", "version": "version", "effects": "effects", "requires": "requires_text", "complexity": "complexity", "sync": "sync", "threadsafety": "sync", "ingroup": "ingroup", "synopsis": "synopsis",
    "unique_name": "unique_name", "module": "module", "entity": "entity", "output_section": "output_section", "copydoc": "copydoc", "copyright": "copyright",
}
#: Fixed: what an absent text of a tag becomes, and the forms of exclusion.
BARE_DEPRECATED, EXCLUDED = "This is deprecated.", {"return": "return_type", "return_type": "return_type", "target": "target"}
_TAG = re.compile(r"[@\\]([A-Za-z_]+)")


def command(line: str, name: str) -> bool:
    """Whether a line begins with the command; a prefix of a longer word counts too."""
    return line[:1] in ("@", "\\") and line[1:].startswith(name)


def detect_format(text: str) -> str:
    if any(mark + word in text for word in ("param", "return", "brief") for mark in "@\\"):
        return "doxygen"
    return "markdown" if "## " in text or "### " in text else "unknown"


def _lines(text: str) -> list[str]:
    return [re.sub(r"^[ \t]*\*(?!\*)[ \t]?", "", x).strip(" \t\r") for x in text.split("\n")]


def brief_of(text: str) -> str | None:
    for line in _lines(text):
        if command(line, "brief "):
            return line[7:].strip()
        if line and line[0] not in "@\\":
            return line
    return None


def details_of(lines: list[str]) -> str | None:
    """What follows the brief line up to the first end tag; blank lines stay."""
    out: list[str] = []
    begun = False
    for line in lines:
        if not begun:
            begun = command(line, "brief ") or bool(line and line[0] not in "@\\")
            continue
        if any(command(line, t) for t in END_TAGS):
            break
        out.append(line)
    return "\n".join(out).strip(" \t\n\r*") or None


def _hide(text: str) -> str:
    return text.replace("@@", "\x01").replace("\\\\", "\x02")


def _show(text: str | None) -> str | None:
    return text if text is None else text.replace("\x01", "@").replace("\x02", "\\")


def joined_lines(lines: list[str]) -> list[str]:
    """A line behind a tag line goes on with it, until a blank line or another tag; blocks of code and diagrams stay as they are."""
    out: list[str] = []
    open_tag, block = False, None
    for line in lines:
        m = _TAG.match(line)
        if block is not None:
            out.append(line)
            if m and m.group(1) == "end" + block:
                block, open_tag = None, False
            continue
        if m:
            out.append(line)
            if m.group(1) in ("code", "mermaid"):
                block = m.group(1)
            open_tag = block is None
        elif not line:
            out.append(line)
            open_tag = False
        elif open_tag:
            out[-1] += " " + line
        else:
            out.append(line)
    return out


def inline_refs(text: str | None) -> list[dict]:
    """The targets of ``@ref``: up to white space or one of ``,.];``, parentheses kept if balanced; then a display text in quotes, wherever it follows."""
    out = []
    for m in re.finditer(r"[@\\]ref[ \t]+", text or ""):
        at, depth, n = m.end(), 0, m.end()
        while n < len(text):
            c = text[n]
            if c == "(":
                depth += 1
            elif c == ")":
                if depth == 0:
                    break
                depth -= 1
            elif depth == 0 and (c.isspace() or c in ",.];"):
                break
            n += 1
        if n == at:
            continue
        quoted = re.search(r'"([^"]*)"', text[n:])
        out.append({"target": text[at:n], "display_text": quoted.group(1) if quoted else None, "kind": "symbol"})
    return out


def _two(rest: str) -> tuple[str, str]:
    a, _, b = rest.partition(" ")
    return a, b.strip()


def parse(text: str | None) -> dict | None:
    if text is None:
        return None
    doc: dict = {k: None for k in _SCALARS} | {"is_file_doc": False} | {k: [] for k in (*_LISTS, *_RECORDS)}
    doc["raw"], doc["format"] = text, detect_format(text)
    doc["brief"] = brief_of(text)
    if doc["format"] != "doxygen":
        return doc
    lines = _lines(_hide(text))
    doc["brief"], doc["details"] = _show(brief_of("\n".join(lines))), _show(details_of(lines))
    body = joined_lines(lines)
    n = 0
    while n < len(body):
        line = body[n]
        n += 1
        m = _TAG.match(line)
        if not m:
            continue
        tag, rest = m.group(1), line[m.end() :]
        options = None
        if rest.startswith("{"):
            options, _, rest = rest[1:].partition("}")
        elif rest and not rest[0].isspace() and tag not in ("code", "mermaid"):
            continue  # @param[in] is no @param
        rest = rest.strip()
        if tag in ("code", "mermaid"):
            inner = []
            while n < len(body) and not command(body[n], "end" + tag):
                inner.append(body[n])
                n += 1
            n += 1
            if tag == "code":
                kinds = [x.strip() for x in (options or "").split(",") if x.strip()]
                doc["code_blocks"].append({"code": "\n".join(inner), "language": next((k.lstrip(".") for k in kinds if k != "lineno"), None), "lineno": str("lineno" in kinds).lower()})
            else:
                doc["diagrams"].append({"content": "\n".join(inner), "caption": rest or None})
        elif tag in ("param", "tparam"):
            name, description = _two(rest)
            if name:
                doc[tag + "s"].append({"name": name, "description": _show(description)})
        elif tag in ("return", "returns"):
            doc["returns"] = _show(rest)
        elif tag == "retval":
            value, description = _two(rest)
            doc["retvals"].append({"value": value, "description": description})
        elif tag in ("throw", "exception"):
            kind, description = _two(rest)
            doc["exceptions"].append({"type": kind, "description": description})
        elif tag == "deprecated":
            doc["deprecated"] = rest or BARE_DEPRECATED
        elif tag == "exclude":
            doc["exclude"] = EXCLUDED.get(rest, "full")
        elif tag == "group":
            doc["group_name"], heading = _two(rest)
            doc["group_heading"] = heading or None
        elif tag == "file":
            doc["is_file_doc"] = True
        elif tag == "test":
            name, file = _two(rest)
            if name:
                doc["tests"].append({"name": name, "file": file or None})
        elif tag == "snippet":
            parts = rest.split()
            if len(parts) >= 2:
                doc["snippets"].append({"file": parts[0], "anchor": parts[1], "language": parts[2] if len(parts) > 2 else None})
        elif tag == "date":
            day, description = _two(rest)
            doc["dates"].append({"date": day, "description": description.strip("() ") or None})
        elif tag == "ref":
            target, after = _two(rest)
            quoted = re.search(r'"([^"]*)"', after)
            if target:
                doc["refs"].append({"target": target, "display_text": quoted.group(1) if quoted else None, "kind": "symbol"})
        elif tag in APPENDED:
            if rest:
                doc[APPENDED[tag]].append(rest)
        elif tag in LAST:
            if rest:
                doc[LAST[tag]] = rest
    for source in (
        [doc["brief"], doc["details"]], doc["notes"], doc["warnings"], [p["description"] for p in doc["params"]], [doc["returns"]], doc["preconditions"], doc["postconditions"], doc["remarks"], doc["see_also"],
        doc["attentions"], doc["importants"], [doc["deprecated"]], [p["description"] for p in doc["tparams"]], [e["description"] for e in doc["exceptions"]],
    ):
        for part in source:
            doc["refs"] += inline_refs(part)
    return doc


def parse_page(text: str) -> dict | None:
    """A page comment: id, title (the id if absent), content and whether it is the main page."""
    lines = _lines(text)
    for n, line in enumerate(lines):
        if command(line, "mainpage"):
            return {"id": "mainpage", "title": line[9:].strip() or "mainpage", "content": "\n".join(lines[n + 1 :]).strip(), "is_mainpage": True}
        if command(line, "page "):
            page_id, title = _two(line[6:].strip())
            return {"id": page_id, "title": title or page_id, "content": "\n".join(lines[n + 1 :]).strip(), "is_mainpage": False} if page_id else None
    return None


def parse_group(text: str) -> dict | None:
    """A group comment: id, name and the brief on the next line; the first match counts."""
    lines = _lines(text)
    for n, line in enumerate(lines):
        if command(line, "defgroup "):
            group_id, name = _two(line[10:].strip())
            following = next((x for x in lines[n + 1 : n + 2] if x and x[0] not in "@\\"), None)
            if following is None and n + 1 < len(lines) and command(lines[n + 1], "brief "):
                following = lines[n + 1][7:].strip()
            return {"id": group_id, "name": name or group_id, "brief": following}
        if command(line, "addtogroup "):
            group_id = _two(line[12:].strip())[0]
            return {"id": group_id, "name": group_id, "brief": None}
    return None


def strip_delimiters(comment: str) -> str:
    """A comment's text; a run of line comments is one."""
    parts = [comment] if comment.lstrip().startswith("/*") else comment.split("\n")
    return "\n".join(comment_text(p.strip()) for p in parts)


def _records(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    blank = {k: None for k in (*_SCALARS, "is_file_doc", *_LISTS, *_RECORDS)}
    for part in texts:
        yield pd.DataFrame([parse(t) or blank for t in part], columns=list(blank))


def parse_doc(text: Column) -> Column:
    """The record of each text, as a struct column; Arrow batches, no row-at-a-time calls."""
    _records.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(_records, DOC)(text)
