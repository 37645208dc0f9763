"""Syntax trees of the declarations in C and C++ text.

A tree has nodes for namespaces, classes, structs, unions, enums, functions, methods, fields, type definitions,
aliases, concepts, macros and includes. Function bodies are skipped. Broken text never raises: what can't be read
as a declaration is passed over up to the next ``;`` or ``}``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from marginalia.functions.clex import Lines, Token, comment_text, doc_kind, tokens

#: Fixed words of the language.
SPECIFIERS = {"inline", "static", "extern", "virtual", "explicit", "constexpr", "consteval", "constinit", "friend", "mutable", "thread_local", "register", "_Noreturn", "__inline", "__inline__", "__extension__", "__forceinline"}
NOT_NAMES = {
    "alignas", "alignof", "decltype", "noexcept", "__attribute__", "__declspec", "requires", "throw", "sizeof", "return", "if", "while", "for", "switch", "catch", "typeof", "__typeof__", "static_assert", "_Static_assert", "asm", "__asm__", "defined",
    "int", "char", "void", "bool", "float", "double", "long", "short", "unsigned", "signed", "auto", "const", "volatile", "wchar_t", "char8_t", "char16_t", "char32_t", "_Bool", "class", "struct", "union", "enum", "typename", "template", "using", "typedef", "namespace", "new", "delete", "else", "do",
}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Param:
    name: str
    type: str
    default: str | None = None


@dataclass
class Node:
    kind: str
    name: str
    qualified: str
    namespace: str | None
    line: int
    column: int
    begin_line: int
    end_line: int
    start: int
    end: int
    depth: int = 0
    parent: Node | None = None
    access: str | None = None
    return_type: str | None = None
    params: list[Param] = field(default_factory=list)
    tparams: list[Param] = field(default_factory=list)
    flags: set[str] = field(default_factory=set)
    bases: list[tuple[str, str, bool]] = field(default_factory=list)
    values: list[tuple[str, str | None]] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    text: str | None = None
    doc: str | None = None
    doc_trailing: bool = False
    requires: str | None = None
    doc_near: str | None = None  # the documentation comment next before the declaration, whatever stands between them but code
    begin_column: int = 1


def _join(words: list[str]) -> str:
    """Type text from tokens: a blank between two words, and before ``*`` or ``&`` none."""
    out = ""
    for w in words:
        if out and (w[0].isalnum() or w[0] == "_" or w == "~") and (out[-1].isalnum() or out[-1] in "_>*&,"):
            out += " "
        out += w
    return out


def _type(words: list[str]) -> str:
    """Type text in the usual spelling: ``char *``, ``const T &``, ``char *const``."""
    return re.sub(r"([*&])\s+(const|volatile)\b", r"\1\2", re.sub(r"(?<=[\w>\]])\s*([*&]+)", r" \1", _join(words)))


class Parser:
    def __init__(self, text: str, cpp: bool = True):
        self.text, self.cpp, self.lines = text, cpp, Lines(text)
        self.toks: list[Token] = []
        self.comments: list[Token] = []
        self.nodes: list[Node] = []
        for t in tokens(text):
            (self.comments if t.kind in ("lc", "bc") else self.toks).append(t)
        self.i = 0
        self.by_end: dict[int, int] = {}  # line on which a comment ends -> its number
        for n, c in enumerate(self.comments):
            self.by_end[self.lines.line(c.start + len(c.text) - 1)] = n
        self.comment_starts = [c.start for c in self.comments]
        self.by_start: dict[int, list[int]] = {}
        for n, c in enumerate(self.comments):
            self.by_start.setdefault(self.lines.line(c.start), []).append(n)

    # -- helpers -------------------------------------------------------------------------------------------------

    def is_(self, i: int, text: str) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].text == text and self.toks[i].kind in ("p", "id")

    def match(self, i: int) -> int:
        """Index of the bracket that closes the one at ``i``, or the last token."""
        depth = 0
        while i < len(self.toks):
            t = self.toks[i]
            if t.kind == "p":
                if t.text in OPEN:
                    depth += 1
                elif t.text in CLOSE:
                    depth -= 1
                    if depth == 0:
                        return i
            i += 1
        return len(self.toks) - 1

    def angle(self, i: int) -> int | None:
        """Index of the ``>`` that closes the ``<`` at ``i``, or None if it is no bracket."""
        depth = 0
        while i < len(self.toks):
            t = self.toks[i]
            if t.kind == "p":
                if t.text == "<":
                    depth += 1
                elif t.text == ">":
                    depth -= 1
                    if depth == 0:
                        return i
                elif t.text in ("(", "["):
                    i = self.match(i)
                elif t.text in (";", "{", "}", ")", "]"):
                    return None
            i += 1
        return None

    # -- documentation -------------------------------------------------------------------------------------------

    def doc_before(self, line: int) -> str | None:
        """The documentation comment that ends on the line before ``line``; a run of line comments is one."""
        n = self.by_end.get(line - 1)
        if n is None:
            return None
        c = self.comments[n]
        kind = doc_kind(c.text)
        if kind == "block":
            end = c.start + len(c.text)
            return c.text if not self.text[end : self.lines.starts[line - 1]].strip() else None  # code behind it is what it documents
        if kind != "line":
            return None
        first = n
        while first > 0 and doc_kind(self.comments[first - 1].text) == "line" and self.lines.line(self.comments[first - 1].start) == self.lines.line(self.comments[first].start) - 1 and not self._code_before(self.comments[first - 1].start):
            first -= 1
        return "\n".join(x.text for x in self.comments[first : n + 1])

    def doc_behind(self, offset: int) -> str | None:
        """A trailing documentation comment behind ``offset`` on its line."""
        line = self.lines.line(offset)
        for n in self.by_start.get(line, ()):
            c = self.comments[n]
            if c.start > offset and c.text.startswith(("///<", "/**<")):
                if c.text.startswith("/**<"):
                    return c.text
                run = [c.text]
                while n + 1 < len(self.comments) and self.comments[n + 1].text.startswith("///<") and self.lines.line(self.comments[n + 1].start) == line + len(run) and not self._code_before(self.comments[n + 1].start):
                    n += 1
                    run.append(self.comments[n].text)
                return "\n".join(run)
        return None

    def doc_near(self, start: int) -> str | None:
        """The last documentation comment before ``start`` if no code stands between."""
        n = bisect_left(self.comment_starts, start) - 1
        while n >= 0:
            c = self.comments[n]
            if self.text[c.start + len(c.text) : self.comments[n + 1].start if n + 1 < len(self.comments) and self.comments[n + 1].start < start else start].strip():
                return None
            kind = doc_kind(c.text)
            if kind == "block":
                return c.text
            if kind == "line":
                first = n
                while first > 0 and doc_kind(self.comments[first - 1].text) == "line" and not self.text[self.comments[first - 1].start + len(self.comments[first - 1].text) : self.comments[first].start].strip():
                    first -= 1
                return "\n".join(x.text for x in self.comments[first : n + 1])
            if kind == "trailing":
                return None
            n -= 1
        return None

    def _code_before(self, offset: int) -> bool:
        return bool(self.text[self.lines.starts[self.lines.line(offset) - 1] : offset].strip())

    # -- scopes --------------------------------------------------------------------------------------------------

    def parse(self) -> list[Node]:
        # An open scope: (namespace path, class node or None, access); a stack instead of recursion, so depth has no limit.
        stack: list[list] = [[None, None, None]]
        while self.i < len(self.toks):
            t = self.toks[self.i]
            if t.kind == "pp":
                self.directive(t)
                self.i += 1
            elif t.text == "}" and t.kind == "p":
                closed = stack.pop() if len(stack) > 1 else None
                self.i += 1
                if closed and closed[1] is not None:
                    cls = closed[1]
                    cls.end_line, cls.end = self.lines.line(t.start), t.start + 1
                    while self.i < len(self.toks) and not (self.toks[self.i].kind == "p" and self.toks[self.i].text in ";}{") and self.toks[self.i].kind != "pp":  # declarators behind the class
                        if not cls.name and self.toks[self.i].kind == "id":
                            cls.name = cls.qualified = self.toks[self.i].text
                        self.i += 1
            elif t.kind == "p" and t.text in ";)]":
                self.i += 1
            elif t.text == "namespace" or (t.text == "inline" and self.is_(self.i + 1, "namespace")):
                self.namespace(stack)
            elif t.text == "extern" and self.i + 2 < len(self.toks) and self.toks[self.i + 1].kind == "str" and self.is_(self.i + 2, "{"):
                self.i += 3
                stack.append([stack[-1][0], stack[-1][1] and None, None])
            elif stack[-1][1] is not None and t.text in ("public", "private", "protected") and self._label():
                stack[-1][2] = t.text
            else:
                self.declaration(stack)
        for node in self.nodes:
            node.begin_column = self.lines.column(node.start)
            node.doc_near = node.doc if node.doc is not None else self.doc_near(node.start)
        return self.nodes

    def _label(self) -> bool:
        j = self.i + 1
        if j < len(self.toks) and self.toks[j].kind == "id":  # public slots:
            j += 1
        if self.is_(j, ":"):
            self.i = j + 1
            return True
        return False

    def namespace(self, stack: list) -> None:
        j, names = self.i, []
        while j < len(self.toks) and not (self.toks[j].kind == "p" and self.toks[j].text in "{;=}"):
            if self.is_(j, "["):
                j = self.match(j)
            elif self.toks[j].kind == "id" and self.toks[j].text not in ("inline", "namespace"):
                names.append(self.toks[j].text)
            j += 1
        if self.is_(j, "{"):
            path = "::".join(x for x in (stack[-1][0], "::".join(names) or "anonymous") if x)
            stack.append([path, None, None])
            self.i = j + 1
        else:  # an alias of a namespace
            while j < len(self.toks) and not self.is_(j, ";"):
                j += 1
            self.i = j + 1

    def directive(self, t: Token) -> None:
        text = re.sub(r"\\\r?\n", " ", t.text).strip()
        hash_at = t.start + t.text.index("#")
        line, col = self.lines.line(hash_at), self.lines.column(hash_at)
        end = t.start + len(t.text.rstrip()) - 1
        m = re.match(r"#\s*include\s*(<([^>]*)>|\"([^\"]*)\")", text)
        if m:
            self.nodes.append(Node("include", m.group(2) or m.group(3) or "", m.group(2) or m.group(3) or "", None, line, col, line, line, hash_at, end + 1, flags={"is_system"} if m.group(2) is not None else set()))
            return
        m = re.match(r"#\s*define\s+(\w+)(\(([^)]*)\))?\s*(.*)", text, re.S)
        if m:
            node = Node("macro", m.group(1), m.group(1), None, line, col, line, self.lines.line(end), hash_at, end + 1, text=m.group(4).strip() or None)
            if m.group(2):
                node.flags.add("is_function_like")
                node.params = [Param(x.strip(), "") for x in m.group(3).split(",") if x.strip()]
            self._document(node, end)
            self.nodes.append(node)

    def _document(self, node: Node, end: int) -> None:
        before = self.doc_before(node.begin_line)
        node.doc = before
        if before is None:
            node.doc = self.doc_behind(end)
            node.doc_trailing = node.doc is not None

    # -- declarations --------------------------------------------------------------------------------------------

    def declaration(self, stack: list) -> None:
        ns, cls, access = stack[-1]
        begin = j = self.i
        tparams: list[Param] = []
        head: list[int] = []  # tokens of the head at depth 0; a bracketed group stands there as its opening bracket
        attributes: list[str] = []
        name_at = paren = None  # of a function: first token of its name, its opening parenthesis
        name = ""
        assigned = False
        self.requires = None
        end = len(self.toks)
        body = None
        while j < end:
            t = self.toks[j]
            if t.kind == "pp":
                j += 1
                continue
            if t.kind == "id":
                if t.text == "template" and self.is_(j + 1, "<"):
                    close = self.angle(j + 1)
                    if close is not None:
                        tparams += self._tparams(j + 2, close)
                        j = close + 1
                        continue
                if t.text == "requires" and (tparams or paren is not None):
                    k = self._constraint(j + 1)
                    last = self.toks[max(j, min(k, len(self.toks)) - 1)]
                    self.requires = self.text[t.start + len(t.text) : last.start + len(last.text)].strip() or None
                    j = max(k, j + 1)
                    continue
                if t.text == "operator" and paren is None and not assigned:
                    k, words = j + 1, []
                    if self.is_(k, "(") and self.is_(k + 1, ")"):
                        words, k = ["()"], k + 2
                    while k < end and not (self.toks[k].kind == "p" and self.toks[k].text in "(;{}"):
                        words.append(self.toks[k].text)
                        k += 1
                    symbol = bool(words) and not re.match(r"[\w\"]", words[0])
                    if self.is_(k, "("):
                        name = "operator" + ("".join(words) if symbol else ((" " if words and words[0] != '""' and not words[0].startswith('""') else "") + _join(words)))
                        name_at, paren = j, k
                        head += [j, k]
                        j = self.match(k) + 1
                        continue
                head.append(j)
            elif t.text == "[" and self.is_(j + 1, "["):
                close = self.match(j)
                attributes.append(self.text[self.toks[j].start + 2 : self.toks[max(j, close - 1)].start].strip())
                j = close + 1
                continue
            elif t.text == "<" and head and self.toks[head[-1]].kind == "id" and self.cpp and paren is None:
                close = self.angle(j)
                if close is not None:
                    head.append(j)
                    j = close + 1
                    continue
                head.append(j)
            elif t.text in ("(", "["):
                close = self.match(j)
                if t.text == "(" and paren is None and not assigned:
                    p = head[-1] if head else None
                    if p is not None and self.toks[p].text == "<":  # f<int>(...)
                        p = head[-2] if len(head) > 1 else None
                    if p is not None and self.toks[p].kind == "id" and self.toks[p].text not in NOT_NAMES and self.toks[p].text not in SPECIFIERS:
                        inner = self.toks[j + 1] if j + 1 < close else None
                        pointer = inner is not None and inner.kind == "p" and inner.text in ("*", "&", "^", "&&")
                        value = inner is not None and inner.kind in ("num", "str", "chr", "raw")
                        if not pointer and not value:
                            paren, name_at = j, p
                            if self.is_(p - 1, "~"):
                                name_at = p - 1
                            name = ("~" if name_at == p - 1 else "") + self.toks[p].text
                head.append(j)
                j = close + 1
                continue
            elif t.text == "=":
                assigned = True
                head.append(j)
            elif t.text == ":" and paren is not None and not assigned:
                j = self._initializers(j + 1)
                continue
            elif t.text == "{":
                if assigned and paren is None:
                    head.append(j)
                    j = self.match(j) + 1
                    continue
                body = j
                break
            elif t.text in (";", "}"):
                break
            elif t.text == "," and paren is not None and head and head[-1] == paren and not assigned:
                paren = None  # int a(x), b;
                assigned = True
                head.append(j)
            else:
                head.append(j)
            j += 1
        words = [self.toks[k].text for k in head]
        keyword = next((w for w in words if w in ("class", "struct", "union", "enum")), None)
        if paren is not None and "typedef" not in words and "using" not in words and not (keyword and name in ("", keyword)):
            before = head[: head.index(name_at)] if name_at in head else [k for k in head if k < name_at]
            if self._function(begin, name, name_at, paren, before, head, body, j, stack, tparams, attributes):
                return
            if body is not None:  # a macro with a block
                self.i = self.match(body) + 1
                return
            self.i = j + (1 if self.is_(j, ";") else 0)
            if self.i == begin:
                self.i += 1
            return
        if body is not None and keyword:
            self._class(begin, keyword, head, body, stack, tparams, attributes)
            return
        if body is not None:
            if not head:
                self.i = self.match(body) + 1
                return
            j = self.match(body) + 1  # an initializer in braces
            while j < end and not (self.toks[j].kind == "p" and self.toks[j].text in ";}{") and self.toks[j].kind != "pp":
                j += 1
        self._other(begin, head, words, j, stack, tparams, attributes, access)
        self.i = j + (1 if self.is_(j, ";") else 0)
        if self.i == begin:
            self.i += 1

    def _constraint(self, j: int) -> int:
        """From behind ``requires`` to what follows the constraint: terms joined by ``&&`` or ``||``."""
        while j < len(self.toks):
            while self.is_(j, "!"):
                j += 1
            if self.is_(j, "requires"):
                j += 1
                if self.is_(j, "("):
                    j = self.match(j) + 1
                if self.is_(j, "{"):
                    j = self.match(j) + 1
            elif self.is_(j, "("):
                j = self.match(j) + 1
            elif j < len(self.toks) and self.toks[j].kind in ("id", "num"):
                j += 1
                while True:
                    if self.is_(j, "<"):
                        close = self.angle(j)
                        if close is None:
                            break
                        j = close + 1
                    elif self.is_(j, "::"):
                        j += 2
                    else:
                        break
            if not (self.is_(j, "&&") or self.is_(j, "||")):
                return j
            j += 1
        return j

    def _initializers(self, j: int) -> int:
        """From behind the colon of a constructor to its body."""
        while j < len(self.toks):
            t = self.toks[j]
            if t.kind == "p" and t.text in ("(",):
                j = self.match(j) + 1
            elif t.kind == "p" and t.text == "{":
                if self.toks[j - 1].kind == "id" or self.is_(j - 1, ">"):
                    j = self.match(j) + 1
                else:
                    return j
            elif t.kind == "p" and t.text in (";", "}"):
                return j
            else:
                j += 1
        return j

    def _function(self, begin, name, name_at, paren, before, head, body, j, stack, tparams, attributes) -> bool:
        ns, cls, access = stack[-1]
        if body is None and not self.is_(j, ";"):
            return False
        words = [self.toks[k].text for k in before]
        scope: list[str] = []  # Box:: in front of the name
        k = len(before)
        while k >= 2 and words[k - 1] == "::" and self.toks[before[k - 2]].kind == "id" and name_at - before[k - 1] <= 1:
            scope.insert(0, words[k - 2])
            k -= 2
            break
        while k >= 2 and scope and words[k - 1] == "::" and self.toks[before[k - 2]].kind == "id":
            scope.insert(0, words[k - 2])
            k -= 2
        if words[:k] and words[k - 1] == "~":
            k -= 1
        typed = [w for w in words[:k] if w not in SPECIFIERS and w != "~"]
        owner = cls.name.rpartition("::")[2] if cls is not None and cls.name else (scope[-1] if scope else None)
        special = name.startswith(("~", "operator ")) or (owner is not None and name == owner)
        if not typed and not special:
            if not name.startswith("operator"):
                return False
        if "return" in typed or "=" in words[:k] or (typed and typed[0] in ("else", "case", "goto", "delete", "new", "throw")):
            return False
        if typed and typed[0] in ("friend",):
            typed = typed[1:]
        after = [self.toks[x].text for x in head if x > paren]
        end_token = self.match(body) if body is not None else min(j, len(self.toks) - 1)
        end = self.toks[end_token].start
        raw_type = self._type_text(before[:k])
        name_start = self.toks[name_at].start
        method = cls is not None
        qualified = "::".join(x for x in ((cls.qualified if cls is not None else ns), *scope, name) if x)
        node = Node(
            "method" if method else "function", name, qualified, ns, self.lines.line(name_start), self.lines.column(name_start), self.lines.line(self.toks[begin].start), self.lines.line(end),
            self.toks[begin].start, end + 1, parent=cls, depth=0 if cls is None else cls.depth + 1, access=access if method else None, return_type=raw_type or ("void" if method else None), tparams=tparams, attributes=attributes,
        )
        node.params = self._params(paren + 1, self.match(paren))
        node.requires = self.requires
        marks = {"static": "is_static", "inline": "is_inline", "virtual": "is_virtual", "explicit": "is_explicit", "constexpr": "is_constexpr", "extern": "is_extern", "friend": "is_friend"}
        node.flags |= {marks[w] for w in words if w in marks}
        late = {"const": "is_const", "noexcept": "is_noexcept", "override": "is_override", "final": "is_final", "default": "is_default", "delete": "is_deleted", "volatile": "is_volatile"}
        node.flags |= {late[w] for w in after if w in late}
        if "=" in after and after[after.index("=") + 1 : after.index("=") + 2] == ["0"]:
            node.flags |= {"is_pure_virtual", "is_virtual"}
        if any(p.type == "..." or p.name == "..." for p in node.params):
            node.flags.add("is_variadic")
        if body is not None:
            node.flags.add("has_body")
        node.text = self.text[node.start : (self.toks[body].start if body is not None else end)].strip()
        head_end = self.toks[body].start if body is not None else end
        node.doc = self.doc_before(node.begin_line)
        if node.doc is None:
            node.doc = self.doc_behind(end) or (self.doc_behind(head_end) if body is not None else None)
            node.doc_trailing = node.doc is not None
        self.nodes.append(node)
        self.i = end_token + 1
        return True

    def _type_text(self, idx: list[int]) -> str:
        out: list[str] = []
        for n, k in enumerate(idx):
            t = self.toks[k]
            if t.text in SPECIFIERS:
                continue
            if t.text == "<" and t.kind == "p":
                close = self.angle(k)
                out.append(_join([x.text for x in self.toks[k : (close or k) + 1]]))
            elif t.text in OPEN:
                out.append(self.text[t.start : self.toks[self.match(k)].start + 1])
            else:
                out.append(t.text)
        return _type(out)

    def _split(self, first: int, last: int) -> list[list[int]]:
        parts, cur, k = [], [], first
        while k < last:
            t = self.toks[k]
            if t.kind == "pp":
                k += 1
                continue
            if t.text in OPEN and t.kind == "p":
                close = min(self.match(k), last)
                cur += range(k, close + 1)
                k = close + 1
                continue
            if t.text == "<" and t.kind == "p" and cur and self.toks[cur[-1]].kind == "id":
                close = self.angle(k)
                if close is not None and close < last:
                    cur += range(k, close + 1)
                    k = close + 1
                    continue
            if t.text == "," and t.kind == "p":
                parts.append(cur)
                cur = []
            else:
                cur.append(k)
            k += 1
        parts.append(cur)
        return [p for p in parts if p]

    def _params(self, first: int, last: int) -> list[Param]:
        out = []
        for part in self._split(first, last):
            texts = [self.toks[k].text for k in part]
            default = None
            if "=" in texts:
                cut = texts.index("=")
                default = _join(texts[cut + 1 :])
                part, texts = part[:cut], texts[:cut]
            if texts == ["void"]:
                continue
            arr = next((n for n, x in enumerate(texts) if x == "["), len(texts))
            base = texts[:arr]
            name_n = None
            if "(" in base and "*" in base:  # a pointer to a function
                star = base.index("*")
                name_n = next((n for n in range(star, len(base)) if self.toks[part[n]].kind == "id"), None)
            elif len(base) > 1 and self.toks[part[len(base) - 1]].kind == "id" and base[-1] not in NOT_NAMES and (base[-2] not in ("::",)):
                if [x for x in base[:-1] if x not in ("const", "volatile", "struct", "enum", "union", "class", "unsigned", "signed")] or base[0] in ("unsigned", "signed"):
                    name_n = len(base) - 1
            name = texts[name_n] if name_n is not None else ""
            kept = [x for n, x in enumerate(texts) if n != name_n]
            out.append(Param(name, _type(kept), default))
        return out

    def _tparams(self, first: int, last: int) -> list[Param]:
        out = []
        for part in self._split(first, last):
            texts = [self.toks[k].text for k in part]
            default = None
            if "=" in texts:
                cut = texts.index("=")
                default = _join(texts[cut + 1 :])
                part, texts = part[:cut], texts[:cut]
            named = self.toks[part[-1]].kind == "id" and texts[-1] not in ("typename", "class") and len(texts) > 1
            out.append(Param(texts[-1] if named else "", _type(texts[:-1] if named else texts), default))
        return out

    def _class(self, begin, keyword, head, body, stack, tparams, attributes) -> None:
        ns, cls, access = stack[-1]
        words = [self.toks[k].text for k in head]
        at = words.index(keyword)
        rest = head[at + 1 :]
        if keyword == "enum" and rest and self.toks[rest[0]].text in ("class", "struct"):
            rest = rest[1:]
        name_idx, colon = None, len(rest)
        for n, k in enumerate(rest):
            if self.toks[k].text == ":":
                colon = n
                break
            if self.toks[k].kind == "id" and self.toks[k].text not in ("final", "alignas", "__attribute__", "__declspec"):
                name_idx = k
        typedef = "typedef" in words[:at]
        name = self.toks[name_idx].text if name_idx is not None else ""
        place = self.toks[name_idx if name_idx is not None else head[at]].start
        close = self.match(body)
        kind = keyword
        qualified = "::".join(x for x in ((cls.qualified if cls is not None else ns), name) if x)
        node = Node(
            kind, name, qualified, ns, self.lines.line(place), self.lines.column(place), self.lines.line(self.toks[begin].start), self.lines.line(self.toks[close].start), self.toks[begin].start, self.toks[close].start + 1,
            parent=cls, depth=0 if cls is None else cls.depth + 1, access=access, tparams=tparams, attributes=attributes,
        )
        node.requires = self.requires
        if typedef:
            node.flags.add("is_typedef")
        if keyword == "enum":
            node.return_type = self._type_text(rest[colon + 1 :]) or None
            for part in self._split(body + 1, close):
                texts = [self.toks[k].text for k in part]
                node.values.append((texts[0], _join(texts[texts.index("=") + 1 :]) if "=" in texts else None))
        else:
            current, virtual, parts = ("private" if keyword == "class" else "public"), False, []
            default = current
            for k in [*rest[colon + 1 :], None]:
                w = self.toks[k].text if k is not None else ","
                if w == ",":
                    if parts:
                        node.bases.append((self._type_text(parts), current, virtual))
                    current, virtual, parts = default, False, []
                elif w in ("public", "private", "protected"):
                    current = w
                elif w == "virtual":
                    virtual = True
                else:
                    parts.append(k)
        self._document(node, self.toks[body].start)
        self.nodes.append(node)
        if keyword == "enum":
            j = close + 1
            while j < len(self.toks) and not (self.toks[j].kind == "p" and self.toks[j].text in ";}{") and self.toks[j].kind != "pp":
                if not node.name and self.toks[j].kind == "id":
                    node.name = self.toks[j].text
                    node.qualified = "::".join(x for x in ((cls.qualified if cls is not None else ns), node.name) if x)
                j += 1
            self.i = j + (1 if self.is_(j, ";") else 0)
        else:
            stack.append([ns, node, "private" if keyword == "class" else "public"])
            self.i = body + 1

    def _other(self, begin, head, words, j, stack, tparams, attributes, access) -> None:
        """Type definitions, aliases, concepts, fields and variables."""
        ns, cls, access = stack[-1]
        if not head:
            return
        last = min(j, len(self.toks) - 1)
        end = self.toks[last].start

        def add(kind: str, name: str, at: int, text: str | None, qualified: str | None = None) -> None:
            start = self.toks[at].start
            node = Node(kind, name, qualified or "::".join(x for x in ((cls.qualified if cls is not None else ns), name) if x), ns, self.lines.line(start), self.lines.column(start), self.lines.line(self.toks[begin].start), self.lines.line(end), self.toks[begin].start, end + 1, parent=cls, depth=0 if cls is None else cls.depth + 1, access=access, tparams=tparams, attributes=attributes, text=text)
            self._document(node, end)
            self.nodes.append(node)

        ids = [k for k in head if self.toks[k].kind == "id"]
        if words[0] == "friend":
            if len(ids) > 1:
                add("friend", self.toks[ids[-1]].text, ids[-1], self._type_text(head[1:]))
        elif words[0] == "typedef":
            whole = [self.toks[k] for k in range(head[0] + 1, last)]
            pointer = re.search(r"\(\s*\*\s*(\w+)\s*\)", self.text[self.toks[head[0]].start : end])
            if pointer:
                at = next(k for k in range(head[0], last) if self.toks[k].text == pointer.group(1))
                add("typedef", pointer.group(1), at, _join([t.text for t in whole if t.text != pointer.group(1)]))
            elif len(ids) > 1:
                add("typedef", self.toks[ids[-1]].text, ids[-1], self._type_text(head[1 : head.index(ids[-1])]))
        elif words[0] == "using":
            if "=" in words and len(ids) > 1:
                add("type_alias", self.toks[ids[1]].text, ids[1], _join([t.text for t in self.toks[head[words.index("=")] + 1 : last]]))
        elif "concept" in words and "=" in words and len(ids) > 1:
            at = ids[ids.index(head[words.index("concept")]) + 1]
            add("concept", self.toks[at].text, at, _join([t.text for t in self.toks[head[words.index("=")] + 1 : last]]))
        elif words[0] not in ("friend", "static_assert", "_Static_assert", "return", "class", "struct", "union", "enum", "goto", "template") or (words[0] in ("struct", "union", "enum", "class") and len(ids) > 2):
            cut = next((n for n, w in enumerate(words) if w in ("=", "[", ":", ",", "(")), len(words))
            named = [k for k in head[:cut] if self.toks[k].kind == "id"]
            if len(named) > 1:
                add("field" if cls is not None else "variable", self.toks[named[-1]].text, named[-1], self._type_text(head[: head.index(named[-1])]))


def parse(text: str | None, cpp: bool = True) -> list[Node]:
    """The nodes of a file, parents before children, in order of their places."""
    return Parser(text, cpp).parse() if text else []


def documentation(node: Node, near: bool = False) -> str | None:
    """The text of a node's documentation comment; with ``near`` of the one next before it."""
    doc = node.doc_near if near else node.doc
    if doc is None:
        return None
    parts = [doc] if doc.startswith("/*") else doc.split("\n")
    return "\n".join(comment_text(p) for p in parts)
