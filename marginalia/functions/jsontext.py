"""JSON text of any depth and with numbers of any length.

``load`` uses the json module where that gives the exact content, and else its own scanner, which keeps an explicit
stack instead of recursing and keeps numbers as their text. ``canonical`` writes a value so that equal content gives
equal text: keys sorted, no blanks, ASCII only. Of a key that is repeated in an object the last value counts.
"""

from __future__ import annotations

import json
import re

_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("[^"\\\x00-\x1f]*(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})[^"\\\x00-\x1f]*)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}
_END = re.compile(r"[ \t\n\r]*\Z")


class NotJson(ValueError):
    pass


class Number(str):
    """The text of a number that int or float wouldn't keep exactly."""


class _Inexact(Exception):
    pass


def _inexact(token: str):
    raise _Inexact(token)


def _refuse(token: str):
    raise NotJson(token)


_DECODER = json.JSONDecoder(parse_float=_inexact, parse_constant=_refuse)


def load(text: str):
    """The value of a JSON text; NotJson if it isn't well-formed."""
    try:
        return _DECODER.decode(text)
    except (_Inexact, RecursionError):
        return scan(text)
    except json.JSONDecodeError as e:
        raise NotJson(str(e)) from None
    except NotJson:
        raise
    except ValueError:  # an integer of more digits than int() takes
        return scan(text)


def _number(text: str) -> int | Number:
    if text.lstrip("-").isdigit() and len(text) < 4000:
        return int(text)
    return Number(text)


def scan(text: str):
    """The same by an explicit stack."""
    at, stack = 0, []  # entries: [container, key]
    want = "value"  # value, first (a value or the end), key, first_key, colon, next
    top = None
    while True:
        m = _TOKEN.match(text, at)
        if m is None:
            raise NotJson(f"at {at}")
        at = m.end()
        mark, string, number, word = m.groups()
        if want in ("key", "first_key"):
            if string is not None:
                stack[-1][1], want = json.loads(string), "colon"
                continue
            if mark != "}" or want == "key":
                raise NotJson(f"at {at}")
        elif want == "colon":
            if mark != ":":
                raise NotJson(f"at {at}")
            want = "value"
            continue
        elif want == "next":
            if mark == ",":
                want = "key" if isinstance(stack[-1][0], dict) else "value"
                continue
            if mark != ("}" if isinstance(stack[-1][0], dict) else "]"):
                raise NotJson(f"at {at}")
        elif mark in ("{", "["):
            value = {} if mark == "{" else []
            _put(stack, value)
            stack.append([value, None])
            want = "first_key" if mark == "{" else "first"
            continue
        elif not (mark == "]" and want == "first"):
            if mark is not None:
                raise NotJson(f"at {at}")
            value = json.loads(string) if string is not None else _number(number) if number is not None else _WORDS[word]
            if not stack:
                top = value
                break
            _put(stack, value)
            want = "next"
            continue
        top = stack.pop()[0]  # the container is complete
        if not stack:
            break
        want = "next"
    if not _END.match(text, at):
        raise NotJson(f"at {at}")
    return top


def _put(stack: list, value) -> None:
    if stack:
        holder, key = stack[-1]
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)


_PLAIN = json.JSONEncoder(sort_keys=True, ensure_ascii=True, separators=(",", ":"))


def canonical(value) -> str:
    try:
        if not _exact_only(value):
            return _written(value)
        return _PLAIN.encode(value)
    except RecursionError:
        return _written(value)


def _exact_only(value) -> bool:
    """Whether a flat look finds no Number; nested containers are looked at too, but without recursion."""
    queue = [value]
    while queue:
        v = queue.pop()
        if type(v) is Number:
            return False
        if type(v) is dict:
            queue += [x for x in v.values() if type(x) in (dict, list, Number)]
        elif type(v) is list:
            queue += [x for x in v if type(x) in (dict, list, Number)]
    return True


def _written(value) -> str:
    out, stack = [], [value]
    raw = type("Raw", (str,), {})
    while stack:
        v = stack.pop()
        if type(v) is raw or type(v) is Number:
            out.append(v)
        elif isinstance(v, dict):
            parts = [raw("{")]
            for n, k in enumerate(sorted(v)):
                parts += [raw(("," if n else "") + json.dumps(k) + ":"), v[k]]
            stack += reversed([*parts, raw("}")])
        elif isinstance(v, list):
            parts = [raw("[")]
            for n, x in enumerate(v):
                parts += [raw(","), x] if n else [x]
            stack += reversed([*parts, raw("]")])
        else:
            out.append(json.dumps(v))
    return "".join(out)
