"""Deeply nested documents turned into flat tables by Merkle identities of their subtrees.

Each object is canonicalised and hashed bottom-up: its identity covers its kind, all of its own members and, in
order, the identities of the objects below it. An object that stands in many places is stored once; where it
stands is kept in bridge rows (document, path, ordinal, identity), so nothing is lost by sharing: ``rebuild`` gives
the modules back as they were sent.

Followed are the arrays of objects, and the documentation objects, that the interchange format knows (CHILDREN,
SINGLE). Whatever else a followed member holds (another value instead of the array, members that are no objects)
stays with the object's own attributes.

Defined results: a null, empty or malformed body, or one without the version and the module array that the
format asks for, has no rows; bodies may be nested to any depth and hold numbers of any length; what should be an
array but isn't counts as empty; what should be an object but isn't is skipped, its place in the array staying
counted; a name that is missing or no string is ``''``; documents sent twice give their rows once; an empty table
gives empty tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.jsontext import NotJson, canonical, load
from marginalia.runtime import hot_keys, materialize, salt_left, salt_right

#: Fixed: keys of the interchange format under ``properties`` of a run, and the version that is read.
VERSION_KEY, MODULES_KEY, VERSION = "stig:version", "stig:modules", "1.0"
ROWS = "is_object boolean, is_leaf boolean, sarif_id bigint, owner_path string, child_kind string, pos int, parent_id string, object_id string, name string, attributes string"
#: Fixed: the arrays of objects that are followed below each kind, with the kind of what they hold.
CHILDREN = {
    "module": (
        ("functions", "function"), ("classes", "class"), ("structs", "struct"), ("enums", "enum"), ("typedefs", "typedef"), ("macros", "macro"), ("typeAliases", "type_alias"), ("concepts", "concept"), ("pages", "page"),
    ),
    "class": (("methods", "method"), ("nestedClasses", "class"), ("baseClasses", "base"), ("fields", "field"), ("templateParams", "tparam")),
    "struct": (("fields", "field"),),
    "enum": (("values", "value"),),
    "function": (("params", "param"), ("templateParams", "tparam")),
    "method": (("params", "param"),),
    "concept": (("templateParams", "tparam"),),
    "doc": (("params", "doc_param"), ("tparams", "doc_tparam")),
}
#: Fixed: the member that holds the documentation object of each kind that has one.
SINGLE = {"module": "fileDoc"} | dict.fromkeys(("function", "method", "class", "struct", "enum", "typedef", "macro", "type_alias", "concept"), "doc")
#: Fixed: of each kind the member with its main text, and what an absent one stands for.
MAIN = {
    "function": ("returnType", ""), "method": ("returnType", ""), "param": ("type", ""), "field": ("type", ""), "base": ("access", None), "typedef": ("underlying", ""), "macro": ("body", ""), "type_alias": ("underlyingType", ""),
    "concept": ("constraint", ""), "page": ("content", ""), "tparam": ("kind", "typename"), "class": ("namespace", None), "doc": ("brief", None), "doc_param": ("description", ""), "doc_tparam": ("description", ""),
}
#: Kinds with nothing below them; they are most of the rows and have a part of the table of their own.
LEAVES = ("param", "doc_param", "tparam", "doc_tparam", "base", "field", "value", "page")
#: Bytes of rows after which a batch is handed on.
FLUSH = 8 << 20


def properties_of(body: str | None):
    """The ``properties`` of the first run, or None; NotJson if the body isn't well-formed."""
    if not body:
        raise NotJson("empty")
    top = load(body)
    runs = top.get("runs") if isinstance(top, dict) else None
    run = runs[0] if isinstance(runs, list) and runs else None
    properties = run.get("properties") if isinstance(run, dict) else None
    return properties if isinstance(properties, dict) else None


def modules_of(body: str | None) -> list:
    """The module array of a body, or [] if the body doesn't count."""
    try:
        properties = properties_of(body)
    except NotJson:
        return []
    if properties is None or properties.get(VERSION_KEY) != VERSION or not isinstance(properties.get(VERSION_KEY), str):
        return []
    modules = properties.get(MODULES_KEY)
    return modules if isinstance(modules, list) else []


def own_members(kind: str, obj: dict) -> dict:
    """The members of an object without the objects that are followed: of an array what is no object stays, in its order."""
    own = dict(obj)
    for key, _ in CHILDREN.get(kind, ()):
        if isinstance(own.get(key), list):
            own[key] = [x for x in own[key] if not isinstance(x, dict)]
    key = SINGLE.get(kind)
    if key and isinstance(own.get(key), dict):
        del own[key]
    return own


class Walk:
    """Objects and occurrences below one document's modules, visited without recursion, children before their parent is hashed."""

    def __init__(self, sarif_id, objects: dict):
        self.sarif_id, self.objects, self.rows, self.size = sarif_id, objects, [], 0

    def identity(self, kind: str, obj: dict, below: list) -> str:
        attributes = canonical(own_members(kind, obj))
        parts = "".join([f"\n{b[0]} {b[1]} {b[2]}" for b in below])  # canonical text has no line ends
        digest = hashlib.blake2b(f"{kind}\n{attributes}{parts}".encode(), digest_size=16).hexdigest()
        if digest not in self.objects:
            name = obj.get("name")
            self.objects[digest] = (kind, name if isinstance(name, str) else "", attributes)
            self.size += len(attributes)
        return digest

    def run(self, modules: list) -> Iterator[None]:
        """Visits all; stops for the caller to take ``rows`` away whenever these have grown large."""
        # An entry is visited twice: first to put its children on the stack, then, when these have identities, to be hashed itself.
        stack = [("module", m, str(i), i, None, None) for i, m in reversed(list(enumerate(modules))) if isinstance(m, dict)]
        while stack:
            kind, obj, path, pos, parent, below = stack.pop()
            if below is None:
                below = []
                children = [(kind_, child, f"{path}/{key}/{i}", i, below, None) for key, kind_ in CHILDREN.get(kind, ()) if isinstance(obj.get(key), list) for i, child in enumerate(obj[key]) if isinstance(child, dict)]
                key = SINGLE.get(kind)
                if key and isinstance(obj.get(key), dict):
                    children.append(("doc", obj[key], f"{path}/{key}", 0, below, None))
                if children:
                    stack.append((kind, obj, path, pos, parent, below))
                    stack += children
                    continue
            below.sort()
            own_id = self.identity(kind, obj, below)
            for child_kind, i, child_id in below:
                self.rows.append((self.sarif_id, path, child_kind, i, own_id, child_id))
            self.size += len(below) * (len(path) + 100)
            if parent is None:
                self.rows.append((self.sarif_id, None, kind, pos, None, own_id))
            else:
                parent.append((kind, pos, own_id))
            if self.size > FLUSH:
                yield
                self.size = 0


_SCHEMA = pa.schema([
    ("is_object", pa.bool_()), ("is_leaf", pa.bool_()), ("sarif_id", pa.int64()), ("owner_path", pa.string()), ("child_kind", pa.string()), ("pos", pa.int32()), ("parent_id", pa.string()), ("object_id", pa.string()), ("name", pa.string()), ("attributes", pa.string()),
])


def _record(rows: list[tuple], objects: dict) -> pa.RecordBatch:
    out = [(False, r[2] in LEAVES, *r, None, None) for r in rows] + [(True, kind in LEAVES, None, None, kind, None, None, digest, name, attributes) for digest, (kind, name, attributes) in objects.items()]
    return pa.record_batch([pa.array([_clean(x) for x in c] if f.name == "name" else c, f.type) for c, f in zip(zip(*out), _SCHEMA)], schema=_SCHEMA)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, objects, size = [], {}, 0
    for batch in batches:
        for sarif_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            modules = modules_of(body)
            if not modules:
                continue
            walk = Walk(sarif_id, objects)
            for _ in walk.run(modules):
                yield _record(rows + walk.rows, objects)
                rows, walk.rows = [], []
                objects.clear()
                size = 0
            rows += walk.rows
            size += walk.size
            if size > FLUSH:
                yield _record(rows, objects)
                rows, size = [], 0
                objects.clear()
    if rows:
        yield _record(rows, objects)


def _clean(text: str | None) -> str | None:
    """Lone surrogates, which JSON can spell but UTF-8 can't, become U+FFFD."""
    return text if text is None or text.isascii() else re.sub("[\ud800-\udfff]", "�", text)


@dataclass
class Flat:
    """``objects``: object_id, kind, name, attributes; ``occurrences``: sarif_id, owner_path, child_kind, pos, parent_id, object_id.

    ``rows`` are the rows as parsed, with those of copied documents."""

    objects: DataFrame
    occurrences: DataFrame
    rows: DataFrame


def flatten(documents: DataFrame) -> Flat:
    """Flat tables of the documents (sarif_id, body). Bodies are parsed once; the parsed rows go to the shared folder."""
    rows = materialize(documents.select("sarif_id", "body").mapInArrow(_parse, ROWS), "nested", ["is_object", "is_leaf"])
    # Equal identities have equal content, so any one of the equal rows may stay. With the kind in the key a filter on it reaches the scan.
    objects = rows.where("is_object").groupBy("object_id", F.col("child_kind").alias("kind"), "is_leaf").agg(F.first("name").alias("name"), F.first("attributes").alias("attributes")).select("object_id", "kind", "name", "attributes", "is_leaf")
    occurrences = rows.where("not is_object").select("sarif_id", "owner_path", "child_kind", "pos", "parent_id", "object_id").distinct()
    return Flat(objects.drop("is_leaf"), occurrences, rows)


def _with_objects(bridge: DataFrame, objects: DataFrame) -> DataFrame:
    """Occurrences with the columns of their objects; a hot object's occurrences are dealt over several tasks."""
    hot = hot_keys(bridge, ["object_id"])
    left = salt_left(bridge, ["object_id"], hot, ["sarif_id", "owner_path", "pos"])
    return left.join(salt_right(objects, ["object_id"], hot), ["object_id", "_salt"])


def params(flat: Flat) -> DataFrame:
    """The parameters of functions and methods, and those their documentation names, with the names of the objects they refer to.

    ``owner_path`` leads to the function or method. Two different bodies under one id may give the same row; it is kept once."""
    kinds = F.col("child_kind").isin("param", "doc_param")
    of_function = (F.col("child_kind") == "param") | F.col("owner_path").rlike(r"(^|/)(functions|methods)/\d+/doc$")
    leaves = flat.rows.where("is_leaf").where(kinds)
    bridge = leaves.where("not is_object").where(of_function).select("sarif_id", F.regexp_replace("owner_path", "/doc$", "").alias("owner_path"), "child_kind", "pos", "object_id")
    objects = leaves.where("is_object").groupBy("object_id").agg(F.first("name").alias("name"))
    return _with_objects(bridge, objects).select("sarif_id", "owner_path", "child_kind", "pos", "name").distinct()


def member(attributes, key: str):
    """A member of the attributes if it is a string, else null; wherever the JVM can read the text as a variant."""
    value = F.try_variant_get(F.try_parse_json(attributes), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def number(attributes, key: str):
    """A member of the attributes if it is an integer of 64 bits, else null."""
    value = F.try_variant_get(F.try_parse_json(attributes), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def records(flat: Flat) -> DataFrame:
    """Every occurrence of every kind as a row: its place, its name and the main text of its kind (MAIN; the number of an enumerator)."""
    text = F.lit(None).cast("string")
    for kind, (key, absent) in MAIN.items():
        text = F.when(F.col("kind") == kind, F.coalesce(member(F.col("attributes"), key), F.lit(absent))).otherwise(text)
    text = F.when(F.col("kind") == "value", number(F.col("attributes"), "value").cast("string")).otherwise(text)
    objects = flat.objects.select("object_id", "name", text.alias("text"))
    return _with_objects(flat.occurrences, objects).select("sarif_id", "owner_path", "child_kind", "pos", "name", "text")


def rebuild(objects: dict[str, tuple[str, dict]], below: dict[str, list[tuple[str, int, str]]], object_id: str):
    """The object as it was sent, from identities: kind and attributes of each object, and its children (kind, place, identity).

    A check that nothing is lost, for one document; without recursion."""
    made: dict[str, dict] = {}
    stack = [object_id]
    while stack:
        at = stack[-1]
        left = [c for _, _, c in below.get(at, ()) if c not in made]
        if at in made or left:
            stack += left
            if not left:
                stack.pop()
            continue
        kind, attributes = objects[at]
        out = dict(attributes)
        for key, child_kind in CHILDREN.get(kind, ()):
            children = sorted((pos, c) for k, pos, c in below.get(at, ()) if k == child_kind)
            if children:
                rest, whole = iter(out[key]), {pos: made[c] for pos, c in children}
                out[key] = [whole[n] if n in whole else next(rest) for n in range(len(out[key]) + len(whole))]
        for k, _, c in below.get(at, ()):
            if k == "doc":
                out[SINGLE[kind]] = made[c]
        made[at] = out
        stack.pop()
    return made[object_id]
