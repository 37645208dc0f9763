"""Live documents: keyed state of open texts, diagnostics for each change, and the messages of an editor.

Events are rows of EVENTS. ``states`` keeps the text of each uri and gives a row for each event that changes it;
``diagnose`` runs the batch rules on what has changed. The state is keyed by uri, and one document's edits are
applied in the order of ``seq`` within a batch.

Defined results: a change of a document that isn't open is ignored; a change without a range replaces the text;
closing gives a row with a null text; null uris are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENTS = "uri string, seq bigint, action string, text string, start_line int, start_char int, end_line int, end_char int"
STATES = "uri string, seq bigint, action string, text string"
#: Fixed: what is offered inside a documentation comment.
COMPLETIONS = (
    "@brief", "@param", "@param[in]", "@param[out]", "@param[in,out]", "@tparam", "@return", "@returns", "@retval", "@throws", "@throw", "@exception", "@see", "@ref", "@copydoc", "@note", "@warning", "@attention", "@remark", "@deprecated",
    "@pre", "@post", "@invariant", "@code", "@endcode", "@example", "@since", "@version", "@author", "@authors", "@defgroup", "@addtogroup", "@ingroup", "@details", "@todo", "@bug", "@file",
)
#: Fixed: severities of diagnostics, and the greatest message.
LEVELS, MAX_MESSAGE = {"error": "error", "warning": "warning", "info": "information", "hint": "hint"}, 100 << 20


def offset(raw: bytes, line: int, character: int) -> int:
    """Byte offset of a 0-based line and character; not beyond the text."""
    at = 0
    for _ in range(line):
        n = raw.find(b"\n", at)
        if n < 0:
            return len(raw)
        at = n + 1
    return min(at + character, len(raw))


def apply(text: str | None, action: str, new: str | None, span: tuple | None) -> tuple[str | None, bool]:
    """The text after an event, and whether the event counts."""
    if action == "open":
        return new or "", True
    if action == "close":
        return None, text is not None
    if text is None:
        return None, False
    if action == "save":
        return (new if new is not None else text), True
    if action != "change":
        return text, False
    if span is None:
        return new or "", True
    raw = text.encode("utf-8")
    a, b = offset(raw, span[0], span[1]), offset(raw, span[2], span[3])
    return (raw[:a] + (new or "").encode("utf-8") + raw[max(a, b) :]).decode("utf-8", "replace"), True


def _fold(text: str | None, events: pd.DataFrame) -> tuple[str | None, list[tuple]]:
    rows = []
    for e in events.sort_values("seq", kind="stable").itertuples():
        span = None if pd.isna(e.start_line) else tuple(int(x) for x in (e.start_line, e.start_char, e.end_line, e.end_char))
        text, counts = apply(text, e.action, None if pd.isna(e.text) else e.text, span)
        if counts:
            rows.append((e.uri, int(e.seq), e.action, text))
    return text, rows


def states(events: DataFrame) -> DataFrame:
    """The text after each event, as a stream with state keyed by uri."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        text = state.get[0] if state.exists else None
        for part in [pd.concat(list(parts), ignore_index=True)]:
            text, rows = _fold(text, part)
            if rows:
                yield pd.DataFrame(rows, columns=["uri", "seq", "action", "text"])
        if text is None:
            if state.exists:
                state.remove()
        else:
            state.update((text,))

    return events.where("uri is not null").groupBy("uri").applyInPandasWithState(step, STATES, "text string", "append", "NoTimeout")


def states_batch(events: DataFrame) -> DataFrame:
    """The same from a table of events.

    Where all edits of a document replace the whole text, its text after an event is what the last event that set it brought: a
    window in the JVM. Only documents with ranged edits are folded one edit after the other, in a stream ordered by document and
    number: a task keeps one text at a time, never a document's whole history."""
    own = events.where("uri is not null")
    ranged = own.where("start_line is not null").select("uri").distinct()
    before = Window.partitionBy("uri").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy("uri").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    is_open = F.coalesce(F.last(F.when(F.col("action").isin("open", "close"), F.col("action")), ignorenulls=True).over(before) == "open", F.lit(False))
    marked = own.join(ranged, "uri", "left_anti").withColumn("_counts", (F.col("action") == "open") | (is_open & F.col("action").isin("close", "change", "save")))
    new = F.when(F.col("action") == "close", F.lit(None).cast("string")).otherwise(F.coalesce("text", F.lit("")))
    sets = F.col("_counts") & ~((F.col("action") == "save") & F.col("text").isNull())
    whole = marked.withColumn("_t", F.last(F.when(sets, F.struct(new.alias("t"))), ignorenulls=True).over(so_far)).where("_counts").select("uri", "seq", "action", F.col("_t.t").alias("text"))
    edited = own.join(ranged, "uri", "left_semi").select(*[c.split()[0] for c in EVENTS.split(", ")]).repartition("uri").sortWithinPartitions("uri", "seq").mapInPandas(_folded, STATES)
    return whole.unionByName(edited)


def _folded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits in order of document and number, one after the other."""
    uri, text = None, None
    for part in parts:
        rows: list[tuple] = []
        for at, events in part.groupby("uri", sort=False):
            text = text if at == uri else None
            uri = at
            text, some = _fold(text, events)
            rows += some
        if rows:
            yield pd.DataFrame(rows, columns=["uri", "seq", "action", "text"])


def latest(changes: DataFrame) -> DataFrame:
    return changes.groupBy("uri").agg(F.max_by("text", "seq").alias("text"), F.max("seq").alias("seq"))


def to_diagnostics(issues: DataFrame) -> DataFrame:
    """Issues of the rules as diagnostics: 0-based line, level, code (W000 if there is none)."""
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[F.col("severity")]
    return issues.select(F.col("file").alias("uri"), F.greatest(F.col("line") - 1, F.lit(0)).alias("line"), F.coalesce(level, F.lit("warning")).alias("severity"), F.coalesce("code", F.lit("W000")).alias("code"), "message")


def at_line(diagnostics: DataFrame, line: int) -> DataFrame:
    """The diagnostics that begin on a 0-based line, for what is shown there."""
    return diagnostics.where(F.col("line") == line)


def untested(own: DataFrame, tests: DataFrame) -> DataFrame:
    """A hint for each function and class of parsed texts that no test file (path, content) uses: uri, line, severity, code, message."""
    from marginalia.operators import symbols, testcov

    keys = symbols.candidates(own).where(F.col("kind").isin("function", "class", "method"))
    used = testcov.uses(tests).select(F.col("name").alias("lookup_key")).distinct()
    seen = keys.join(used, "lookup_key", "left_semi").select("entity_id").distinct()
    lost = own.where(F.col("kind").isin("function", "class", "method")).join(seen, "entity_id", "left_anti")
    return lost.select(F.col("module").alias("uri"), F.greatest(F.col("line") - 1, F.lit(0)).alias("line"), F.lit("hint").alias("severity"), F.lit("T001").alias("code"), F.concat(F.lit("No tests for '"), F.col("qualified_name"), F.lit("'")).alias("message"))


def diagnose(changed: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """Diagnostics of each text (uri, text): parsed alone, so references to other files look unresolved, as in an editor.

    With ``tests`` (path, content) there are hints for what no test uses."""
    from marginalia.operators import coverage, extract, grouping, lint, symbols
    from marginalia.runtime import materialize

    files = changed.where("text is not null").select(F.col("uri").alias("path"), F.col("text").alias("content"))
    parsed = materialize(extract.nodes(files), "diagnose")
    own = extract.entities(parsed)
    issues = lint.issues(own, None, params=extract.params(parsed), doc_params=extract.doc_params(parsed), tparams=extract.tparams(parsed), doc_tparams=extract.doc_tparams(parsed))
    # A symbol table for each file: a key is the file and the name.
    keys = symbols.candidates(own, extract.params(parsed)).select(F.col("source_file").alias("module"), "lookup_key").distinct()
    seen = own.select("module", "entity_id", "line", "kind", "qualified_name", F.explode("doc.see_also").alias("lookup_key")).join(keys, ["module", "lookup_key"], "left_anti")
    lost = seen.select(F.col("module").alias("file"), "line", F.col("qualified_name").alias("entity_name"), F.col("kind").alias("entity_type"), F.lit("warning").alias("severity"), F.lit("W007").alias("code"), F.concat(F.lit("@see '"), "lookup_key", F.lit("' - symbol not found")).alias("message"), F.lit(None).cast("string").alias("suggestion"))
    found = to_diagnostics(issues.unionByName(lost)).withColumnRenamed("uri", "file")
    missing = coverage.missing_items(own).select("file", F.greatest(F.col("line") - 1, F.lit(0)).alias("line"), F.lit("warning").alias("severity"), F.lit("W000").alias("code"), F.col("issue").alias("message"))
    merged = grouping.merge_diagnostics(found, missing).withColumnRenamed("file", "uri")
    return merged if tests is None else merged.unionByName(untested(own, tests))


def run(events: DataFrame, checkpoint: str, publish: Callable[[DataFrame, int], None], once: bool = True, tests: DataFrame | None = None):
    """Start the stream: for each batch the diagnostics of the last text of every changed document go to ``publish``; a closed one gets none."""

    def each(batch: DataFrame, number: int) -> None:
        last = latest(batch)
        publish(last.select("uri", "seq").join(diagnose(last, tests), "uri", "left"), number)

    writer = states(events).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(availableNow=True).start() if once else writer.start()


def in_doc_comment(text: str, line: int, character: int) -> bool:
    """Whether a place lies inside a documentation comment."""
    from marginalia.functions.clex import doc_kind, tokens

    raw = text.encode("utf-8")
    at = len(raw[: offset(raw, line, character)].decode("utf-8", "ignore"))
    for t in tokens(text):
        end = t.start + len(t.text)
        if t.start < at <= end and t.kind in ("lc", "bc"):
            closed = t.kind == "bc" and t.text.endswith("*/") and at > end - 2
            return doc_kind(t.text) is not None and not closed
    return False


def completions(text: str, line: int, character: int) -> tuple[str, ...]:
    return COMPLETIONS if in_doc_comment(text, line, character) else ()


def doc_stub(indent: str, params: list[str], returns: bool) -> str:
    lines = ["/**", " * @brief ", *(f" * @param {p} " for p in params), *([" * @return "] if returns else []), " */"]
    return "".join(f"{indent}{x}\n" for x in lines)


def code_actions(issues: DataFrame, entities: DataFrame, params: DataFrame) -> DataFrame:
    """Edits that mend W001, W003, W005 and E001: uri, line, title, new_text. Entities of one (file, line) count by their last."""
    from marginalia.functions.exprs import is_void

    names = params.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda p: p["name"]).alias("_names"))
    info = entities.groupBy(F.col("module").alias("file"), F.col("line")).agg(F.max_by(F.struct("entity_id", "return_type", "col_no"), "ord").alias("_e"))
    own = issues.where("code in ('W001', 'W003', 'W005', 'E001')").join(info, ["file", "line"], "left").join(names, F.col("_e.entity_id") == names["entity_id"], "left")
    indent = F.expr("repeat(' ', greatest(coalesce(_e.col_no, 1) - 1, 0))")
    name = F.regexp_extract("message", "'([^']*)'", 1)
    stub = F.concat(
        indent, F.lit("/**\n"), indent, F.lit(" * @brief \n"), F.array_join(F.transform(F.coalesce("_names", F.array().cast("array<string>")), lambda p: F.concat(indent, F.lit(" * @param "), p, F.lit(" \n"))), ""),
        F.when(~F.coalesce(is_void(F.col("_e.return_type")), F.lit(True)), F.concat(indent, F.lit(" * @return \n"))).otherwise(F.lit("")), indent, F.lit(" */\n"),
    )
    title = F.when(F.col("code") == "W001", F.lit("Add documentation")).when(F.col("code") == "W003", F.concat(F.lit("Add @param "), name)).when(F.col("code") == "W005", F.lit("Add @return")).otherwise(F.concat(F.lit("Rename to "), F.regexp_extract("suggestion", "'([^']*)'", 1)))
    text = F.when(F.col("code") == "W001", stub).when(F.col("code") == "W003", F.concat(indent, F.lit(" * @param "), name, F.lit(" \n"))).when(F.col("code") == "W005", F.concat(indent, F.lit(" * @return \n"))).otherwise(F.regexp_extract("suggestion", "'([^']*)'", 1))
    return own.where("code != 'E001' or suggestion is not null").select(F.col("file").alias("uri"), F.col("line"), "code", title.alias("title"), text.alias("new_text"))


def frames(raw: bytes) -> Iterator[dict]:
    """The JSON messages in a stream of frames with Content-Length; one that is too long or no JSON is passed over."""
    at = 0
    while True:
        end = raw.find(b"\r\n\r\n", at)
        if end < 0:
            return
        size = next((int(h.split(b":", 1)[1]) for h in raw[at:end].split(b"\r\n") if h.lower().startswith(b"content-length:") and h.split(b":", 1)[1].strip().isdigit()), None)
        at = end + 4
        if size is None:
            continue
        body, at = raw[at : at + size], at + size
        if size <= MAX_MESSAGE and len(body) == size:
            try:
                message = json.loads(body)
            except ValueError:
                continue
            if isinstance(message, dict):
                yield message


def frame(message: dict) -> bytes:
    body = json.dumps(message, separators=(",", ":"), ensure_ascii=False).encode("utf-8")
    return b"Content-Length: %d\r\n\r\n" % len(body) + body


_ACTIONS = {"textDocument/didOpen": "open", "textDocument/didChange": "change", "textDocument/didSave": "save", "textDocument/didClose": "close"}


def events_of(raw: bytes) -> list[tuple]:
    """Rows of EVENTS from the frames of a session, numbered in their order; several edits of one message are several rows."""
    out: list[tuple] = []
    for m in frames(raw):
        action, p = _ACTIONS.get(m.get("method")), m.get("params")
        doc = p.get("textDocument") if isinstance(p, dict) else None
        if action is None or not isinstance(doc, dict):
            continue
        changes = p.get("contentChanges", []) if action == "change" else [{"text": doc.get("text") if action == "open" else p.get("text")}]
        for c in changes if isinstance(changes, list) else []:
            r = c.get("range") or {}
            a, b = r.get("start") or {}, r.get("end") or {}
            out.append((doc.get("uri"), len(out), action, c.get("text"), a.get("line"), a.get("character"), b.get("line"), b.get("character")))
    return out


def read_sessions(files: DataFrame) -> DataFrame:
    """Events from files (content binary) that hold recorded sessions; uris of different files stay apart by their own names."""

    def run_(batches):
        schema = pa.schema([("uri", pa.string()), ("seq", pa.int64()), ("action", pa.string()), ("text", pa.string()), *((x, pa.int32()) for x in ("start_line", "start_char", "end_line", "end_char"))])
        for batch in batches:
            rows = [r for raw in batch.column(0).to_pylist() for r in events_of(bytes(raw or b""))]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return files.select("content").mapInArrow(run_, EVENTS)


def publish_frames(diagnostics: DataFrame) -> DataFrame:
    """A framed notification for each document with its diagnostics in order of lines; diagnostics of one document only are collected."""
    item = F.struct(F.col("line"), F.col("code"), F.col("message"), F.col("severity"))
    by = diagnostics.groupBy("uri").agg(F.array_sort(F.collect_list(F.when(F.col("message").isNotNull(), item))).alias("_d"))
    body = F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.lit("textDocument/publishDiagnostics").alias("method"), F.struct("uri", F.col("_d").alias("diagnostics")).alias("params")))
    return by.select("uri", F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body).alias("frame"))
