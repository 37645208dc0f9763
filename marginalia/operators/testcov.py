"""Which symbols are used in test sources."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.clex import tokens
from marginalia.operators.symbols import suffixes

#: Fixed: the forms of a use: an identifier, perhaps with one member, before ``(``, ``<``, ``{`` or ``.``.
_COMMENT = r"//[^\n]*|/\*(?s:.*?)\*/"
_USE = r"([A-Za-z_]\w*(?:::[A-Za-z_]\w*)?)\s*(?=[(<{.])|\.\s*[A-Za-z_]\w*"
KINDS = ("function", "class", "method")
#: The macro that declares a test, where no other is given.
TEST_MACRO = "TEST"


def uses(tests: DataFrame, text: str = "content", path: str = "path") -> DataFrame:
    """Every name used in a test file, with the first place. A qualified name counts under its base as well."""
    bare = F.regexp_replace(F.col(text), _COMMENT, " ")
    found = tests.where(F.col(text).isNotNull()).select(F.col(path).alias("file"), F.posexplode(F.regexp_extract_all(bare, F.lit(_USE), F.lit(0))).alias("pos", "_u"))
    name = F.regexp_replace(F.regexp_replace("_u", r"^\.\s*", ""), r"\s+$", "")
    both: Column = F.when(F.contains(F.col("_n"), F.lit("::")), F.array("_n", F.substring_index("_n", "::", 1))).otherwise(F.array("_n"))
    return found.select("file", "pos", name.alias("_n")).select("file", "pos", F.explode(both).alias("name"))


def scoped_uses(tests: DataFrame, macro: str = TEST_MACRO) -> DataFrame:
    """Names used in test files (path, content) with the test they stand in: file, pos, name, test (null outside of tests).

    A test is what stands in braces behind ``macro(name)``. The lexer leaves out comments and strings; files are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("pos", pa.int32()), ("name", pa.string()), ("test", pa.string())])
        for batch in batches:
            rows = [(path, *u) for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for u in uses_in(content or "", macro)]
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return tests.select("path", "content").mapInArrow(run, "file string, pos int, name string, test string")


def uses_in(content: str, macro: str) -> list[tuple[int, str, str | None]]:
    toks = [t for t in tokens(content) if t.kind in ("id", "p")]
    out: list[tuple[int, str, str | None]] = []
    test, depth, n = None, 0, 0
    text = lambda k: toks[k].text if k < len(toks) else ""
    while n < len(toks):
        t = toks[n]
        if t.text == macro and text(n + 1) == "(":
            end = next((k for k in range(n + 2, len(toks)) if toks[k].text == ")"), len(toks))
            test, depth, n = "".join(x.text for x in toks[n + 2 : end]), 0, end + 1
            continue
        if t.text == "{":
            depth += 1
        elif t.text == "}":
            depth = max(0, depth - 1)
            if depth == 0:
                test = None
        elif t.kind == "id":
            name, last = t.text, n
            joint = 2 if text(n + 1) == ":" and text(n + 2) == ":" else 1 if text(n + 1) == "::" else 0
            if joint and n + joint + 1 < len(toks) and toks[n + joint + 1].kind == "id":
                last = n + joint + 1
                name = f"{t.text}::{toks[last].text}"
            if text(last + 1) in ("(", "<", "{", "."):
                out.append((len(out), name, test))
                if last > n:
                    out.append((len(out), t.text, test))
                if text(last + 1) == "." and last + 2 < len(toks) and toks[last + 2].kind == "id":
                    last += 2
                    out.append((len(out), toks[last].text, test))
            n = last
        n += 1
    return out


def calls(used: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls of each canonical symbol and the first file with one. Uses are counted by name before they meet the table."""
    counted = used.groupBy("name").agg(F.count(F.lit(1)).alias("calls"), F.min(F.struct("file", "pos")).alias("_first"))
    known = symbols.select("lookup_key", F.col("name").alias("symbol"), "kind")
    hit = counted.join(known, counted["name"] == known["lookup_key"])
    return hit.groupBy("symbol").agg(F.sum("calls").alias("calls"), F.min("_first").alias("_first"), F.min("kind").alias("kind")).select("symbol", "kind", "calls", F.col("_first.file").alias("first_file"))


def canonical(symbols: DataFrame) -> DataFrame:
    """Keys that no longer key ends with: an unqualified key that another key ends with (``...::name``) stands for that one."""
    ends = symbols.select(F.explode(F.slice(suffixes(F.col("lookup_key")), F.lit(2), F.size(suffixes(F.col("lookup_key"))))).alias("lookup_key")).distinct()
    short = symbols.where(~F.contains("lookup_key", F.lit("::"))).join(ends, "lookup_key", "left_semi").select("lookup_key")
    return symbols.join(short, "lookup_key", "left_anti")


def tested(symbols: DataFrame, called: DataFrame) -> DataFrame:
    return symbols.join(called.select(F.col("symbol").alias("name")), "name", "left_semi")


def untested(symbols: DataFrame, called: DataFrame) -> DataFrame:
    return symbols.join(called.select(F.col("symbol").alias("name")), "name", "left_anti")


def stats(symbols: DataFrame, called: DataFrame) -> DataFrame:
    """Total, tested and percentage of each kind, and of all with kind null."""
    hit = called.select(F.col("symbol").alias("name"), F.lit(True).alias("_t"))
    joined = symbols.join(hit, "name", "left")
    out = joined.rollup("kind").agg(F.count(F.lit(1)).alias("total"), F.count("_t").alias("tested"))
    return out.withColumn("percentage", F.round(F.when(F.col("total") == 0, F.lit(100.0)).otherwise(F.col("tested") * 100.0 / F.col("total")), 6))


def report_lines(missing: DataFrame) -> DataFrame:
    return missing.select(F.concat(F.col("source_file"), F.lit(":1:1: warning: "), F.col("kind"), F.lit(" '"), F.col("name"), F.lit("' has no tests")).alias("text"))


def report_human(numbers: DataFrame) -> DataFrame:
    """A line for each kind."""
    return numbers.select(F.format_string("%-12s %5.1f%% (%d/%d)", F.coalesce("kind", F.lit("total")), "percentage", "tested", "total").alias("text"))


def report_json(numbers: DataFrame) -> DataFrame:
    """The total as JSON text."""
    return numbers.where("kind is null").select(F.to_json(F.struct(F.struct(F.round("percentage", 1).alias("percentage"), "tested", "total").alias("coverage"))).alias("json"))


def sarif_results(missing: DataFrame) -> DataFrame:
    """A SARIF result of the rule TCOV001 for each symbol without tests."""
    text = F.concat("kind", F.lit(" '"), "name", F.lit("' has no tests"))
    place = F.array(F.struct(F.struct(F.struct(F.col("source_file").alias("uri")).alias("artifactLocation")).alias("physicalLocation")))
    return missing.select("name", F.to_json(F.struct(F.lit("TCOV001").alias("ruleId"), F.lit("warning").alias("level"), F.struct(text.alias("text")).alias("message"), place.alias("locations"))).alias("result"))


def diagnostics(missing: DataFrame) -> DataFrame:
    """Hints for what isn't tested."""
    return missing.select(F.col("source_file").alias("file"), F.lit(1).alias("line"), F.lit("hint").alias("severity"), F.lit("T001").alias("code"), F.concat(F.lit("No tests for '"), F.col("name"), F.lit("'")).alias("message"))
