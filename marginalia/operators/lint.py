"""Documentation rules over tables of declarations.

Rules on one declaration are one projection; rules on lists of names are anti joins and counts on (entity, name), so a
declaration with any number of parameters never becomes one group in a task. Null documentation is W001 and ends the
other rules for that declaration.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.exprs import glob_any, is_void, levenshtein

#: Fixed: codes with their default severity; ignored ones are off.
SEVERITIES = {
    "W001": "warning", "W002": "warning", "W003": "warning", "W004": "warning", "W005": "warning", "W006": "warning", "W007": "warning", "W008": "warning", "W009": "warning", "W010": "info", "W011": "info", "W012": "info",
    "I001": "info", "I002": "info", "E001": "error", "E002": "error", "E003": "error",
}
#: Fixed: spellings of severities.
ALIASES = {"off": "ignore", "warn": "warning"}
ISSUES = ["file", "line", "entity_name", "entity_type", "severity", "code", "message", "suggestion"]
_KINDS = ("function", "method", "class", "struct", "enum", "typedef", "macro", "type_alias", "concept")


@dataclass
class Config:
    max_brief_length: int = 80
    require_brief: bool = True
    require_param_docs: bool = True
    require_return_docs: bool = True
    require_tparam_docs: bool = True
    check_cross_references: bool = True
    require_brief_period: bool = False
    exclude: list[str] = field(default_factory=list)
    severities: dict[str, str] = field(default_factory=dict)


def _issue(when: Column, code: str, message: Column | str) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(when, F.struct(F.lit(code).alias("code"), text.alias("message")))


def checked(entities: DataFrame, config: Config) -> DataFrame:
    """The declarations that rules apply to: no unions, no private members, nothing excluded at the top level."""
    out = entities.where(F.col("kind").isin(*_KINDS) & (F.coalesce(F.col("access"), F.lit("public")) != "private"))
    if config.exclude:
        out = out.where((F.col("kind") == "method") | ~glob_any(F.col("name"), config.exclude))
    return out


def single(entities: DataFrame, config: Config) -> DataFrame:
    """Rules that need one declaration only: W001, W002, W005, W006, W012, I001, I002."""
    brief, doc = F.col("doc.brief"), F.col("doc").isNotNull()
    empty = doc & (brief.isNull() | (brief == ""))
    told = doc & ~empty
    callable_ = F.col("kind").isin("function", "method") & ~F.coalesce(F.col("method_kind"), F.lit("")).isin("constructor", "destructor", "copy_constructor", "move_constructor")
    void, returns = F.coalesce(is_void(F.col("return_type")), F.lit(True)), F.col("doc.returns")
    size = F.octet_length(brief)
    rules = [_issue(~doc, "W001", "no documentation")]
    if config.require_brief:
        rules.append(_issue(empty, "W002", "empty @brief description"))
    rules.append(_issue(told & (size > config.max_brief_length), "I001", F.concat(F.lit(f"@brief exceeds {config.max_brief_length} characters ("), size.cast("string"), F.lit(" chars)"))))
    if config.require_brief_period:
        rules.append(_issue(told & ~brief.rlike(r"[.!?]$"), "I002", "@brief missing period at end"))
    if config.require_return_docs:
        rules += [
            _issue(doc & callable_ & ~void & returns.isNull(), "W005", "missing @return for non-void function"),
            _issue(doc & callable_ & void & returns.isNotNull(), "W006", "@return present for void function"),
            _issue(doc & callable_ & ~void & (returns == ""), "W012", "empty @return description"),
        ]
    return entities.withColumn("_i", F.explode(F.array_compact(F.array(*rules)))).select("entity_id", "_i.code", "_i.message", F.lit(None).cast("string").alias("suggestion"))


def names(owners: DataFrame, declared: DataFrame | None, told: DataFrame, tag: str, codes: tuple[str, str | None, str, str], suggest: bool) -> DataFrame:
    """Rules on lists of names (entity_id, pos, name[, description]): missing, unknown, repeated, empty. ``declared`` None: only the last two."""
    missing, unknown, twice, blank = codes
    told = told.join(owners.select("entity_id"), "entity_id", "left_semi")
    plain = lambda df, code, message: df.select("entity_id", F.lit(code).alias("code"), message.alias("message"), F.lit(None).cast("string").alias("suggestion"))
    quoted = lambda a, b="": F.concat(F.lit(a), F.col("name"), F.lit("'" + b))
    again = told.groupBy("entity_id", "name").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").withColumn("_n", F.explode(F.sequence(F.lit(2).cast("bigint"), F.col("_c"))))
    out = plain(again, twice, quoted(f"duplicate @{tag} for '")).unionByName(plain(told.where("description = ''"), blank, quoted(f"empty @{tag} description for '")))
    if declared is None:
        return out
    declared = declared.where(F.col("name") != "").join(owners.select("entity_id"), "entity_id", "left_semi")
    key = ["entity_id", "name"]
    out = out.unionByName(plain(declared.join(told.select(*key), key, "left_anti"), missing, quoted(f"missing @{tag} for '")))
    if unknown is None:
        return out
    lost = told.join(declared.select(*key), key, "left_anti")
    message = quoted(f"@{tag} '", " does not match any " + ("template parameter" if tag == "tparam" else "parameter"))
    if not suggest:
        return out.unionByName(plain(lost, unknown, message))
    near = (
        lost.select(*key).distinct().join(declared.select("entity_id", F.col("name").alias("_other"), "pos"), "entity_id")
        .select(*key, "_other", "pos", levenshtein(F.col("name"), F.col("_other")).alias("_d")).where("_d <= 2").groupBy(*key).agg(F.min(F.struct("_d", "pos", "_other")).alias("_b"))
    )
    hinted = lost.join(near, key, "left").select("entity_id", F.lit(unknown).alias("code"), message.alias("message"), F.concat(F.lit("Did you mean '"), F.col("_b._other"), F.lit("'?")).alias("suggestion"))
    return out.unionByName(hinted)


def references(entities: DataFrame, symbols: DataFrame, suggest: bool = False) -> DataFrame:
    """W007 for ``@see`` and E003 for ``@copydoc`` whose target is no key of the symbol table."""
    from marginalia.operators.symbols import similar

    seen = entities.select("entity_id", F.explode("doc.see_also").alias("target"), F.lit("W007").alias("code"))
    if "copydoc" in entities.schema["doc"].dataType.names:
        seen = seen.unionByName(entities.where("doc.copydoc is not null").select("entity_id", F.col("doc.copydoc").alias("target"), F.lit("E003").alias("code")))
    lost = seen.join(symbols.select(F.col("lookup_key").alias("target")).distinct(), "target", "left_anti")
    message = F.when(F.col("code") == "W007", F.concat(F.lit("@see '"), F.col("target"), F.lit("' - symbol not found"))).otherwise(F.concat(F.lit("@copydoc '"), F.col("target"), F.lit("' - target not found")))
    out = lost.select("entity_id", "code", message.alias("message"), "target")
    if not suggest:
        return out.select("entity_id", "code", "message", F.lit(None).cast("string").alias("suggestion"))
    near = similar(out.select(F.col("target").alias("query")), symbols.select(F.col("lookup_key").alias("name")))
    return out.join(near, F.col("target") == F.col("query"), "left").select("entity_id", "code", "message", F.concat(F.lit("Did you mean '"), F.col("suggestion"), F.lit("'?")).alias("suggestion"))


def with_severity(found: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """The severity of each issue; what is set to ignore is dropped. The rules are a constant map, so nothing is joined."""
    chosen = SEVERITIES | {code: ALIASES.get(s, s) for code, s in overrides.items()}
    severity = F.create_map(*[F.lit(x) for kv in chosen.items() for x in kv])[F.col("code")]
    return found.withColumn("severity", severity).where(F.col("severity") != "ignore")


def issues(entities: DataFrame, symbols: DataFrame | None, config: Config | None = None, params=None, doc_params=None, tparams=None, doc_tparams=None) -> DataFrame:
    """All issues, in the columns ISSUES. ``entities`` has each declaration once."""
    config = config or Config()
    own = checked(entities, config)
    parts = [single(own, config)]
    documented = own.where("doc is not null")
    if config.require_param_docs and doc_params is not None:
        parts.append(names(documented.where("kind in ('function', 'method')"), params, doc_params, "param", ("W003", "E001", "W008", "W010"), True))
        if params is not None:
            macros = names(documented.where("kind = 'macro'"), params, doc_params, "param", ("W003", None, "W008", "W010"), False)
            parts.append(macros.where("code = 'W003'"))
    if config.require_tparam_docs and doc_tparams is not None:
        parts.append(names(documented.where("kind in ('function', 'class', 'type_alias', 'concept')"), tparams, doc_tparams, "tparam", ("W004", "E002", "W009", "W011"), False))
    if config.check_cross_references and symbols is not None:
        parts.append(references(documented, symbols, suggest=True))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    place = own.select("entity_id", F.col("module").alias("file"), F.when(F.col("kind").isin("type_alias", "concept"), F.lit(0)).otherwise(F.col("line")).alias("line"), F.col("qualified_name").alias("entity_name"), F.col("kind").alias("entity_type"))
    return with_severity(found, config.severities).join(place, "entity_id").select(*ISSUES)


def report_lines(found: DataFrame) -> DataFrame:
    """Issues as text, one line each, with the file to order by."""
    hint = F.coalesce(F.concat(F.lit(" ("), "suggestion", F.lit(")")), F.lit(""))
    return found.select("file", "line", F.concat(F.col("file"), F.lit(":"), F.greatest(F.col("line"), F.lit(1)).cast("string"), F.lit(":1: "), "severity", F.lit(": "), "message", hint, F.lit(" ["), "code", F.lit("]")).alias("text"))


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.count(F.lit(1)).alias("issues"))


def exit_status(found: DataFrame, coverage: DataFrame, strict: bool = False, min_coverage: float | None = None) -> DataFrame:
    """0; 2 if coverage is below the least allowed; 1 if there are errors; 2 if strict and there are warnings; later rules win."""
    c = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    p = coverage.where("kind is null").agg(F.max("percentage").alias("percentage"))
    low = F.lit(False) if min_coverage is None else p.scalar() < min_coverage
    status = F.when(F.lit(strict) & (F.col("warnings") > 0), 2).when(F.col("errors") > 0, 1).when(low, 2).otherwise(0)
    return c.select("errors", "warnings", status.alias("exit_status"))
