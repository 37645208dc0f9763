"""Queries over the operators on declarations, each with SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import doccomment, exprs
from marginalia.operators import coverage, extract, graph, grouping, links, lint, manifest, render, symbols, testcov
from marginalia.operators.nested import MODULES_KEY, VERSION_KEY
from marginalia.sources import sarif
from marginalia.streaming import documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def entities(spark: SparkSession, d: str) -> DataFrame:
    """Each declaration once; copies differ in ``ingested_at`` only. With kind and access in the key, filters on them reach the scan."""
    return table(spark, d, "entities").drop("ingested_at").dropDuplicates(["entity_id", "kind", "access"])


def doc_params(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_params").drop("ingested_at").dropDuplicates(["entity_id", "pos"])


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sources").drop("ingested_at").dropDuplicates(["path"])


def live(spark: SparkSession, d: str) -> DataFrame:
    return symbols.live_symbols(table(spark, d, "symbols"))


ONCE = """
ents AS (SELECT * EXCLUDE (ingested_at, n) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ingested_at) AS n FROM entities) WHERE n = 1),
dparams AS (SELECT * EXCLUDE (ingested_at, n) FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, pos ORDER BY ingested_at) AS n FROM doc_params) WHERE n = 1),
files AS (SELECT * EXCLUDE (ingested_at, n) FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ingested_at) AS n FROM sources) WHERE n = 1),
syms AS (SELECT lookup_key, kind, source_file, anchor, name FROM (SELECT *, row_number() OVER (PARTITION BY lookup_key ORDER BY added_at, source_file, anchor, kind, name) AS n FROM symbols) WHERE n = 1)
"""
WITH = f"WITH {ONCE}"
_CTOR = "coalesce(method_kind, '') IN ('constructor', 'destructor', 'copy_constructor', 'move_constructor')"
_VOID = "coalesce(trim(replace(return_type, chr(9), ' ')) IN ('', 'void'), true)"
_COUNTED = "kind IN ('function', 'method', 'class', 'struct', 'enum', 'typedef', 'type_alias', 'concept') AND coalesce(access, 'public') <> 'private'"
_CHECKED = "kind IN ('function', 'method', 'class', 'struct', 'enum', 'typedef', 'macro', 'type_alias', 'concept') AND coalesce(access, 'public') <> 'private'"
_HAS_DOCS = "coalesce(doc IS NOT NULL AND (doc.brief IS NOT NULL OR doc.details IS NOT NULL OR doc.raw <> ''), false)"


@query(f"""{WITH} SELECT kind, count(*) AS total, count(*) FILTER (d) AS documented, round(CASE WHEN count(*) = 0 THEN 100.0 ELSE count(*) FILTER (d) * 100.0 / count(*) END, 6)::double AS percentage
FROM (SELECT CASE WHEN kind = 'method' THEN 'function' ELSE kind END AS kind, {_HAS_DOCS} AS d FROM ents WHERE {_COUNTED}) GROUP BY ROLLUP (kind)""")
def coverage_by_kind(spark, d):
    return coverage.by_kind(entities(spark, d))


@query(f"""{WITH} SELECT * FROM (SELECT module AS file, qualified_name AS entity_name, kind AS entity_type,
CASE WHEN NOT {_HAS_DOCS} THEN 'no documentation' WHEN kind IN ('function', 'method') AND NOT {_CTOR} AND NOT {_VOID} AND doc.returns IS NULL THEN 'missing @return' END AS issue,
CASE WHEN kind IN ('type_alias', 'concept') THEN 0 ELSE line END AS line FROM ents WHERE {_COUNTED}) WHERE issue IS NOT NULL""")
def missing_items(spark, d):
    return coverage.missing_items(entities(spark, d))


_LINT = f"""{WITH},
own AS (SELECT * FROM ents WHERE kind IN ('function', 'method', 'class', 'struct', 'enum', 'typedef', 'macro', 'type_alias', 'concept') AND coalesce(access, 'public') <> 'private'),
told AS (SELECT p.* FROM dparams p JOIN own o ON p.entity_id = o.entity_id WHERE o.doc IS NOT NULL AND o.kind IN ('function', 'method')),
seen AS (SELECT entity_id, unnest(doc.see_also) AS target FROM own WHERE doc IS NOT NULL),
lost AS (SELECT * FROM seen WHERE NOT EXISTS (SELECT 1 FROM syms WHERE lookup_key = target)),
short_q AS (SELECT DISTINCT target AS q FROM lost WHERE strlen(target) <= 20 AND target <> ''),
short_n AS (SELECT DISTINCT lookup_key AS n FROM syms WHERE strlen(lookup_key) <= 20 AND lookup_key <> ''),
near AS (SELECT q, min(struct_pack(d := levenshtein(q, n), n := n)) AS b FROM short_q, short_n WHERE abs(length(q) - length(n)) <= 3 AND levenshtein(q, n) <= 3 GROUP BY q),
found AS (
  SELECT entity_id, 'W001' AS code, 'no documentation' AS message, NULL AS suggestion FROM own WHERE doc IS NULL
  UNION ALL SELECT entity_id, 'W002', 'empty @brief description', NULL FROM own WHERE doc IS NOT NULL AND coalesce(doc.brief, '') = ''
  UNION ALL SELECT entity_id, 'I001', '@brief exceeds 80 characters (' || strlen(doc.brief) || ' chars)', NULL FROM own WHERE doc IS NOT NULL AND doc.brief <> '' AND strlen(doc.brief) > 80
  UNION ALL SELECT entity_id, 'W005', 'missing @return for non-void function', NULL FROM own WHERE doc IS NOT NULL AND kind IN ('function', 'method') AND NOT {_CTOR} AND NOT {_VOID} AND doc.returns IS NULL
  UNION ALL SELECT entity_id, 'W006', '@return present for void function', NULL FROM own WHERE doc IS NOT NULL AND kind IN ('function', 'method') AND NOT {_CTOR} AND {_VOID} AND doc.returns IS NOT NULL
  UNION ALL SELECT entity_id, 'W012', 'empty @return description', NULL FROM own WHERE doc IS NOT NULL AND kind IN ('function', 'method') AND NOT {_CTOR} AND NOT {_VOID} AND doc.returns = ''
  UNION ALL SELECT entity_id, 'W008', 'duplicate @param for ''' || name || '''', NULL FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, name ORDER BY pos) AS n FROM told) WHERE n > 1
  UNION ALL SELECT entity_id, 'W010', 'empty @param description for ''' || name || '''', NULL FROM told WHERE description = ''
  UNION ALL SELECT entity_id, 'W007', '@see ''' || target || ''' - symbol not found', 'Did you mean ''' || b.n || '''?' FROM lost LEFT JOIN near ON target = q),
issues AS (
  SELECT module AS file, CASE WHEN kind IN ('type_alias', 'concept') THEN 0 ELSE line END AS line, qualified_name AS entity_name, kind AS entity_type,
  CASE WHEN code IN ('W010', 'W012', 'I001') THEN 'info' ELSE 'warning' END AS severity, code, message, suggestion FROM found JOIN own USING (entity_id))
"""


def _issues(spark, d, **options):
    return lint.issues(entities(spark, d), live(spark, d), lint.Config(**options), doc_params=doc_params(spark, d))


@query(_LINT + "SELECT * FROM issues")
def lint_issues(spark, d):
    return _issues(spark, d)


@query(_LINT + "SELECT CASE WHEN code = 'W001' THEN 'error' ELSE severity END AS severity, count(*) AS issues FROM issues WHERE code <> 'I001' GROUP BY 1")
def severity_counts(spark, d):
    return lint.counts(_issues(spark, d, severities={"W001": "error", "I001": "off"}))


@query(_LINT + f""", c AS (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues)
SELECT errors, warnings, CASE WHEN warnings > 0 THEN 2 WHEN errors > 0 THEN 1 ELSE 0 END AS exit_status FROM c""")
def exit_status(spark, d):
    return lint.exit_status(_issues(spark, d), coverage.by_kind(entities(spark, d)), strict=True, min_coverage=80)


@query(_LINT + f""", c AS (SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM issues),
p AS (SELECT count(*) FILTER ({_HAS_DOCS}) * 100.0 / count(*) AS percentage FROM ents WHERE {_COUNTED})
SELECT least_allowed, errors, warnings, CASE WHEN errors > 0 THEN 1 WHEN percentage < least_allowed THEN 2 ELSE 0 END AS exit_status FROM c, p, (VALUES (1), (60), (100)) v(least_allowed)""")
def exit_status_by_coverage(spark, d):
    """Without strictness the coverage decides, against several least values."""
    found, covered = _issues(spark, d), coverage.by_kind(entities(spark, d))
    one = lambda n: lint.exit_status(found, covered, min_coverage=n).select(F.lit(n).alias("least_allowed"), "errors", "warnings", "exit_status")
    return one(1).unionByName(one(60)).unionByName(one(100))


@query(f"""{WITH} SELECT qualified_name, kind, count(*) AS times FROM ents GROUP BY ALL HAVING count(*) > 1""")
def duplicate_names(spark, d):
    """Overloads and homonyms."""
    return entities(spark, d).groupBy("qualified_name", "kind").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


@query(f"""{WITH} SELECT entity_id FROM ents WHERE doc IS NOT NULL AND coalesce(doc.brief, '') = '' AND {_CHECKED}""")
def empty_brief(spark, d):
    return lint.single(lint.checked(entities(spark, d), lint.Config()), lint.Config()).where("code = 'W002'").select("entity_id")


@query(f"""{WITH} SELECT entity_id, strlen(doc.brief)::int AS bytes FROM ents WHERE doc.brief <> '' AND NOT regexp_matches(doc.brief, '[.!?]$') AND {_CHECKED}""")
def brief_no_period(spark, d):
    own = lint.checked(entities(spark, d), lint.Config())
    hit = lint.single(own, lint.Config(require_brief_period=True)).where("code = 'I002'").select("entity_id")
    return own.join(hit, "entity_id").select("entity_id", F.octet_length("doc.brief").alias("bytes"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT (p_name GLOB '*widget*' OR p_name GLOB 'c?l*')")
def glob_exclude(spark, d):
    return table(spark, d, "part").where(~exprs.glob_any(F.col("p_name"), ["*widget*", "c?l*"])).select("p_partkey", "p_name")


@query(f"""{WITH} SELECT path, regexp_matches(path, '\\.(cpp|cxx|cc|hpp|hxx|hh|C|H)$') AS cpp, strlen(content)::int AS bytes FROM files WHERE regexp_matches(path, '\\.(h|hpp|hxx|hh|H)$') AND strlen(content) <= 10485760""")
def header_files(spark, d):
    return extract.headers(sources(spark, d)).select("path", exprs.is_cpp(F.col("path")).alias("cpp"), F.octet_length("content").alias("bytes"))


@query(f"""{WITH}, q AS (SELECT DISTINCT regexp_extract(target, '([^:]*)$', 1) AS query FROM doc_refs),
n AS (SELECT DISTINCT regexp_extract(lookup_key, '([^:(]*)(\\(.*)?$', 1) AS name FROM symbols),
qs AS (SELECT query FROM q WHERE strlen(query) BETWEEN 1 AND 20 AND query NOT IN (SELECT name FROM n)), ns AS (SELECT name FROM n WHERE strlen(name) BETWEEN 1 AND 20)
SELECT query, b.n AS suggestion, b.d::int AS distance FROM (SELECT query, min(struct_pack(d := levenshtein(query, name), n := name)) AS b FROM qs, ns
WHERE abs(length(query) - length(name)) <= 3 AND levenshtein(query, name) <= 3 GROUP BY query)""")
def did_you_mean(spark, d):
    names = table(spark, d, "symbols").select(F.regexp_extract("lookup_key", r"([^:(]*)(\(.*)?$", 1).alias("name")).distinct()
    asked = table(spark, d, "doc_refs").select(F.regexp_extract("target", "([^:]*)$", 1).alias("query")).where("query is not null").distinct()
    return symbols.similar(asked.join(names, F.col("query") == F.col("name"), "left_anti"), names)


@query(f"""{WITH} SELECT lookup_key, translate(lookup_key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_ ', 'abcdefghijklmnopqrstuvwxyz--') AS anchor_of, translate(lookup_key, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS index_anchor,
CASE WHEN contains(lookup_key, '(') THEN array_to_string(list_concat([string_split(split_part(lookup_key, '(', 1), '::')[-1]], string_split(lookup_key, '(')[2:]), '(') ELSE string_split(lookup_key, '::')[-1] END AS short,
regexp_matches(lookup_key, '^[A-Za-z0-9_-]+$') AS anchor_id, string_split(source_file, '/')[-1] AS base, regexp_replace(string_split(source_file, '/')[-1], '\\.(h|hpp)$', '') AS title,
CASE WHEN instr(lookup_key, '_') >= 3 THEN split_part(lookup_key, '_', 1) ELSE 'misc' END AS prefix FROM syms""")
def symbol_names(spark, d):
    """Forms of all keys, signatures too; ``short`` is cut before the parameters, as these may hold ``::`` themselves."""
    k, s = F.col("lookup_key"), F.col("source_file")
    return live(spark, d).select(
        k, exprs.anchor(k).alias("anchor_of"), exprs.index_anchor(k).alias("index_anchor"), exprs.short_key(k).alias("short"), exprs.is_anchor_id(k).alias("anchor_id"), exprs.basename(s).alias("base"), exprs.header_title(s).alias("title"), exprs.prefix_group(k).alias("prefix")
    )


@query(f"""{WITH} SELECT kind, count(*) AS entities FROM ents WHERE kind IN ('function', 'struct', 'union', 'enum', 'typedef') GROUP BY 1""")
def project_stats(spark, d):
    return grouping.project_stats(entities(spark, d))


@query(f"""{WITH} SELECT CASE WHEN instr(name, '_') >= 3 THEN split_part(name, '_', 1) ELSE 'misc' END AS prefix, kind, count(*) AS entities FROM ents WHERE kind NOT IN ('type_alias', 'concept', 'method') GROUP BY ALL""")
def prefix_groups(spark, d):
    return grouping.by_prefix(entities(spark, d))


@query(f"""{WITH} SELECT module, kind, count(*) AS entities, regexp_replace(string_split(module, '/')[-1], '\\.(h|hpp)$', '') AS title FROM ents WHERE kind IN ('function', 'struct', 'union', 'enum', 'typedef', 'macro', 'class', 'type_alias', 'concept') GROUP BY ALL""")
def header_groups(spark, d):
    return grouping.by_header(entities(spark, d))


MODULES = [("network", ["*/net/*"]), ("rendering", ["*/render/*", "*/geo/*"]), ("frozen", ["frozen_*.h*", "stale_??*"]), ("rest", ["*_borbor/core/*"])]


@query(f"""{WITH} SELECT path, CASE WHEN path GLOB '*/net/*' THEN 'network' WHEN path GLOB '*/render/*' OR path GLOB '*/geo/*' THEN 'rendering'
WHEN string_split(path, '/')[-1] GLOB 'frozen_*.h*' OR path GLOB 'frozen_*.h*' OR string_split(path, '/')[-1] GLOB 'stale_??*' OR path GLOB 'stale_??*' THEN 'frozen' WHEN path GLOB '*_borbor/core/*' THEN 'rest' END AS assigned FROM files""")
def module_assignment(spark, d):
    return grouping.by_module(sources(spark, d).select("path"), MODULES)


@query(f"""{WITH} SELECT * FROM syms""")
def symbol_first_wins(spark, d):
    return live(spark, d)


@query(f"""{WITH}, k AS (SELECT CASE kind WHEN 'function' THEN 0 WHEN 'struct' THEN 1 WHEN 'enum' THEN 2 WHEN 'typedef' THEN 3 WHEN 'class' THEN 4 ELSE 5 END AS k, * FROM ents WHERE kind IN ('function', 'struct', 'enum', 'typedef', 'class', 'method')),
full_ AS (SELECT *, 0 AS r, qualified_name AS lookup_key FROM k),
owners AS (SELECT entity_id FROM (SELECT *, row_number() OVER (PARTITION BY lookup_key ORDER BY module, k, ord, entity_id) AS n FROM full_) WHERE n = 1),
cand AS (SELECT * FROM full_ UNION ALL SELECT *, 1, string_split(qualified_name, '::')[-1] FROM k WHERE entity_id IN (SELECT entity_id FROM owners))
SELECT lookup_key, kind, module AS source_file, translate(qualified_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_ ', 'abcdefghijklmnopqrstuvwxyz--') AS anchor, qualified_name AS name
FROM (SELECT *, row_number() OVER (PARTITION BY lookup_key ORDER BY module, k, ord, r, entity_id) AS n FROM cand) WHERE n = 1""")
def symbol_table(spark, d):
    return symbols.symbol_table(entities(spark, d))


def _asked(spark, d):
    """What members of namespaces and classes may ask for: a short name from inside a scope."""
    return entities(spark, d).select(F.col("entity_id").alias("query_id"), F.col("namespace").alias("scope"), exprs.short_name(F.col("qualified_name")).alias("name"))


_SCOPED = f"""{WITH}, q AS (SELECT entity_id AS query_id, coalesce(namespace, '') AS scope, string_split(qualified_name, '::')[-1] AS name FROM ents),
parts AS (SELECT *, CASE WHEN scope = '' THEN [] ELSE string_split(scope, '::') END AS p FROM q),
probes AS (SELECT query_id, name, r, array_to_string(list_concat(p[1:len(p) - r], [name]), '::') AS key FROM (SELECT *, unnest(range(0, len(p) + 1)) AS r FROM parts)),
hits AS (SELECT query_id, arg_min(lookup_key, r) AS lookup_key FROM probes JOIN syms ON key = lookup_key GROUP BY 1),
scoped AS (SELECT query_id, name, lookup_key FROM q LEFT JOIN hits USING (query_id))
"""


@query(_SCOPED + "SELECT query_id, lookup_key FROM scoped")
def scoped_lookup(spark, d):
    return symbols.scoped_lookup(_asked(spark, d), live(spark, d))


@query(_SCOPED + """, ends AS (SELECT e, min(lookup_key) AS k FROM (SELECT lookup_key, unnest([array_to_string(string_split(lookup_key, '::')[i:], '::') for i in range(1, len(string_split(lookup_key, '::')) + 1)]) AS e FROM syms) GROUP BY 1)
SELECT query_id, coalesce(lookup_key, k) AS lookup_key FROM scoped LEFT JOIN ends ON name = e""")
def fuzzy_lookup(spark, d):
    return symbols.fuzzy_lookup(_asked(spark, d), live(spark, d))


PREFIXES = [("base::", "https://docs.example.org/base/$$"), ("std::", "https://en.cppreference.com/w/cpp/$$"), ("oarlock_borbor::geo::", "https://docs.example.org/geo/$$?n=$$"), ("oarlock_borbor::", "https://docs.example.org/oarlock/$$")]


@query("""SELECT target, url FROM (SELECT DISTINCT target, CASE WHEN starts_with(target, 'base::') THEN 'https://docs.example.org/base/' || substr(target, 7) WHEN starts_with(target, 'std::') THEN 'https://en.cppreference.com/w/cpp/' || substr(target, 6)
WHEN starts_with(target, 'oarlock_borbor::geo::') THEN 'https://docs.example.org/geo/' || substr(target, 22) || '?n=' || substr(target, 22) WHEN starts_with(target, 'oarlock_borbor::') THEN 'https://docs.example.org/oarlock/' || substr(target, 17) END AS url FROM doc_refs) WHERE url IS NOT NULL""")
def external_links(spark, d):
    return links.external_links(table(spark, d, "doc_refs").select("target").distinct(), PREFIXES, "target").where("url is not null")


@query(f"""{WITH}, r AS (SELECT DISTINCT e.module, target FROM doc_refs JOIN ents e USING (entity_id) WHERE target IS NOT NULL), p AS (SELECT DISTINCT module, id FROM pages)
SELECT r.module, target, CASE WHEN lookup_key IS NOT NULL THEN 'symbol' WHEN id IS NOT NULL THEN 'page' WHEN regexp_matches(target, '^[A-Za-z0-9_-]+$') THEN 'anchor' ELSE 'unresolved' END AS resolved_as,
CASE WHEN lookup_key IS NOT NULL THEN '#' || anchor WHEN id IS NOT NULL THEN target || '.md' WHEN regexp_matches(target, '^[A-Za-z0-9_-]+$') THEN '#' || target END AS link FROM r LEFT JOIN syms ON target = lookup_key LEFT JOIN p ON p.module = r.module AND id = target""")
def resolve_ref(spark, d):
    refs = table(spark, d, "doc_refs").where("target is not null").select("entity_id", "target").distinct().join(entities(spark, d).select("entity_id", "module"), "entity_id").select("module", "target").distinct()
    return links.resolve(refs, live(spark, d), table(spark, d, "pages"))


_INDEX = f"""{WITH}, i AS (SELECT entity_id, module, kind, string_split(qualified_name, '::')[-1] AS name, qualified_name,
CASE WHEN strlen(doc.brief) > 60 THEN CASE WHEN strlen(doc.brief) = length(doc.brief) THEN substr(doc.brief, 1, 60) END || '...' ELSE doc.brief END AS brief, strlen(doc.brief) <> length(doc.brief) AS odd,
translate(qualified_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS anchor FROM ents
WHERE kind IN ('function', 'class', 'struct', 'enum', 'macro', 'typedef', 'concept') OR (kind = 'method' AND coalesce(access, 'public') = 'public')),
l AS (SELECT *, upper(substr(name, 1, 1)) AS letter FROM i)
"""


@query(_INDEX + """SELECT i.entity_id, l.module, l.kind, l.name, l.qualified_name, CASE WHEN strlen(doc.brief) > 60 THEN substr(doc.brief, 1, list_max(list_filter(range(0, 61), lambda n: strlen(substr(doc.brief, 1, n)) <= 60))) || '...' ELSE doc.brief END AS brief,
l.anchor, letter, row_number() OVER (PARTITION BY letter ORDER BY l.qualified_name, i.entity_id) = 1 AS new_letter FROM l JOIN ents i ON l.entity_id = i.entity_id""")
def symbol_index(spark, d):
    """The index with every brief, cut at 60 bytes on a character's edge."""
    return grouping.index_ordered(grouping.index(entities(spark, d)))


@query(f"""{WITH} SELECT entity_id, module, kind, ord, coalesce(kind IS DISTINCT FROM lag(kind) OVER w, true) OR row_number() OVER w = 1 AS new_kind FROM ents WINDOW w AS (PARTITION BY module ORDER BY ord, entity_id)""")
def section_headings(spark, d):
    return grouping.headings(entities(spark, d).select("entity_id", "module", "kind", "ord"), ["kind"], ["ord", "entity_id"], ["module"])


@query("""SELECT *, coalesce(o_orderstatus <> open_section, o_orderstatus IS NOT NULL) AS new_section FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END AS o_orderstatus,
last_value(CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderstatus END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_section FROM orders)""")
def output_sections(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("O")).alias("o_orderstatus"))
    return grouping.section_of(rows, "o_orderstatus", ["o_orderkey"], ["o_custkey"])


@query(f"""{WITH}, l AS (SELECT entity_id, unnest(regexp_extract_all(doc.raw, '(?m)^[\\s*/]*[@\\\\](note|warning|todo|bug|since|see)\\s+(\\S.*)$')) AS line FROM ents WHERE doc IS NOT NULL)
SELECT entity_id, regexp_extract(line, '[@\\\\](note|warning|todo|bug|since|see)', 1) AS tag, count(*) AS times FROM l GROUP BY ALL""")
def tag_lines(spark, d):
    pattern = r"(?m)^[\s*/]*[@\\](note|warning|todo|bug|since|see)\s+(\S.*)$"
    found = entities(spark, d).select("entity_id", F.explode(F.regexp_extract_all("doc.raw", F.lit(pattern), F.lit(1))).alias("tag"))
    return found.groupBy("entity_id", "tag").agg(F.count(F.lit(1)).alias("times"))


_INCLUDES = f"""{WITH}, lines AS (SELECT path AS module, unnest(string_split_regex(content, '\\r?\\n')) AS l, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) AS line FROM files),
inc AS (SELECT module, line::int AS line, coalesce(nullif(regexp_extract(l, '^\\s*#\\s*include\\s*<([^>]*)>', 1), ''), regexp_extract(l, '^\\s*#\\s*include\\s*"([^"]*)"', 1)) AS path, regexp_matches(l, '^\\s*#\\s*include\\s*<') AS is_system
FROM lines WHERE regexp_matches(l, '^\\s*#\\s*include\\s*(<[^>]*>|"[^"]*")'))
"""


@query(_INCLUDES + "SELECT * FROM inc")
def include_lines(spark, d):
    return extract.includes(sources(spark, d))


@query(_INCLUDES + "SELECT string_split(module, '/')[-1] AS src, string_split(path, '/')[-1] AS dst, count(*) AS times FROM inc WHERE NOT is_system GROUP BY ALL")
def include_edges(spark, d):
    return graph.include_edges(extract.includes(sources(spark, d))).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times"))


@query(_INCLUDES + "SELECT DISTINCT n AS name FROM (SELECT string_split(module, '/')[-1] AS n FROM inc WHERE NOT is_system UNION ALL SELECT string_split(path, '/')[-1] FROM inc WHERE NOT is_system)")
def include_nodes(spark, d):
    return graph.include_nodes(graph.include_edges(extract.includes(sources(spark, d))))


@query(f"""{WITH}, c AS (SELECT DISTINCT qualified_name AS name FROM ents WHERE kind = 'class'), e AS (SELECT DISTINCT m.qualified_name AS child, p.qualified_name AS parent FROM ents m JOIN ents p ON m.parent_id = p.entity_id)
SELECT name FROM c WHERE name NOT IN (SELECT child FROM e)""")
def class_roots(spark, d):
    e = entities(spark, d)
    own = e.select("entity_id", F.col("qualified_name").alias("child"), "parent_id").join(e.select(F.col("entity_id").alias("parent_id"), F.col("qualified_name").alias("parent")), "parent_id").select("child", "parent")
    return graph.roots(e.where("kind = 'class'").select(F.col("qualified_name").alias("name")), own)


@query(f"""{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, up AS (SELECT entity_id AS start, parent_id AS reached, 1 AS depth FROM ents WHERE parent_id IS NOT NULL UNION SELECT start, parent_id, up.depth + 1 FROM up JOIN ents e ON e.entity_id = reached WHERE parent_id IS NOT NULL)
SELECT start, reached, min(depth)::int AS depth FROM up GROUP BY ALL""")
def nesting(spark, d):
    return graph.nesting(entities(spark, d))


_CHANGES = """
WITH old AS (SELECT doc_id::varchar AS path, sha256(text) AS hash, n_chars AS mtime, strlen(text) AS size FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0),
new AS (SELECT doc_id::varchar AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS hash, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS mtime, strlen(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS size FROM documents WHERE text IS NOT NULL AND (doc_id % 11 <> 0 OR doc_id % 7 = 0)),
st AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'new_file' WHEN n.path IS NULL THEN 'deleted' WHEN (o.mtime = n.mtime AND o.size = n.size) OR o.hash = n.hash THEN 'unchanged' ELSE 'modified' END AS status FROM old o FULL JOIN new n ON o.path = n.path)
"""


def _changes(spark, d):
    """The manifest of the documents before and after some were added, changed and taken away."""
    docs = table(spark, d, "documents").where("text is not null")
    at = F.col("doc_id")
    old = manifest.manifest(docs.where(at % 7 != 0).select(at.cast("string").alias("path"), F.col("text").alias("content"), F.col("n_chars").alias("mtime")))
    text = F.when(at % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = manifest.manifest(docs.where((at % 11 != 0) | (at % 7 == 0)).select(at.cast("string").alias("path"), text.alias("content"), F.when(at % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("mtime")))
    return manifest.changes(old, new)


@query(_CHANGES + "SELECT path, status FROM st")
def change_status(spark, d):
    return _changes(spark, d)


def _calls(spark, d):
    return testcov.calls(testcov.uses(sources(spark, d)), live(spark, d))


# A use stands before one of ``( < { .``, or behind a dot; comments are no uses, strings are.
_USES = f"""{WITH}, bare AS (SELECT path AS file, regexp_replace(content, '//[^\\n]*|/\\*(?s:.*?)\\*/', ' ', 'g') AS t FROM files WHERE content IS NOT NULL),
u AS (SELECT file, unnest(regexp_extract_all(t, '(?:[A-Za-z_]\\w*(?:::[A-Za-z_]\\w*)?)\\s*[(<{{.]')) AS u FROM bare),
n AS (SELECT file, regexp_extract(u, '^([A-Za-z_]\\w*(?:::[A-Za-z_]\\w*)?)', 1) AS name FROM u), m AS (SELECT file, name FROM n UNION ALL SELECT file, split_part(name, '::', 1) FROM n WHERE contains(name, '::')),
calls AS (SELECT syms.name AS symbol, min(kind) AS kind, count(*) AS calls, min(file) AS first_file FROM m JOIN syms ON m.name = lookup_key GROUP BY 1)
"""


@query(_USES + "SELECT symbol, calls FROM calls")
def call_totals(spark, d):
    return _calls(spark, d).select("symbol", "calls")


@query(_USES + "SELECT * FROM calls")
def call_counts(spark, d):
    return _calls(spark, d)


@query(_USES + """, ends AS (SELECT DISTINCT e FROM (SELECT unnest([array_to_string(string_split(lookup_key, '::')[i:], '::') FOR i IN range(2, len(string_split(lookup_key, '::')) + 1)]) AS e FROM syms)),
own AS (SELECT * FROM syms WHERE contains(lookup_key, '::') OR lookup_key NOT IN (SELECT e FROM ends)),
f AS (SELECT name, min(kind) AS kind FROM own WHERE kind IN ('function', 'class_type', 'struct_type') GROUP BY 1)
SELECT f.kind, count(*) AS total, count(symbol) AS tested, round(count(symbol) * 100.0 / count(*), 6)::double AS percentage FROM f LEFT JOIN calls ON symbol = name GROUP BY ROLLUP (f.kind)""")
def test_stats(spark, d):
    """Of canonical symbols: a short key that another key ends with doesn't count."""
    own = testcov.canonical(live(spark, d)).where("kind in ('function', 'class_type', 'struct_type')").groupBy("name").agg(F.min("kind").alias("kind"))
    return testcov.stats(own, _calls(spark, d))


@query(_USES + "SELECT lookup_key, name FROM syms WHERE name NOT IN (SELECT symbol FROM calls)")
def untested_symbols(spark, d):
    return testcov.untested(live(spark, d), _calls(spark, d)).select("lookup_key", "name")


@query(_LINT + f""", cov AS (SELECT * FROM (SELECT module AS file, line, CASE WHEN NOT {_HAS_DOCS} THEN 'no documentation' WHEN kind IN ('function', 'method') AND NOT {_CTOR} AND NOT {_VOID} AND doc.returns IS NULL THEN 'missing @return' END AS message FROM ents WHERE {_COUNTED}) WHERE message IS NOT NULL)
SELECT file, line, message FROM issues UNION ALL SELECT file, line, message FROM cov c WHERE NOT EXISTS (SELECT 1 FROM issues i WHERE i.file = c.file AND i.line = c.line AND i.message = c.message)""")
def merge_diagnostics(spark, d):
    cov = coverage.missing_items(entities(spark, d)).select("file", "line", F.col("issue").alias("message"))
    return grouping.merge_diagnostics(_issues(spark, d).select("file", "line", "message"), cov)


@query("""SELECT DISTINCT id, replace(replace(replace(coalesce(title, id), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS title, replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM pages""")
def html_escape(spark, d):
    return table(spark, d, "pages").select("id", exprs.html_escape(F.coalesce("title", "id")).alias("title"), exprs.html_escape(F.col("content")).alias("html")).distinct()


@query("""SELECT DISTINCT id, url_encode(content) AS encoded, 'https://godbolt.org/#g132:' || url_encode('-O2 -std=c++20') || ':' || url_encode(title) AS url FROM pages""")
def percent_encode(spark, d):
    p = table(spark, d, "pages")
    return p.select("id", exprs.percent_encode(F.col("content")).alias("encoded"), exprs.explorer_url(F.col("title")).alias("url")).distinct()


@query(f"""{WITH} SELECT entity_id, sha256(doc.raw) AS hash, lower(string_split(qualified_name, '::')[-1]) = lower(name) AS same FROM ents""")
def content_hashes(spark, d):
    return entities(spark, d).select("entity_id", exprs.content_hash(F.col("doc.raw")).alias("hash"), (F.lower(exprs.short_name(F.col("qualified_name"))) == F.lower("name")).alias("same"))


_DECLARED = ("function", "method", "class", "struct", "enum", "typedef", "macro", "type_alias", "concept", "union")
_FLAGS = ("is_const", "is_constexpr", "is_noexcept", "is_static", "is_virtual")


@query(f"""{WITH} SELECT DISTINCT module, kind, line, col_no, name, qualified_name, CASE WHEN kind <> 'macro' THEN namespace END AS namespace, access, method_kind, return_type, ord, depth,
array_to_string(list_sort(list_filter(map_keys(flags), lambda f: f IN {_FLAGS})), ',') AS flags FROM ents WHERE kind IN {_DECLARED} AND module IN (SELECT path FROM files)""")
def parse_entities(spark, d):
    """Declarations of the parsed files but include guards, found by our own parser, with their place, scope, kind of method, type and flags.

    ``ord`` counts declarations only. A macro has no namespace, whatever the table gives it."""
    parsed = entities(spark, d).select(F.col("module").alias("path")).distinct()
    nodes = extract.nodes(sources(spark, d).join(parsed, "path", "left_semi")).where(F.col("kind").isin(*_DECLARED) & ~extract.is_guard())
    ord_ = F.row_number().over(Window.partitionBy("module").orderBy("ord")) - 1
    flags = F.array_join(F.array_sort(F.filter(F.map_keys("flags"), lambda f: f.isin(*_FLAGS))), ",")
    return nodes.select("module", "kind", "line", "col_no", "name", "qualified_name", F.when(F.col("kind") != "macro", F.col("namespace")).alias("namespace"), "access", "method_kind", "return_type", ord_.alias("ord"), "depth", flags.alias("flags"))


# What the documentation parser makes of the comments, from their text: marks and margins are taken off first, alike on both sides.
_MARKS = r"(?m)^\s*(/\*\*|/\*!|\*/|\*|///|//!)\s?|\s*\*/\s*$"
_DOCS = f"""{WITH}, t AS (SELECT entity_id, regexp_replace(doc.raw, '{_MARKS}', '', 'g') AS x FROM ents WHERE doc.raw IS NOT NULL),
f AS (SELECT *, CASE WHEN regexp_matches(x, '[@\\\\](param|return|brief)') THEN 'doxygen' WHEN regexp_matches(x, '###? ') THEN 'markdown' ELSE 'unknown' END AS format,
  [trim(l, ' ' || chr(9) || chr(13)) FOR l IN string_split(x, chr(10))] AS ls FROM t),
n AS (SELECT *, list_position([regexp_matches(l, '^[@\\\\]brief ') OR regexp_matches(l, '^[^@\\\\]') FOR l IN ls], true) AS began FROM f),
b AS (SELECT *, CASE WHEN began > 0 THEN trim(regexp_replace(ls[began], '^[@\\\\]brief ', '')) END AS brief,
  [l FOR l IN ls[began + 1:]] AS behind FROM n),
e AS (SELECT *, list_position([regexp_matches(l, '^[@\\\\](' || '{"|".join(doccomment.END_TAGS)}' || ')') FOR l IN behind], true) AS stop FROM b),
d AS (SELECT *, nullif(trim(array_to_string(CASE WHEN began IS NULL OR began = 0 THEN [] WHEN stop > 0 THEN behind[1:stop - 1] ELSE behind END, chr(10)), ' *' || chr(9) || chr(10) || chr(13)), '') AS details,
  regexp_extract_all(array_to_string(ls, chr(10)), '(?m)^[@\\\\][A-Za-z_]+(?:[ \\t][^\\n]*)?(?:\\n[^@\\\\\\n][^\\n]*)*$') AS blocks FROM e),
g AS (SELECT *, CASE WHEN format = 'doxygen' THEN [struct_pack(tag := regexp_extract(k, '^.([A-Za-z_]+)', 1), rest := trim(replace(regexp_replace(k, '^.[A-Za-z_]+', ''), chr(10), ' '))) FOR k IN blocks] ELSE [] END AS tags FROM d)
"""


def _docs(spark, d):
    text = F.regexp_replace("doc.raw", _MARKS.replace("(?m)", "(?md)"), "")
    return entities(spark, d).where("doc.raw is not null").select("entity_id", doccomment.parse_doc(text).alias("d"))


@query(_DOCS + """SELECT entity_id, format, brief, CASE WHEN format = 'doxygen' THEN details END AS details, list_filter(tags, lambda k: k.tag IN ('return', 'returns'))[-1].rest AS returns,
list_filter(tags, lambda k: k.tag = 'since' AND k.rest <> '')[-1].rest AS since, CASE WHEN list_filter(tags, lambda k: k.tag = 'deprecated')[-1].rest = '' THEN 'This is deprecated.' ELSE list_filter(tags, lambda k: k.tag = 'deprecated')[-1].rest END AS deprecated,
array_to_string([k.rest FOR k IN tags IF k.tag IN ('see', 'sa') AND k.rest <> ''], '|') AS see_also, array_to_string([k.rest FOR k IN tags IF k.tag = 'note' AND k.rest <> ''], '|') AS notes,
array_to_string([k.rest FOR k IN tags IF k.tag = 'warning' AND k.rest <> ''], '|') AS warnings, array_to_string([k.rest FOR k IN tags IF k.tag = 'todo' AND k.rest <> ''], '|') AS todos, array_to_string([k.rest FOR k IN tags IF k.tag = 'bug' AND k.rest <> ''], '|') AS bugs,
list_filter(tags, lambda k: k.tag = 'author' AND k.rest <> '')[-1].rest AS author, list_filter(tags, lambda k: k.tag = 'version' AND k.rest <> '')[-1].rest AS version FROM g""")
def parse_docs(spark, d):
    """The documentation parser on every stored comment: format, brief, details and the texts of tags."""
    lists = [F.array_join(f"d.{x}", "|").alias(x) for x in ("see_also", "notes", "warnings", "todos", "bugs")]
    return _docs(spark, d).select("entity_id", *(f"d.{x}" for x in ("format", "brief", "details", "returns", "since", "deprecated", "author", "version")), *lists)


@query(_DOCS + """, p AS (SELECT entity_id, unnest([k FOR k IN tags IF k.tag IN ('param', 'tparam', 'throw', 'exception', 'retval') AND k.rest <> '']) AS k FROM g)
SELECT entity_id, k.tag AS tag, split_part(k.rest, ' ', 1) AS name, CASE WHEN contains(k.rest, ' ') THEN trim(substr(k.rest, instr(k.rest, ' ') + 1)) ELSE '' END AS description FROM p""")
def parse_doc_params(spark, d):
    """The parameters, template parameters, exceptions and return values that stored comments name."""
    docs = _docs(spark, d)
    out = None
    for field, name, tags in (("params", "name", "param"), ("tparams", "name", "tparam"), ("exceptions", "type", "throw"), ("retvals", "value", "retval")):
        rows = docs.select("entity_id", F.explode(f"d.{field}").alias("p")).select("entity_id", F.lit(tags).alias("tag"), F.col(f"p.{name}").alias("name"), F.col("p.description").alias("description"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _parsed(spark, d):
    from marginalia.runtime import materialize

    return materialize(extract.nodes(sources(spark, d)), "parsed")


@query()
def lint_sources(spark, d):
    """All rules over the parsed sources: parameters, template parameters and references too."""
    p = _parsed(spark, d)
    own = extract.entities(p)
    table_ = symbols.symbol_table(own, extract.params(p))
    return lint.issues(own, table_, params=extract.params(p), doc_params=extract.doc_params(p), tparams=extract.tparams(p), doc_tparams=extract.doc_tparams(p))


@query()
def missing_items_sources(spark, d):
    p = _parsed(spark, d)
    return coverage.missing_items(extract.entities(p), extract.params(p), extract.doc_params(p), extract.tparams(p), extract.doc_tparams(p))


@query(rf"""{WITH}, t AS (SELECT DISTINCT return_type AS type_str FROM ents WHERE return_type IS NOT NULL UNION SELECT DISTINCT 'const ' || target || ' *' FROM doc_refs WHERE target IS NOT NULL UNION SELECT DISTINCT 'std::vector<' || target || '> &' FROM doc_refs WHERE target IS NOT NULL),
b AS (SELECT type_str, trim(regexp_replace(split_part(regexp_replace(regexp_replace(type_str, '\b(const|volatile|struct|enum|union|class)\b', '', 'g'), '[*&].*$', ''), '<', 1), '\s+', ' ', 'g'), ' ') AS base_type FROM t)
SELECT type_str, base_type, coalesce('../' || CASE WHEN kind IN ('function', 'method') THEN 'functions' WHEN kind = 'macro' THEN 'macros' ELSE 'types' END || '/' || regexp_replace(string_split(source_file, '/')[-1], '^(.+)\.[^.]*$', '\1') || '.md#'
  || translate(name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_ ', 'abcdefghijklmnopqrstuvwxyz--'), CASE WHEN starts_with(base_type, 'std::') THEN 'https://en.cppreference.com/w/cpp/' || substr(base_type, 6) END) AS link FROM b LEFT JOIN syms ON base_type = lookup_key""")
def type_links(spark, d):
    """The links of all return types, and of types made of all reference targets."""
    own = entities(spark, d).where("return_type is not null").select(F.col("return_type").alias("type_str"))
    target = table(spark, d, "doc_refs").where("target is not null").select("target")
    made = target.select(F.concat(F.lit("const "), "target", F.lit(" *")).alias("type_str")).union(target.select(F.concat(F.lit("std::vector<"), "target", F.lit("> &"))))
    return links.type_links(own.union(made).distinct(), live(spark, d))


@query(r"""WITH t AS (SELECT DISTINCT module || '/' || id AS text_id, '@brief ' || trim(regexp_replace(content, '\s+', ' ', 'g')) AS x FROM pages WHERE content IS NOT NULL),
r AS (SELECT text_id, regexp_extract_all(x, '[@\\]ref[ \t]+[^\s,.\];]+') AS rs FROM t)
SELECT text_id, (n - 1)::int AS pos, regexp_replace(rs[n], '^.ref[ \t]+', '') AS target, 'symbol' AS kind FROM (SELECT *, unnest(range(1, len(rs) + 1)) AS n FROM r)""")
def inline_refs(spark, d):
    """The inline references of the pages, read as documentation of one line."""
    text = F.concat(F.lit("@brief "), F.trim(F.regexp_replace("content", r"\s+", " ")))
    docs = table(spark, d, "pages").where("content is not null").select(F.concat_ws("/", "module", "id").alias("text_id"), text.alias("_x")).distinct().select("text_id", doccomment.parse_doc(F.col("_x")).alias("d"))
    return docs.select("text_id", F.posexplode("d.refs").alias("pos", "r")).select("text_id", "pos", "r.target", "r.kind")


@query(rf"""{WITH}, t AS (SELECT DISTINCT module || '/' || id AS text_id, content FROM pages),
m AS (SELECT text_id, string_split(regexp_replace(content, '[@\\]ref\s+([^\s,;\]"]*[^\s,.;\]"])(?:\s+"([^"]*)")?', chr(1) || '\1' || chr(2) || '\2' || chr(1), 'g'), chr(1)) AS ps FROM t),
p AS (SELECT text_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM m),
q AS (SELECT text_id, n, p, CASE WHEN n % 2 = 0 THEN split_part(p, chr(2), 1) END AS target, split_part(p, chr(2), 2) AS told FROM p)
SELECT text_id, string_agg(CASE WHEN target IS NULL THEN p WHEN anchor IS NOT NULL THEN '[' || coalesce(nullif(told, ''), target) || '](#' || anchor || ')' ELSE chr(96) || coalesce(nullif(told, ''), target) || chr(96) END, '' ORDER BY n) AS text
FROM q LEFT JOIN syms ON target = lookup_key GROUP BY 1""")
def page_links(spark, d):
    """Pages with their references as links."""
    pages = table(spark, d, "pages").select(F.concat_ws("/", "module", "id").alias("text_id"), F.col("content").alias("text")).distinct()
    return links.rewrite(pages, live(spark, d))


@query(f"""{WITH} SELECT module AS path, count(*) FILTER (kind = 'function') AS functions, count(*) FILTER (kind = 'class') AS classes, bool_or(doc IS NULL) AS has_undocumented FROM ents GROUP BY 1""")
def module_summary(spark, d):
    return entities(spark, d).groupBy(F.col("module").alias("path")).agg(F.count_if(F.col("kind") == "function").alias("functions"), F.count_if(F.col("kind") == "class").alias("classes"), F.bool_or(F.col("doc").isNull()).alias("has_undocumented"))


@query("""SELECT user_id, arg_max(value, struct_pack(t := ts, e := event_id)) AS value, max(event_id) FILTER (event_type = 'signup') AS opened FROM events GROUP BY 1""")
def document_state(spark, d):
    """Batch twin of the keyed document state: the last event of each key."""
    e = table(spark, d, "events")
    return e.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("opened"))


_EVENTS = """
WITH e AS (SELECT 'file:///u' || user_id AS uri, event_id AS seq, CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'close' WHEN 'view' THEN 'save' ELSE 'change' END AS action, event_type || ' ' || event_id AS text FROM events),
s AS (SELECT *, coalesce(last_value(CASE WHEN action IN ('open', 'close') THEN action END IGNORE NULLS) OVER (PARTITION BY uri ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'close') AS before FROM e),
st AS (SELECT uri, seq, action, CASE WHEN action <> 'close' THEN text END AS text FROM s WHERE action = 'open' OR before = 'open')
"""


def _edits(spark, d):
    """Events of the table as edits of documents: signup opens, error closes, view saves, all else replaces the text."""
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close").when(F.col("event_type") == "view", "save").otherwise("change")
    none = [F.lit(None).cast("int").alias(c) for c in ("start_line", "start_char", "end_line", "end_char")]
    return e.select(F.concat(F.lit("file:///u"), F.col("user_id").cast("string")).alias("uri"), F.col("event_id").alias("seq"), action.alias("action"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("text"), *none)


@query(_EVENTS + "SELECT * FROM st")
def document_states(spark, d):
    return documents.states_batch(_edits(spark, d))


@query(_EVENTS + "SELECT uri, arg_max(coalesce(text, '-'), seq) AS text, max(seq) AS seq FROM st GROUP BY 1")
def document_latest(spark, d):
    """Live documents as a stream with keyed state, run to the end of its input."""
    from marginalia.runtime import scratch

    at = scratch(spark, "edits")
    _edits(spark, d).repartition(4).sortWithinPartitions("seq").write.parquet(f"{at}/in")
    stream = documents.states(spark.readStream.schema(documents.EVENTS).parquet(f"{at}/in"))
    stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return documents.latest(spark.read.schema(documents.STATES).parquet(f"{at}/out").withColumn("text", F.coalesce("text", F.lit("-"))))


@query(f"""SELECT DISTINCT sarif_id, CASE WHEN body IS NULL OR NOT json_valid(body) THEN 'InvalidJson' WHEN coalesce(json_type(body, '$.runs'), '') <> 'ARRAY' OR coalesce(json_type(body, '$.runs[0].properties'), '') <> 'OBJECT' THEN 'InvalidStructure'
WHEN coalesce(json_type(body, '$.runs[0].properties."{VERSION_KEY}"'), '') <> 'VARCHAR' THEN 'MissingVersion' WHEN json_extract_string(body, '$.runs[0].properties."{VERSION_KEY}"') <> '1.0' THEN 'UnsupportedVersion'
WHEN coalesce(json_type(body, '$.runs[0].properties."{MODULES_KEY}"'), '') <> 'ARRAY' THEN 'MissingModules' ELSE 'ok' END AS status FROM sarif_documents""")
def sarif_status(spark, d):
    return sarif.statuses(table(spark, d, "sarif_documents")).select("sarif_id", "status").distinct()


@query()
def sarif_export(spark, d):
    return sarif.module_documents(_parsed(spark, d))


_RESULT = """to_json(struct_pack(ruleId := code, level := CASE WHEN severity = 'info' THEN 'note' ELSE severity END, message := struct_pack("text" := message || ' (in ' || entity_type || ' ' || chr(39) || entity_name || chr(39) || ')'),
locations := [struct_pack(physicalLocation := struct_pack(artifactLocation := struct_pack(uri := replace(file, chr(92), '/')), region := struct_pack(startLine := line)))]))"""
_RESULT = f"""CASE WHEN line > 0 THEN {_RESULT} ELSE {_RESULT.replace(", region := struct_pack(startLine := line)", "")} END::varchar"""


@query(_LINT + f"SELECT file, line, code, {_RESULT} AS result FROM issues")
def sarif_results(spark, d):
    return sarif.results(_issues(spark, d))


@query(_LINT + f""", r AS (SELECT file, line, code, {_RESULT} AS result FROM issues),
u AS (SELECT file, code, to_json(struct_pack(id := code, defaultConfiguration := struct_pack(level := min(CASE WHEN severity = 'info' THEN 'note' ELSE severity END))))::varchar AS j FROM issues GROUP BY file, code)
SELECT file, '{{"$schema":"{sarif.SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{sarif.TOOL}","version":"{sarif.TOOL_VERSION}","rules":[' || rules || ']}}}},"results":[' || results || ']}}]}}' AS body
FROM (SELECT file, string_agg(j, ',' ORDER BY code) AS rules FROM u GROUP BY 1) JOIN (SELECT file, string_agg(result, ',' ORDER BY line, code, result) AS results FROM r GROUP BY 1) USING (file)""")
def lint_documents(spark, d):
    return sarif.lint_documents(_issues(spark, d))


@query(_LINT + "SELECT code, arg_min(severity, struct_pack(f := file, l := line, m := message)) AS severity FROM issues GROUP BY 1")
def sarif_rules(spark, d):
    return sarif.rules(_issues(spark, d))


@query()
def module_pages(spark, d):
    return render.module_pages(_parsed(spark, d))


@query(_INDEX + """, b AS (SELECT l.*, CASE WHEN strlen(doc.brief) > 60 THEN substr(doc.brief, 1, list_max(list_filter(range(0, 61), lambda n: strlen(substr(doc.brief, 1, n)) <= 60))) || '...' ELSE doc.brief END AS shown FROM l JOIN ents i ON l.entity_id = i.entity_id),
s AS (SELECT letter, regexp_replace(string_split(module, '/')[-1], '^(.+)\\.[^.]*$', '\\1') AS stem, string_agg('- [' || chr(96) || qualified_name || chr(96) || '](#' || anchor || ')' || coalesce(' — ' || shown, '') || chr(10), '' ORDER BY qualified_name, entity_id) AS md FROM b GROUP BY ALL)
SELECT 'INDEX/' || letter || '/' || stem || '.md' AS path, '## ' || letter || chr(10) || chr(10) || md AS content FROM s""")
def index_pages(spark, d):
    return render.index_page(entities(spark, d))


@query(_INCLUDES + """SELECT 'INCLUDES/' || regexp_replace(string_split(module, '/')[-1], '\\.[^.]*$', '') || '.md' AS path, '# Includes of ' || module || chr(10) || chr(10) ||
string_agg('- ' || CASE WHEN is_system THEN '<' || path || '>' ELSE '"' || path || '"' END || chr(10), '' ORDER BY line) AS content FROM inc GROUP BY module""")
def includes_pages(spark, d):
    return render.includes_pages(extract.includes(sources(spark, d)))


@query("""SELECT DISTINCT CASE WHEN coalesce(is_mainpage, false) THEN 'introduction.md' ELSE 'pages/' || id || '.md' END AS path, '# ' || coalesce(title, id) || chr(10) || chr(10) || coalesce(content, '') AS content FROM pages""")
def custom_pages(spark, d):
    return render.custom_pages(table(spark, d, "pages"))


@query(f"""{WITH} SELECT module || ':' || CASE WHEN line > 0 THEN line ELSE 1 END || ':1: ' || CASE WHEN issue = 'no documentation' THEN 'warning' ELSE 'note' END || ': ' || issue || ' ''' || entity_name || ''' (' || entity_type || ')' AS text FROM (SELECT module, qualified_name AS entity_name, kind AS entity_type,
CASE WHEN NOT {_HAS_DOCS} THEN 'no documentation' WHEN kind IN ('function', 'method') AND NOT {_CTOR} AND NOT {_VOID} AND doc.returns IS NULL THEN 'missing @return' END AS issue,
CASE WHEN kind IN ('type_alias', 'concept') THEN 0 ELSE line END AS line FROM ents WHERE {_COUNTED}) WHERE issue IS NOT NULL""")
def compiler_report(spark, d):
    return coverage.report_lines(coverage.missing_items(entities(spark, d)))


@query(_LINT + "SELECT file AS uri, greatest(line - 1, 0) AS line, CASE severity WHEN 'info' THEN 'information' ELSE severity END AS severity, code, message FROM issues")
def diagnostics(spark, d):
    return documents.to_diagnostics(_issues(spark, d))


@query()
def code_actions(spark, d):
    p = _parsed(spark, d)
    own = extract.entities(p)
    issues = lint.issues(own, None, params=extract.params(p), doc_params=extract.doc_params(p))
    return documents.code_actions(issues, own, extract.params(p))


@query()
def class_diagram(spark, d):
    """The classes of the parsed sources with their bases, as the lines of one diagram."""
    p = _parsed(spark, d)
    classes = p.where("kind in ('class', 'struct')")
    pure = graph.abstract_classes(p.where("kind = 'method'")).withColumnRenamed("parent_id", "entity_id")
    nodes = classes.join(pure, "entity_id", "left").select(F.col("qualified_name").alias("name"), "is_abstract")
    bases = extract.bases(classes).join(classes.select("entity_id", F.col("qualified_name").alias("child")), "entity_id").select("child", F.col("name").alias("base"), "pos")
    edges = graph.match_bases(nodes, bases)
    return graph.class_diagram(graph.class_nodes(nodes, edges), edges)


_TREE = """
WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
up AS (SELECT src AS start, dst AS reached, 1 AS depth FROM e UNION ALL SELECT start, dst, depth + 1 FROM up JOIN e ON src = reached)
"""


def _tree(spark, d):
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    edge = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("src"), F.concat(F.lit(b), F.col(y).cast("string")).alias("dst"))
    return edge(n, "r", "n_regionkey", "n", "n_nationkey").unionByName(edge(c, "n", "c_nationkey", "c", "c_custkey"))


@query(_TREE + "SELECT start, reached, depth::int AS depth FROM up")
def hierarchy(spark, d):
    return graph.closure(_tree(spark, d))


@query(_TREE + ", p AS (SELECT dst AS child, src AS root FROM e) SELECT a.child, coalesce(b.root, a.root) AS root FROM p a LEFT JOIN p b ON a.root = b.child")
def hierarchy_roots(spark, d):
    return graph.first_parent_root(_tree(spark, d).select(F.col("dst").alias("child"), F.col("src").alias("parent"), F.lit(0).alias("pos")))


@query(_TREE.replace("WITH RECURSIVE", "WITH RECURSIVE st AS (SELECT 'c' || c_custkey AS path, CASE WHEN c_custkey % 50 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM customer UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 10 = 1 THEN 'modified' ELSE 'unchanged' END FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey = 4 THEN 'deleted' ELSE 'unchanged' END FROM region),")
       + "SELECT DISTINCT path FROM (SELECT path FROM st WHERE status = 'modified' UNION ALL SELECT reached FROM up JOIN st ON st.path = start WHERE status <> 'unchanged')")
def rebuild_tree(spark, d):
    """What has to be rebuilt when some of what it needs has changed or gone: customers need their nation, nations their region."""
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    name = lambda a, x: F.concat(F.lit(a), F.col(x).cast("string")).alias("path")
    status = (
        c.select(name("c", "c_custkey"), F.when(F.col("c_custkey") % 50 == 0, "modified").otherwise("unchanged").alias("status"))
        .unionByName(n.select(name("n", "n_nationkey"), F.when(F.col("n_nationkey") % 10 == 1, "modified").otherwise("unchanged").alias("status")))
        .unionByName(r.select(name("r", "r_regionkey"), F.when(F.col("r_regionkey") == 4, "deleted").otherwise("unchanged").alias("status")))
    )
    return manifest.rebuild_set(status, _tree(spark, d).select(F.col("dst").alias("path"), F.col("src").alias("needs")))
