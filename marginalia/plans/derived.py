"""Queries of operators for which no table has input of the right form: their input is made from tables by expressions, alike in the query and in its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import exprs
from marginalia.operators import coverage, graph, grouping, links, manifest, render, snippets, symbols, testcov
from marginalia.plans.reference import _COUNTED, _CTOR, _HAS_DOCS, _TREE, _VOID, WITH, _tree, entities, table
from marginalia.runtime import scratch
from marginalia.streaming import documents

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return keep


def _text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# -- graphs ------------------------------------------------------------------------------------------------------------


@query(_TREE + "SELECT reached AS start, start AS reached, depth::int AS depth FROM up")
def dependents(spark, d):
    """Who needs a node, directly or not: nations their region, customers their nation."""
    return graph.dependents(_tree(spark, d))


_STATUS = """
, st AS (SELECT 'c' || c_custkey AS path, CASE WHEN c_custkey % 50 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM customer UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 10 = 1 THEN 'deleted' ELSE 'unchanged' END FROM nation
UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey = 4 THEN 'modified' ELSE 'unchanged' END FROM region)
"""


@query(_TREE + _STATUS + "SELECT path, CASE WHEN status = 'unchanged' AND path IN (SELECT dst FROM e JOIN st s ON s.path = src WHERE s.status <> 'unchanged') THEN 'modified' ELSE status END AS status FROM st")
def dependency_status(spark, d):
    """What is modified because something that it needs directly is modified or deleted."""
    c, n, r = (table(spark, d, x) for x in ("customer", "nation", "region"))
    status = (
        c.select(_text("c", F.col("c_custkey")).alias("path"), F.when(F.col("c_custkey") % 50 == 0, "modified").otherwise("unchanged").alias("status"))
        .unionByName(n.select(_text("n", F.col("n_nationkey")).alias("path"), F.when(F.col("n_nationkey") % 10 == 1, "deleted").otherwise("unchanged").alias("status")))
        .unionByName(r.select(_text("r", F.col("r_regionkey")).alias("path"), F.when(F.col("r_regionkey") == 4, "modified").otherwise("unchanged").alias("status")))
    )
    return manifest.with_dependencies(status, _tree(spark, d).select(F.col("dst").alias("path"), F.col("src").alias("needs")))


@query("""WITH f AS (SELECT 'src/m' || p_size || '/p' || p_partkey || '.h' AS path, p_partkey, p_size FROM part),
i AS (SELECT path, CASE p_partkey % 3 WHEN 0 THEN 'src/m' || p_size || '/p' || (p_partkey + 1) || '.h' WHEN 1 THEN 'src/m' || (p_size % 50 + 1) || '/p' || (p_partkey + 2) || '.h' ELSE 'p' || (p_partkey + 3) || '.h' END AS needs FROM f)
SELECT DISTINCT i.path, i.needs FROM i JOIN f ON f.path = i.needs""")
def include_resolution(spark, d):
    """Local includes in several spellings, sought beside the file that has them."""
    p, size, key = table(spark, d, "part"), F.col("p_size"), F.col("p_partkey")
    path = _text("src/m", size, "/p", key, ".h")
    told = F.when(key % 3 == 0, _text("./p", key + 1, ".h")).when(key % 3 == 1, _text("../m", size % 50 + 1, "//x/../p", key + 2, ".h")).otherwise(_text("../../p", key + 3, ".h"))
    return manifest.dependencies(p.select(path.alias("module"), told.alias("path"), F.lit(False).alias("is_system")), p.select(path.alias("path")))


_CLASSES = """WITH c AS (SELECT 'ns::R' || r_regionkey AS name, r_regionkey % 2 = 0 AS is_abstract FROM region UNION ALL SELECT 'ns::N' || n_nationkey, false FROM nation),
b AS (SELECT 'ns::N' || n_nationkey AS child, 'R' || (n_regionkey + n_nationkey % 2 * 3) || '<int>' AS base FROM nation),
e AS (SELECT child, coalesce(c.name, base) AS parent FROM b LEFT JOIN c ON c.name = 'ns::' || regexp_replace(base, '<.*', '')),
n AS (SELECT name, false AS is_external, is_abstract FROM c UNION ALL SELECT DISTINCT parent, true, false FROM e WHERE parent NOT IN (SELECT name FROM c))
"""


def _classes(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    nodes = r.select(_text("ns::R", F.col("r_regionkey")).alias("name"), (F.col("r_regionkey") % 2 == 0).alias("is_abstract")).unionByName(n.select(_text("ns::N", F.col("n_nationkey")).alias("name"), F.lit(False).alias("is_abstract")))
    bases = n.select(_text("ns::N", F.col("n_nationkey")).alias("child"), _text("R", F.col("n_regionkey") + F.col("n_nationkey") % 2 * 3, "<int>").alias("base"), F.lit(0).alias("pos"))
    edges = graph.match_bases(nodes, bases)
    return graph.class_nodes(nodes, edges), edges


@query(_CLASSES + "SELECT name, is_external, is_abstract FROM n")
def class_nodes(spark, d):
    return _classes(spark, d)[0]


@query(_CLASSES + r""", i AS (SELECT *, regexp_replace(name, '[^A-Za-z0-9_]', '_', 'g') AS id FROM n)
SELECT 1 AS part, '    class ' || id AS text FROM i UNION ALL SELECT 1, '    <<abstract>> ' || id FROM i WHERE is_abstract UNION ALL SELECT 1, '    <<external>> ' || id FROM i WHERE is_external
UNION ALL SELECT 2, '    ' || regexp_replace(parent, '[^A-Za-z0-9_]', '_', 'g') || CASE WHEN is_abstract THEN ' <|.. ' ELSE ' <|-- ' END || regexp_replace(child, '[^A-Za-z0-9_]', '_', 'g') FROM e JOIN n ON n.name = parent""")
def class_diagram_lines(spark, d):
    return graph.class_diagram(*_classes(spark, d))


@query(_CLASSES + r"""SELECT 1 AS part, CASE WHEN is_abstract THEN 'abstract ' ELSE '' END || 'class "' || name || '"' || CASE WHEN is_external THEN ' <<external>>' ELSE '' END AS text FROM n
UNION ALL SELECT 2, '"' || parent || '"' || CASE WHEN is_abstract THEN ' <|.. ' ELSE ' <|-- ' END || '"' || child || '"' FROM e JOIN n ON n.name = parent""")
def class_diagram_uml(spark, d):
    return graph.class_diagram(*_classes(spark, d), style="plantuml")


@query("""WITH e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)
SELECT parent AS path, 0 AS depth, parent AS text FROM (SELECT DISTINCT parent FROM e WHERE parent LIKE 'r%') UNION ALL SELECT parent || '/' || child, 1, '├── ' || child FROM e WHERE parent LIKE 'r%'
UNION ALL SELECT DISTINCT a.parent || '/' || a.child || '/' || b.child, 2, '│   ├── ' || b.child FROM e a JOIN e b ON b.parent = a.child WHERE a.parent LIKE 'r%'""")
def nested_tree(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    edges = n.select(_text("n", F.col("n_nationkey")).alias("child"), _text("r", F.col("n_regionkey")).alias("parent")).unionByName(s.select(_text("s", F.col("s_suppkey")).alias("child"), _text("n", F.col("s_nationkey")).alias("parent")))
    return graph.ascii_tree(edges)


@query("""SELECT 1 AS part, '    ' || n || '["' || n || '"]' AS text FROM (SELECT 'n' || n_nationkey AS n FROM nation UNION SELECT 'r' || n_regionkey FROM nation) UNION ALL SELECT 2, '    n' || n_nationkey || ' --> r' || n_regionkey FROM nation""")
def include_diagram(spark, d):
    return graph.include_mermaid(table(spark, d, "nation").select(_text("n", F.col("n_nationkey")).alias("src"), _text("r", F.col("n_regionkey")).alias("dst")))


# -- manifests ---------------------------------------------------------------------------------------------------------


@query("""SELECT 'p' || p_partkey AS path FROM part WHERE p_partkey % 5 = 0 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0""")
def needs_rebuild(spark, d):
    """New inputs (of five), changed ones (of seven) and those without output (of eleven)."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    path = _text("p", k).alias("path")
    old = p.where(k % 5 != 0).select(path, F.sha2("p_name", 256).alias("hash"))
    new = p.select(path, F.sha2(F.when(k % 7 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), 256).alias("hash"))
    return manifest.needs_rebuild(old, new, p.where(k % 11 != 0).select(path))


@query("""SELECT 'p' || p_partkey AS path, sha256(CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END) AS hash, (p_partkey % 3 = 0)::int::decimal(38, 0) AS mtime, strlen(CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END) AS size FROM part WHERE p_partkey % 7 <> 0""")
def stored_manifest(spark, d):
    """A manifest that is written, read, brought up to date and written again; the last version counts."""
    p, k, at = table(spark, d, "part"), F.col("p_partkey"), scratch(spark, "manifest")
    path = _text("p", k).alias("path")
    manifest.save(manifest.manifest(p.select(path, F.col("p_name").alias("content"), F.lit(0).alias("mtime"))), at)
    later = manifest.manifest(p.where(k % 3 == 0).select(path, F.concat("p_name", F.lit("!")).alias("content"), F.lit(1).alias("mtime")))
    manifest.save(manifest.replace(manifest.load(spark, at), later, p.where(k % 7 == 0).select(path)), at)
    return manifest.load(spark, at)


@query("""SELECT DISTINCT path, needs FROM (SELECT 'n' || n_nationkey AS path, 'r' || n_regionkey AS needs FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 'n' || n_nationkey, 'new' || (n_nationkey % 4) FROM nation WHERE n_nationkey % 3 = 0)""")
def edges_replaced(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    old = n.select(_text("n", k).alias("path"), _text("r", F.col("n_regionkey")).alias("needs"))
    return manifest.upsert(old, n.where(k % 3 == 0).select(_text("n", k).alias("path"), _text("new", k % 4).alias("needs")))


# -- texts -------------------------------------------------------------------------------------------------------------


@query(r"""WITH p AS (SELECT DISTINCT path, content FROM sources WHERE content IS NOT NULL), l AS (SELECT path, content, string_split(content, chr(10)) AS ls FROM p)
SELECT path, 'file://' || path AS uri, path AS back, CASE WHEN string_split(path, '/')[-1] = 'a.h' THEN '' ELSE regexp_replace(string_split(path, '/')[-1], '\.(h|hpp|hxx)$', '') || '.md' END AS link,
least(list_sum([strlen(x) + 1 FOR x IN ls[1:2]]) + 5, strlen(content))::bigint AS at, CASE WHEN regexp_matches(path, '\.(cpp|hpp|cc|cxx|hxx|hh)$') THEN 'cpp' WHEN regexp_matches(path, '\.[ch]$') THEN 'c' ELSE 'cpp' END AS language FROM l""")
def paths_and_places(spark, d):
    """Forms of paths, and the byte offset of a place (line 2, byte 5) in each text."""
    p, path = table(spark, d, "sources").where("content is not null").select("path", "content").distinct(), F.col("path")
    return p.select(
        "path", exprs.path_to_uri(path).alias("uri"), exprs.uri_to_path(exprs.path_to_uri(path)).alias("back"), exprs.relative_link(path, F.lit("x/a.h")).alias("link"),
        exprs.text_offset(F.col("content"), F.lit(2), F.lit(5)).cast("bigint").alias("at"), exprs.language(path).alias("language"),
    )


_MARKED = """WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a.py' WHEN 1 THEN 'a.css' WHEN 2 THEN 'a.html' ELSE 'a.cpp' END AS path, CASE p_partkey % 4 WHEN 0 THEN '# [m]' WHEN 1 THEN '/* [m] */' WHEN 2 THEN '<!-- [m] -->' ELSE '// [m]' END AS mark FROM part)
SELECT p_partkey, mark AS marker, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS text FROM f JOIN part USING (p_partkey)"""


@query(_MARKED)
def excerpts(spark, d):
    """What stands between two markers in the comment style of the file; nothing where there is one marker only."""
    p, k = table(spark, d, "part"), F.col("p_partkey")
    path = F.when(k % 4 == 0, "a.py").when(k % 4 == 1, "a.css").when(k % 4 == 2, "a.html").otherwise("a.cpp")
    mark = exprs.snippet_marker(path, F.lit("m"))
    content = F.concat(F.lit("x\n"), mark, F.lit("\n"), "p_name", F.lit("\n"), F.when(k % 5 != 0, mark).otherwise(F.lit("")), F.lit("\ny"))
    return p.select("p_partkey", mark.alias("marker"), exprs.snippet(path, content, F.lit("m")).alias("text"))


@query("""SELECT 't' || p_partkey AS text_id, 'a ' || CASE WHEN p_size < 25 THEN CASE p_partkey % 3 WHEN 0 THEN n_name ELSE 'inner ' || n_nationkey END ELSE '<!-- Include error: d/' || p_size || '.h -->' END || ' b' AS text
FROM part LEFT JOIN nation ON n_nationkey = p_size WHERE NOT (p_size < 25 AND p_partkey % 3 = 0) UNION ALL SELECT 't' || p_partkey, 'a ' || n_name || chr(10) || '// ANCHOR: z' || chr(10) || 'inner ' || n_nationkey || chr(10) || '// ANCHOR_END: z' || chr(10) || ' b'
FROM part JOIN nation ON n_nationkey = p_size WHERE p_size < 25 AND p_partkey % 3 = 0""")
def include_expansion(spark, d):
    """Include directives in texts, of whole files and of parts between anchors; files that aren't there give an error text."""
    p, n, k = table(spark, d, "part"), table(spark, d, "nation"), F.col("p_partkey")
    files = n.select(_text("d/", F.col("n_nationkey"), ".h").alias("path"), _text(F.col("n_name"), "\n// ANCHOR: z\ninner ", F.col("n_nationkey"), "\n// ANCHOR_END: z\n").alias("content"))
    texts = p.select(_text("t", k).alias("text_id"), _text("a {{#include d/", F.col("p_size"), F.when(k % 3 == 0, ".h").otherwise(".h:z"), "}} b").alias("text"))
    return snippets.expand_includes(texts, files)


@query("""WITH t AS (SELECT 'f' || p_size AS file, p_partkey AS k FROM part), u AS (
  SELECT 'x' || k AS file, 0 AS pos, 'outside' AS name, NULL AS test FROM t UNION ALL SELECT 'x' || k, 1, 'ns::make' || (k % 9), 't' || k FROM t UNION ALL SELECT 'x' || k, 2, 'ns', 't' || k FROM t UNION ALL SELECT 'x' || k, 3, 'obj', 't' || k FROM t
  UNION ALL SELECT 'x' || k, 4, 'size', 't' || k FROM t UNION ALL SELECT 'x' || k, 5, 'Box', 't' || k FROM t UNION ALL SELECT 'x' || k, 6, 'after', NULL FROM t)
SELECT * FROM u""")
def test_scopes(spark, d):
    """Names used inside and outside of tests; comments and strings don't count, nor do braces within a test end it."""
    k = F.col("p_partkey")
    content = _text("// none(1)\nvoid g() { outside(1); }\nTEST(t", k, ") {\n  if (ok) { ns::make", k % 9, '(2, "str(3)"); }\n  obj.size(); Box<int> b; /* gone(4) */\n}\nint x = after(5);\n')
    return testcov.scoped_uses(table(spark, d, "part").select(_text("x", k).alias("path"), content.alias("content"))).where("name != 'if' and name != 'g' and name != 'TEST'").withColumn("pos", F.row_number().over(_window()) - 1)


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("file").orderBy("pos")


# -- documentation -----------------------------------------------------------------------------------------------------


@query(f"""{WITH}, m AS (SELECT kind, issue FROM (SELECT CASE WHEN kind = 'method' THEN 'function' ELSE kind END AS kind, CASE WHEN NOT {_HAS_DOCS} THEN 'no documentation' WHEN kind IN ('function', 'method') AND NOT {_CTOR} AND NOT {_VOID} AND doc.returns IS NULL THEN 'missing @return' END AS issue FROM ents WHERE {_COUNTED})
  UNION ALL SELECT CASE WHEN o.kind = 'method' THEN 'function' ELSE o.kind END, 'missing @param' FROM ents o JOIN dparams p ON p.entity_id = o.entity_id WHERE {_COUNTED.replace('kind', 'o.kind', 1)} AND o.kind IN ('function', 'method') AND {_HAS_DOCS} AND p.description = '' AND p.name <> ''),
t AS (SELECT CASE WHEN kind = 'method' THEN 'function' ELSE kind END AS kind, {_HAS_DOCS} AS d FROM ents WHERE {_COUNTED}),
a AS (SELECT kind, count(*) AS total, count(*) FILTER (d) AS documented, round(count(*) FILTER (d) * 100.0 / count(*), 6)::double AS percentage FROM t GROUP BY ROLLUP (kind)),
b AS (SELECT kind, count(*) FILTER (issue = 'missing @param') AS missing_params, count(*) FILTER (issue = 'missing @return') AS missing_returns FROM m GROUP BY ROLLUP (kind))
SELECT a.*, coalesce(missing_params, 0) AS missing_params, coalesce(missing_returns, 0) AS missing_returns FROM a LEFT JOIN b ON a.kind IS NOT DISTINCT FROM b.kind""")
def coverage_with_missing(spark, d):
    """Coverage with what documented functions leave out. A parameter counts as declared if a comment names it, and as documented if it is described there."""
    own, told = entities(spark, d), table(spark, d, "doc_params").drop("ingested_at").dropDuplicates(["entity_id", "pos"])
    missing = coverage.missing_items(own, told.select("entity_id", "pos", "name"), told.where("description != ''").select("entity_id", "name"))
    # Names that are described elsewhere in the same comment aren't missing; the SQL counts rows, so these are counted apart.
    twice = told.groupBy("entity_id", "name").agg(F.count_if(F.col("description") != "").alias("_d")).where("_d > 0")
    lost = told.where("description = '' and name != ''").join(twice, ["entity_id", "name"], "left_semi").join(coverage.counted(own).where(F.col("kind").isin("function", "method") & exprs.has_docs(F.col("doc"))).select("entity_id", F.col("kind").alias("entity_type")), "entity_id")
    both = missing.select("entity_type", "issue").unionByName(lost.select("entity_type", F.lit("missing @param").alias("issue")))
    return coverage.by_kind(own, both)


@query(f"""{WITH}, k AS (SELECT CASE kind WHEN 'function' THEN 0 WHEN 'struct' THEN 1 WHEN 'enum' THEN 2 WHEN 'typedef' THEN 3 WHEN 'class' THEN 4 ELSE 5 END AS k, *, CASE WHEN kind = 'class' THEN '*U' || name WHEN kind = 'function' THEN 'unique_' || (line % 50) END AS given FROM ents WHERE kind IN ('function', 'struct', 'enum', 'typedef', 'class', 'method')),
full_ AS (SELECT *, 0 AS r, qualified_name AS lookup_key FROM k),
owners AS (SELECT entity_id FROM (SELECT *, row_number() OVER (PARTITION BY lookup_key ORDER BY module, k, ord, entity_id) AS n FROM full_) WHERE n = 1),
cand AS (SELECT * FROM full_ UNION ALL SELECT *, 1, string_split(qualified_name, '::')[-1] FROM k WHERE entity_id IN (SELECT entity_id FROM owners)
  UNION ALL SELECT *, 2, CASE WHEN starts_with(given, '*') THEN CASE WHEN contains(qualified_name, '::') THEN array_to_string(string_split(qualified_name, '::')[:-2], '::') || '::' || substr(given, 2) END ELSE given END FROM k WHERE given IS NOT NULL AND entity_id IN (SELECT entity_id FROM owners))
SELECT lookup_key, kind, module AS source_file, translate(qualified_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ_ ', 'abcdefghijklmnopqrstuvwxyz--') AS anchor, qualified_name AS name
FROM (SELECT *, row_number() OVER (PARTITION BY lookup_key ORDER BY module, k, ord, r, entity_id) AS n FROM cand WHERE lookup_key IS NOT NULL) WHERE n = 1""")
def unique_symbol_table(spark, d):
    """The symbol table with unique names: of classes relative to their scope, of functions absolute."""
    given = F.when(F.col("kind") == "class", F.concat(F.lit("*U"), "name")).when(F.col("kind") == "function", _text("unique_", F.col("line") % 50))
    return symbols.symbol_table(entities(spark, d).withColumn("doc", F.struct(given.alias("unique_name"))))


def _noted(spark, d):
    """Declarations whose documentation has todos, bugs, tests and groups."""
    k, line = F.col("kind"), F.col("line")
    some = lambda cond, *texts: F.when(cond, F.array(*texts)).otherwise(F.array().cast("array<string>"))
    tests = F.when(line % 5 == 0, F.array(F.struct(_text("t", line).alias("name"), F.when(line % 2 == 0, "x.cpp").alias("file")))).otherwise(F.array().cast("array<struct<name: string, file: string>>"))
    group = F.when(line % 4 == 0, _text("g", line % 3))
    doc = F.struct(some(line % 2 == 0, _text("first ", line), F.lit("second")).alias("todos"), some(line % 3 == 0, _text("bug ", line)).alias("bugs"), tests.alias("tests"), group.alias("group_name"), F.when(line % 8 == 0, _text("Heading ", line)).alias("group_heading"))
    return entities(spark, d).withColumn("doc", doc).where(k.isNotNull())


_NOTED = f"""{WITH}, o AS (SELECT *, CASE WHEN kind = 'method' THEN 0 ELSE line END AS shown FROM ents WHERE kind IN ('function', 'class', 'method', 'struct', 'macro')),
i AS (SELECT module, qualified_name, shown, ord, 'TODO' AS title, p AS pos, CASE p WHEN 0 THEN 'first ' || line ELSE 'second' END AS text FROM o, (VALUES (0), (1)) v(p) WHERE line % 2 = 0
  UNION ALL SELECT module, qualified_name, shown, ord, 'BUGS', 0, 'bug ' || line FROM o WHERE line % 3 = 0
  UNION ALL SELECT module, qualified_name, shown, ord, 'TESTS', 0, 't' || line || CASE WHEN line % 2 = 0 THEN ' (x.cpp)' ELSE '' END FROM o WHERE line % 5 = 0)
"""


@query(_NOTED + "SELECT title, module AS file, qualified_name AS entity_name, shown AS line, ord, pos, text FROM i")
def collected_notes(spark, d):
    own = _noted(spark, d)
    rows = [grouping.collected(own, f).withColumn("title", F.lit(t)) for f, t in (("todos", "TODO"), ("bugs", "BUGS"), ("tests", "TESTS"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(_NOTED + r""", h AS (SELECT *, qualified_name IS DISTINCT FROM lag(qualified_name) OVER w OR row_number() OVER w = 1 AS new FROM i WINDOW w AS (PARTITION BY title, module ORDER BY ord, pos))
SELECT title || '/' || regexp_replace(string_split(module, '/')[-1], '^(.+)\.[^.]*$', '\1') || '.md' AS path, '# ' || title || chr(10) || chr(10) || '## ' || module || chr(10) || chr(10)
|| string_agg(CASE WHEN new THEN '### ' || qualified_name || chr(10) || chr(10) ELSE '' END || '- ' || text || chr(10), '' ORDER BY ord, pos) AS content FROM h GROUP BY title, module""")
def note_pages(spark, d):
    return render.list_pages(_noted(spark, d))


@query(_NOTED + "SELECT bool_or(line % 2 = 0) AS has_todos, bool_or(line % 3 = 0) AS has_bugs, bool_or(line % 5 = 0) AS has_tests FROM ents")
def notes_there(spark, d):
    return grouping.existence(_noted(spark, d))


@query(f"""{WITH} SELECT module, 'g' || (line % 3) AS group_name, min(ord) AS first_ord, arg_min('Heading ' || line, ord) FILTER (line % 8 = 0) AS heading, count(*) AS functions FROM ents WHERE kind = 'function' AND line % 4 = 0 GROUP BY ALL""")
def function_groups(spark, d):
    return grouping.function_groups(_noted(spark, d))


@query(f"""{WITH}, t AS (SELECT entity_id, pos, name, description, CASE WHEN pos % 2 = 0 THEN 'T' || length(name) || ' *' END AS type_str FROM dparams) SELECT entity_id, pos, name, description, arg_min(type_str, pos) OVER (PARTITION BY entity_id, name) AS type_str FROM t""".replace("arg_min(type_str, pos) OVER (PARTITION BY entity_id, name)", "(SELECT arg_min(u.type_str, u.pos) FROM t u WHERE u.entity_id IS NOT DISTINCT FROM t.entity_id AND u.name = t.name AND u.type_str IS NOT NULL)"))
def param_types(spark, d):
    """Documented parameters with the types of those declared (of every second place)."""
    told = table(spark, d, "doc_params").drop("ingested_at").dropDuplicates(["entity_id", "pos"])
    declared = told.where("pos % 2 = 0").select("entity_id", "pos", "name", _text("T", F.length("name"), " *").alias("type_str"))
    return links.param_types(declared, told)


# -- live documents ----------------------------------------------------------------------------------------------------


_EDITED = """
WITH e AS (SELECT 'file:///u' || user_id AS uri, event_id AS seq, CASE event_type WHEN 'signup' THEN 'open' WHEN 'error' THEN 'close' WHEN 'view' THEN 'save' ELSE 'change' END AS action, event_type, event_id || ';' AS text FROM events),
s AS (SELECT *, coalesce(last_value(CASE WHEN action IN ('open', 'close') THEN action END IGNORE NULLS) OVER (PARTITION BY uri ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'close') AS before, count(*) FILTER (action = 'open') OVER (PARTITION BY uri ORDER BY seq) AS session FROM e),
k AS (SELECT * FROM s WHERE action = 'open' OR before = 'open')
SELECT uri, seq, action, CASE WHEN action <> 'close' THEN coalesce(list_aggregate(list_reverse(list(text) FILTER (action = 'change' AND seq % 2 = 0) OVER w), 'string_agg', ''), '') || coalesce(list_aggregate(list(text) FILTER (action = 'open' OR (action = 'change' AND seq % 2 = 1)) OVER w, 'string_agg', ''), '') END AS text
FROM k WINDOW w AS (PARTITION BY uri, session ORDER BY seq)
"""


@query(_EDITED)
def document_edits(spark, d):
    """Edits with ranges: even events put their text before the document's, odd ones behind it; saving changes nothing."""
    e = table(spark, d, "events")
    action = F.when(F.col("event_type") == "signup", "open").when(F.col("event_type") == "error", "close").when(F.col("event_type") == "view", "save").otherwise("change")
    at = F.when(action == "change", F.when(F.col("event_id") % 2 == 0, 0).otherwise(1 << 20)).cast("int")
    text = F.when(action != "save", _text(F.col("event_id"), ";"))
    rows = e.select(_text("file:///u", F.col("user_id")).alias("uri"), F.col("event_id").alias("seq"), action.alias("action"), text.alias("text"), at.alias("start_line"), F.when(at.isNotNull(), 0).alias("start_char"), at.alias("end_line"), F.when(at.isNotNull(), 0).alias("end_char"))
    return documents.states_batch(rows)


@query(f"""{WITH}, i AS (SELECT module AS file, line, qualified_name, CASE WHEN doc IS NULL THEN 'W001' WHEN kind IN ('function', 'method') AND NOT {_CTOR} AND NOT {_VOID} AND doc.returns IS NULL THEN 'W005' END AS code FROM ents WHERE kind IN ('function', 'method')),
n AS (SELECT module AS file, line, arg_max(struct_pack(r := return_type, c := col_no), ord) AS x FROM ents GROUP BY ALL),
j AS (SELECT i.*, repeat(' ', greatest(coalesce(x.c, 1) - 1, 0)::int) AS pad, coalesce(trim(replace(x.r, chr(9), ' ')) NOT IN ('', 'void'), false) AS valued FROM i JOIN n USING (file, line) WHERE code IS NOT NULL)
SELECT file AS uri, line, code, CASE code WHEN 'W001' THEN 'Add documentation' ELSE 'Add @return' END AS title, CASE code WHEN 'W005' THEN pad || ' * @return ' || chr(10)
ELSE pad || '/**' || chr(10) || pad || ' * @brief ' || chr(10) || CASE WHEN valued THEN pad || ' * @return ' || chr(10) ELSE '' END || pad || ' */' || chr(10) END AS new_text FROM j""")
def documentation_stubs(spark, d):
    """What mends missing documentation and missing returns of functions and methods."""
    own = entities(spark, d)
    f = own.where(F.col("kind").isin("function", "method"))
    ctor = F.coalesce(F.col("method_kind"), F.lit("")).isin("constructor", "destructor", "copy_constructor", "move_constructor")
    code = F.when(F.col("doc").isNull(), "W001").when(~ctor & ~F.coalesce(exprs.is_void(F.col("return_type")), F.lit(True)) & F.col("doc.returns").isNull(), "W005")
    issues = f.select(F.col("module").alias("file"), "line", code.alias("code"), F.lit("").alias("message"), F.lit(None).cast("string").alias("suggestion")).where("code is not null")
    return documents.code_actions(issues, own, spark.createDataFrame([], "entity_id string, pos int, name string"))
