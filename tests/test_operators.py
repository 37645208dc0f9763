import pytest
from pyspark.sql import functions as F

from marginalia.operators import coverage, extract, graph, grouping, links, lint, manifest, render, snippets, symbols, testcov

CODE = """
/** Opens a file.
 * @param nme The name
 * @param mode The mode
 * @param mode again
 * @see io::close
 * @see io::shut
 * @return handle
 */
int open_file(const char *name, int mode);
/** Frees all and says something that is much longer than eighty bytes, so that it is too long for a brief.
 * @return nothing */
void free_all(void);
int bare(int x);
#include <vector>
#include "other.h"
namespace io {
/** Closes @brief it. */
int close(int h);
/// A shape.
class Shape { public:
  virtual int area() const = 0; /// hidden
  private: int secret(); };
class Circle : public Shape { public: /** Area. @return a */ int area() const; };
enum Mode { A = 0x10, B };
}
"""


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([("a/x.hpp", CODE), ("a/none.hpp", None), ("a/empty.hpp", "")], "path string, content string")
    return extract.nodes(df).cache()


def test_extract(parsed, spark):
    names = {(r["kind"], r["qualified_name"]) for r in parsed.collect()}
    assert ("function", "io::close") in names and ("method", "io::Shape::area") in names and ("include", "vector") in names
    assert {(r["name"], r["value"]) for r in extract.enum_values(parsed).collect()} == {("A", 16), ("B", None)}
    assert [(r["name"], r["access"]) for r in extract.bases(parsed).collect()] == [("Shape", "public")]
    assert {r["name"] for r in extract.params(parsed).collect()} == {"name", "mode", "x", "h"}
    inc = extract.includes(spark.createDataFrame([("a/x.hpp", CODE)], "path string, content string"))
    assert {(r["path"], r["is_system"]) for r in inc.collect()} == {("vector", True), ("other.h", False)}
    pages = extract.pages_and_groups(spark.createDataFrame([("p", "/** @page one Title\n * text */\n\n/** @defgroup g Name\n * Brief. */\nint f();\n/** @page no x */\nint g();")], "path string, content string")).collect()
    assert [(r["kind"], r["id"]) for r in pages] == [("page", "one"), ("group", "g")]


def test_lint(parsed):
    own = extract.entities(parsed)
    table = symbols.symbol_table(own, extract.params(parsed))
    run = lambda **c: {(r["code"], r["entity_name"], r["suggestion"]) for r in lint.issues(own, table, lint.Config(**c), extract.params(parsed), extract.doc_params(parsed), extract.tparams(parsed), extract.doc_tparams(parsed)).collect()}
    got = run()
    assert ("E001", "open_file", "Did you mean 'name'?") in got and ("W003", "open_file", None) in got and ("W008", "open_file", None) in got
    assert ("W007", "open_file", None) in got and ("W006", "free_all", None) in got and ("I001", "free_all", None) in got and ("W001", "bare", None) in got
    assert sum(c == "W007" for c, _, _ in got) == 1 and not any(n.endswith("secret") for _, n, _ in got)
    assert not any(c == "W001" for c, _, _ in run(severities={"W001": "off"})) and not any(n == "bare" for _, n, _ in run(exclude=["ba*"]))

    cov = coverage.by_kind(own)
    found = lint.issues(own, table, doc_params=extract.doc_params(parsed), params=extract.params(parsed))
    assert lint.exit_status(found, cov).first()["exit_status"] == 1 and lint.exit_status(found, cov, strict=True).first()["exit_status"] == 2
    none = found.limit(0)
    assert lint.exit_status(none, cov, min_coverage=99).first()["exit_status"] == 2 and lint.exit_status(none, cov).first()["exit_status"] == 0


def test_coverage(parsed, spark):
    own = extract.entities(parsed)
    by = {r["kind"]: (r["total"], r["documented"]) for r in coverage.by_kind(own).collect()}
    assert by["function"] == (6, 4) and by["class"] == (2, 1) and by["enum"] == (1, 0) and by[None] == (9, 5)
    items = {(r["entity_name"], r["issue"]) for r in coverage.missing_items(own, extract.params(parsed), extract.doc_params(parsed)).collect()}
    assert ("open_file", "missing @param for 'name'") in items and ("bare", "no documentation") in items
    assert coverage.report_lines(coverage.missing_items(own)).where("text like '%bare%no documentation%' or text like '%no documentation%bare%'").count() == 1
    assert '"total":9' in coverage.report_json(coverage.by_kind(own)).first()["json"] and coverage.report_human(coverage.by_kind(own)).count() == 4
    empty = coverage.by_kind(own.limit(0)).collect()
    assert all(r["percentage"] == 100.0 for r in empty)


def test_symbols(spark):
    e = spark.createDataFrame([("1", "m1", "function", "f", "a::f", 0), ("2", "m2", "function", "f", "b::f", 0), ("3", "m1", "class", "f", "f", 1), ("4", "m3", "function", "f", "a::f", 0)], "entity_id string, module string, kind string, name string, qualified_name string, ord int")
    t = {r["lookup_key"]: (r["name"], r["source_file"]) for r in symbols.symbol_table(e).collect()}
    assert t == {"a::f": ("a::f", "m1"), "b::f": ("b::f", "m2"), "f": ("a::f", "m1")}
    s = spark.createDataFrame([("a::b::x",), ("a::y",), ("z",), ("c::z",)], "lookup_key string")
    q = spark.createDataFrame([(1, "a::b", "x"), (2, "a::b", "y"), (3, "a::b", "z"), (4, "a", "q"), (5, None, "z"), (6, "c::d", "z")], "query_id int, scope string, name string")
    assert {r["query_id"]: r["lookup_key"] for r in symbols.scoped_lookup(q, s).collect()} == {1: "a::b::x", 2: "a::y", 3: "z", 4: None, 5: "z", 6: "c::z"}
    far = spark.createDataFrame([(1, "q", "x"), (2, "", "b::x"), (3, "", "nope")], "query_id int, scope string, name string")
    assert {r["query_id"]: r["lookup_key"] for r in symbols.fuzzy_lookup(far, s).collect()} == {1: "a::b::x", 2: "a::b::x", 3: None}


def test_similar_against_brute_force(spark):
    import random

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcx_") for _ in range(r.randrange(1, 22)))
    names = {word() for _ in range(150)} | {"", "a", "ab"}
    asked = {word() for _ in range(80)} | {"a", "", "b"} | {n[1:] for n in list(names)[:30]}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {}
    for q in asked:
        near = [(distance(q, n), n) for n in names if 0 < len(n) <= 20 and 0 < len(q) <= 20]
        if near and min(near)[0] <= 3:
            want[q] = min(near)[::-1]
    got = symbols.similar(spark.createDataFrame([(q,) for q in asked], "query string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert {x["query"]: (x["suggestion"], x["distance"]) for x in got.collect()} == want


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), (None, "z")], "src string, dst string")
    got = {(r["start"], r["reached"]): r["depth"] for r in graph.closure(e, None).collect()}
    assert got["a", "d"] == 3 and got["a", "a"] == 3 and got["x", "y"] == 1 and len(got) == 3 * 4 + 1
    assert {r["reached"] for r in graph.closure(e, 1, spark.createDataFrame([("c",)], "name string")).collect()} == {"a", "d"}
    assert graph.closure(e.limit(0)).count() == 0
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 0) for i in range(40)] + [("n3", "other", 1)], "child string, parent string, pos int")
    assert {r["root"] for r in graph.first_parent_root(chain).collect()} == {"n40"}
    long = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 0) for i in range(200)] + [("a", "b", 0), ("b", "c", 0), ("c", "b", 0)], "child string, parent string, pos int")
    assert {r["child"]: r["root"] for r in graph.first_parent_root(long).collect()} == {f"n{i}": "n200" for i in range(200)} | dict.fromkeys("abc")
    nodes = spark.createDataFrame([("n::Shape", True), ("Circle", False)], "name string, is_abstract boolean")
    edges = graph.match_bases(nodes, spark.createDataFrame([("Circle", "Shape<int>", 0), ("Circle", "ext::Far", 1)], "child string, base string, pos int"))
    assert {(r["child"], r["parent"]) for r in edges.collect()} == {("Circle", "n::Shape"), ("Circle", "ext::Far")}
    full = graph.class_nodes(nodes, edges)
    lines = {r["text"] for r in graph.class_diagram(full, edges).collect()}
    assert "    n__Shape <|.. Circle" in lines and "    <<external>> ext__Far" in lines and "    <<abstract>> n__Shape" in lines
    assert {r["text"] for r in graph.class_diagram(full, edges, "plantuml").collect()} >= {'"n::Shape" <|.. "Circle"'}
    assert [r["text"] for r in graph.ascii_tree(edges).orderBy("path").collect()] == ["ext::Far", "├── Circle", "n::Shape", "├── Circle"]
    assert {r["name"] for r in graph.roots(nodes, edges).collect()} == {"n::Shape"}
    inc = spark.createDataFrame([("a/x.h", "y.h", False), ("a/x.h", "vector", True)], "module string, path string, is_system boolean")
    assert {(r["src"], r["dst"]) for r in graph.include_edges(inc).collect()} == {("x.h", "y.h")} and graph.include_mermaid(graph.include_edges(inc, True)).count() == 5


def test_manifest(spark):
    old = spark.createDataFrame([("same", "h", 1, 2), ("gone", "h", 1, 2), ("touched", "h", 1, 2), ("changed", "h", 1, 2), ("hidden", "h", 1, 2)], "path string, hash string, mtime long, size long")
    new = spark.createDataFrame([("same", "h", 1, 2), ("touched", "h", 9, 2), ("changed", "i", 9, 2), ("hidden", "i", 1, 2), ("fresh", "h", 1, 2)], "path string, hash string, mtime long, size long")
    status = manifest.changes(old, new)
    assert {r["path"]: r["status"] for r in status.collect()} == {"same": "unchanged", "gone": "deleted", "touched": "unchanged", "changed": "modified", "hidden": "unchanged", "fresh": "new_file"}
    edges = spark.createDataFrame([("same", "changed"), ("touched", "same"), ("hidden", "gone")], "path string, needs string")
    assert {r["path"] for r in manifest.changed(manifest.with_dependencies(status, edges)).collect()} == {"gone", "changed", "fresh", "same", "hidden"}
    assert {r["path"] for r in manifest.rebuild_set(status, edges).collect()} == {"changed", "fresh", "same", "touched", "hidden"}
    assert {r["path"] for r in manifest.needs_rebuild(old, new, spark.createDataFrame([("same",), ("changed",), ("hidden",), ("fresh",)], "path string")).collect()} == {"changed", "hidden", "fresh", "touched"}
    inc = spark.createDataFrame([("same", "./x/../changed", False), ("same", "vector", True), ("same", "lost", False), ("same", "x/changed", False)], "module string, path string, is_system boolean")
    deps = manifest.dependencies(inc, new)
    assert [tuple(r) for r in deps.collect()] == [("same", "changed")] and manifest.upsert(edges, deps.select("path", "needs")).count() == 3


def test_test_coverage(spark):
    t = spark.createDataFrame([("t.cpp", "TEST_CASE(a) { io::open(1); x.close(); /* hidden(1) */ open (2); // gone()\n Box<int> b{}; }"), ("u.cpp", "open(1)"), ("n.cpp", None)], "path string, content string")
    used = testcov.uses(t)
    assert {r["name"] for r in used.collect()} >= {"io::open", "io", "close", "open", "Box"} and not {"hidden", "gone"} & {r["name"] for r in used.collect()}
    s = spark.createDataFrame([("io::open", "function", "io.h", "io::open"), ("open", "function", "io.h", "io::open"), ("lost", "function", "io.h", "lost"), ("Box", "class", "b.h", "Box")], "lookup_key string, kind string, source_file string, name string")
    called = testcov.calls(used, s)
    assert {r["symbol"]: (r["calls"], r["first_file"]) for r in called.collect()} == {"io::open": (3, "t.cpp"), "Box": (1, "t.cpp")}
    own = testcov.canonical(s)
    assert {r["lookup_key"] for r in own.collect()} == {"io::open", "lost", "Box"} and {r["name"] for r in testcov.untested(own, called).collect()} == {"lost"}
    assert {r["kind"]: (r["total"], r["tested"]) for r in testcov.stats(own, called).collect()} == {"function": (2, 1), "class": (1, 1), None: (3, 2)}
    assert testcov.report_lines(testcov.untested(own, called)).first()["text"] == "io.h:1:1: warning: function 'lost' has no tests" and testcov.diagnostics(testcov.untested(own, called)).first()["code"] == "T001"


def test_links(spark):
    s = spark.createDataFrame([("io::File", "class", "a/io.h", "io-file", "io::File")], "lookup_key string, kind string, source_file string, anchor string, name string")
    t = links.type_links(spark.createDataFrame([("const io::File *",), ("std::vector<int>&",), ("int",), (None,)], "type_str string"), s)
    assert {r["type_str"]: r["link"] for r in t.collect()} == {"const io::File *": "../types/io.md#io::file", "std::vector<int>&": "https://en.cppreference.com/w/cpp/vector", "int": None, None: None}
    texts = spark.createDataFrame([(1, 'See @ref io::File "the file", or @ref lost. End'), (2, "none"), (3, None)], "text_id int, text string")
    got = {r["text_id"]: r["text"] for r in links.rewrite(texts, s).collect()}
    assert got[1] == "See [the file](#io-file), or `lost`. End" and got[2] == "none"
    refs = spark.createDataFrame([("m", "io::File"), ("m", "pg"), ("n", "pg"), ("m", "a b")], "module string, target string")
    how = links.resolve(refs, s, spark.createDataFrame([("m", "pg")], "module string, id string"))
    assert {(r["module"], r["target"]): r["resolved_as"] for r in how.collect()} == {("m", "io::File"): "symbol", ("m", "pg"): "page", ("n", "pg"): "anchor", ("m", "a b"): "unresolved"}


def test_snippets(spark):
    files = spark.createDataFrame([("examples/a.cpp", "// [x]\nkept\n// [x]"), ("test/fixtures/a.cpp", "other"), ("b.py", "# [y]\nz\n# [y]"), ("inc.md", "l1\nANCHOR: p\nl2\nANCHOR_END: p\nl3")], "path string, content string")
    refs = spark.createDataFrame([(1, "a.cpp", "x", None), (2, "b.py", "y", None), (3, "lost.c", "x", None), (4, "a.cpp", "none", "c")], "ref_id int, file string, anchor string, language string")
    got = {r["ref_id"]: (r["text"], r["language"], r["status"]) for r in snippets.resolve(refs, files).collect()}
    assert got == {1: ("kept", "cpp", "ok"), 2: ("z", "python", "ok"), 3: (None, "c", "File not found"), 4: (None, "c", "Anchor not found in file")}
    texts = spark.createDataFrame([(1, "a {{#include inc.md:p}} b {{#include no.md}}"), (2, "plain")], "text_id int, text string")
    assert {r["text_id"]: r["text"] for r in snippets.expand_includes(texts, files).collect()} == {1: "a l2 b <!-- Include error: no.md -->", 2: "plain"}


def test_grouping_and_pages(parsed, spark, tmp_path):
    rows = grouping.index_ordered(grouping.index(extract.entities(parsed)))
    assert {r["name"] for r in rows.collect()} == {"open_file", "free_all", "bare", "close", "Shape", "area", "Circle", "Mode"} and rows.where("new_letter").count() == 7
    h = grouping.headings(spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)], "n int, v string"), ["v"], ["n"], [])
    assert [r["new_v"] for r in h.orderBy("n").collect()] == [True, False, True, True, False]
    files = grouping.by_module(spark.createDataFrame([("a/x.h",), ("b/y.h",), ("z.c",)], "path string"), [("one", ["x.*"]), ("two", ["b/*", "a/*"])])
    assert {r["path"]: r["assigned"] for r in files.collect()} == {"a/x.h": "one", "b/y.h": "two", "z.c": None}
    pages = render.module_pages(parsed)
    page = pages.first()
    assert page["path"] == "headers/a_x.md" and page["content"].index("## Functions") < page["content"].index("## Classes") and "int open_file(const char *name, int mode)" in page["content"] and "Shape <|-- Circle" in page["content"]
    render.write_book(pages.unionByName(render.introduction(extract.entities(parsed))), str(tmp_path))
    assert (tmp_path / "src/headers/a_x.md").read_text() == page["content"] and "- function: 4" in (tmp_path / "src/introduction.md").read_text() and (tmp_path / "book.toml").exists()
    assert render.index_page(extract.entities(parsed)).count() > 3 and render.list_pages(extract.entities(parsed)).count() == 0


def test_merge(spark):
    a = spark.createDataFrame([("f", 1, "m")], "file string, line int, message string")
    b = spark.createDataFrame([("f", 1, "m"), ("f", 2, "m")], "file string, line int, message string")
    assert grouping.merge_diagnostics(a, b).count() == 2
    assert F is not None


def test_more_reports(parsed, spark):
    own = extract.entities(parsed)
    found = lint.issues(own, None, params=extract.params(parsed), doc_params=extract.doc_params(parsed))
    assert lint.report_lines(found).where("text like 'a/x.hpp:14:1: warning: no documentation [W001]'").count() == 1
    types = {(r["name"], r["type_str"]) for r in links.param_types(extract.params(parsed), extract.doc_params(parsed)).collect()}
    assert ("mode", "int") in types and ("nme", None) in types
    missing = spark.createDataFrame([("f", "function", "f.h")], "name string, kind string, source_file string")
    assert "TCOV001" in testcov.sarif_results(missing).first()["result"]
    tests = extract.nodes(spark.createDataFrame([("t.h", "/** A function. @brief b\n * @test one file.cpp\n * @todo two\n * @param x y */\nint f(int x);")], "path string, content string"))
    assert {r["text"] for r in grouping.collected(extract.entities(tests), "tests").collect()} == {"one (file.cpp)"} and render.list_pages(extract.entities(tests)).count() == 2
