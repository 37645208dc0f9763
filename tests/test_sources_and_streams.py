import json

from marginalia.operators import extract
from marginalia.operators.nested import MODULES_KEY, VERSION_KEY
from marginalia.sources import config, files, sarif
from marginalia.streaming import documents as D


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.h", b"int a();"), ("sub/b.hpp", b"int b();"), ("sub/c.txt", b"x"), ("big.h", b"x" * 100), ("bad.h", b"\xff")):
        (tmp_path / name).write_bytes(body)
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.read_headers(spark, str(tmp_path), max_bytes=50).collect()}
    assert set(got) == {"a.h", "b.hpp", "bad.h"} and got["b.hpp"]["is_cpp"] and not got["a.h"]["is_cpp"] and got["a.h"]["content"] == "int a();"
    table = spark.createDataFrame([("inc/a.h",), ("inc/x/b.h",), ("src/c.c",)], "path string")
    match = lambda *p: {r["path"] for r in files.expand(table, list(p)).collect()}
    assert match("inc/*.h") == {"inc/a.h"} and match("inc/**/*.h") == {"inc/a.h", "inc/x/b.h"} and match("src/c.c") == {"src/c.c"} and match("**/?.c") == {"src/c.c"}


def test_config(spark, tmp_path):
    text = 'title = "Root"\n[marginalia]\ntitle = "Two"\ngrouping = "flat"\n[book]\ngrouping = "x"\nlanguage = "de"\n[lint]\nmax_brief_length = 100\n[lint.rules]\nW001 = "off"\n[[modules]]\nname = "m"\nheaders = ["a*.h"]\n'
    s = config.load_string(text)
    assert (s.title, s.grouping, s.language, s.lint.max_brief_length, s.lint.severities) == ("Root", "flat", "de", 100, {"W001": "ignore"})
    assert s.modules == [("m", ["a*.h"])] and s.modules_table(spark).count() == 1 and s.rules_table(spark).first()["severity"] == "ignore"
    assert config.load_string("broken = [") == config.Settings() and config.load_file(str(tmp_path / "none.toml")) == config.Settings()


def test_sarif(spark):
    code = '/** Opens "it".\n * @param a The a\n */\nint f(int a);\nclass K { public: int m(char *s); int x; };\nenum E { A };\n'
    parsed = extract.nodes(spark.createDataFrame([('d/"q".hpp', code)], "path string, content string"))
    body = sarif.module_documents(parsed).first()["body"]
    top = json.loads(body)
    module = top["runs"][0]["properties"][MODULES_KEY][0]
    assert module["name"] == 'd/"q".hpp' and module["functions"][0]["doc"]["params"] == [{"name": "a", "description": "The a"}] and module["classes"][0]["methods"][0]["params"] == [{"name": "s", "type": "char *"}]
    rows = spark.createDataFrame([(1, body), (2, "{"), (3, '{"runs": [{"properties": {}}]}'), (4, "[]"), (5, None), (6, body.replace('"1.0"', '"9"')), (7, '{"runs": [{"properties": {"%s": "1.0"}}]}' % VERSION_KEY)], "sarif_id long, body string")
    assert {r["sarif_id"]: r["status"] for r in sarif.statuses(rows).collect()} == {1: "ok", 2: "InvalidJson", 3: "MissingVersion", 4: "InvalidStructure", 5: "InvalidJson", 6: "UnsupportedVersion", 7: "MissingModules"}
    issues = spark.createDataFrame([("a\\b.h", 0, "f", "function", "info", "I001", 'long "brief"', None), ("b.h", 3, "g", "function", "error", "E001", "bad", None)], "file string, line int, entity_name string, entity_type string, severity string, code string, message string, suggestion string")
    out = {r["code"]: json.loads(r["result"]) for r in sarif.results(issues).collect()}
    place = out["I001"]["locations"][0]["physicalLocation"]
    assert place["artifactLocation"]["uri"] == "a/b.h" and "region" not in place and out["I001"]["level"] == "note" and out["E001"]["locations"][0]["physicalLocation"]["region"]["startLine"] == 3


def event(uri, seq, action, text=None, *span):
    return (uri, seq, action, text, *(span or (None,) * 4))


EVENTS = [
    event("u", 1, "change", "ignored"), event("u", 2, "open", "aé\nbc"), event("u", 3, "change", "X", 1, 0, 1, 1), event("v", 1, "open", ""), event("u", 4, "save"), event("u", 5, "change", "all new"), event("u", 6, "close"),
    event("u", 7, "change", "late"), event("v", 2, "change", "q", 9, 9, 9, 9), event(None, 1, "open", "x"),
]
WANT = {("u", 2, "aé\nbc"), ("u", 3, "aé\nXc"), ("v", 1, ""), ("u", 4, "aé\nXc"), ("u", 5, "all new"), ("u", 6, None), ("v", 2, "q")}


def test_states(spark, tmp_path):
    table = spark.createDataFrame(EVENTS, D.EVENTS)
    assert {(r["uri"], r["seq"], r["text"]) for r in D.states_batch(table).collect()} == WANT
    for n, part in enumerate((table.where("seq <= 3"), table.where("seq > 3"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = D.states(spark.readStream.schema(D.EVENTS).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r["uri"], r["seq"], r["text"]) for r in spark.read.schema(D.STATES).parquet(str(tmp_path / "out")).collect()} == WANT


def test_diagnostics_stream(spark, tmp_path):
    code = "/** Adds. @see lost */\nint add(int a);\nint bare();\n"
    spark.createDataFrame([event("f.h", 1, "open", code), event("g.h", 1, "open", "int x;"), event("g.h", 2, "close")], D.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    D.run(spark.readStream.schema(D.EVENTS).parquet(str(tmp_path / "in")), str(tmp_path / "cp"), lambda df, n: seen.extend(df.collect())).awaitTermination()
    by = {(r["uri"], r["code"], r["line"]) for r in seen}
    assert ("f.h", "W001", 2) in by and ("g.h", None, None) in by
    frames = D.publish_frames(spark.createDataFrame(seen)).collect()
    assert all(next(D.frames(r["frame"].encode()))["method"] == "textDocument/publishDiagnostics" for r in frames)


def test_places_and_frames(spark):
    text = "/** a\n * b\n */\nint f(); // c\n/// d\n"
    assert [D.in_doc_comment(text, *p) for p in ((1, 2), (3, 2), (3, 12), (4, 4), (2, 3))] == [True, False, False, True, False]
    assert "@param" in D.completions(text, 1, 2) and D.completions(text, 3, 0) == () and len(D.COMPLETIONS) == 37
    messages = [{"method": "textDocument/didOpen", "params": {"textDocument": {"uri": "u", "text": "é"}}}, {"method": "textDocument/didChange", "params": {"textDocument": {"uri": "u"}, "contentChanges": [{"text": "z", "range": {"start": {"line": 0, "character": 0}, "end": {"line": 0, "character": 2}}}]}}]
    raw = b"".join(D.frame(m) for m in messages) + b"Content-Length: 3\r\n\r\n{x}"
    assert list(D.frames(raw)) == messages
    events = D.read_sessions(spark.createDataFrame([(bytearray(raw),)], "content binary"))
    assert D.latest(D.states_batch(events)).first()["text"] == "z"


def test_code_actions(spark):
    code = "int bare(int x);\n/** Adds.\n * @param nme b\n */\nint add(int name);\n"
    from marginalia.operators import lint

    p = extract.nodes(spark.createDataFrame([("f.h", code)], "path string, content string"))
    own = extract.entities(p)
    issues = lint.issues(own, None, params=extract.params(p), doc_params=extract.doc_params(p))
    acts = {(r["code"], r["title"]): r["new_text"] for r in D.code_actions(issues, own, extract.params(p)).collect()}
    assert acts["W001", "Add documentation"] == "/**\n * @brief \n * @param x \n * @return \n */\n" and acts["E001", "Rename to name"] == "name" and ("W003", "Add @param name") in acts and ("W005", "Add @return") in acts


def test_configuration_keys():
    from marginalia.sources import config

    c = config.load_string('output = "out"\nlang = "de"\ninput = ["a.h"]\ngenerate_intro = false\n[watch]\ndebounce_ms = 5\nother = 1\n[limits]\nmax_file_size = 7\nmax_include_size = "x"\n[[modules]]\nname = "m"\npatterns = ["*.h"]\n[lint]\nexclude_patterns = ["t*"]\n')
    assert (c.output_dir, c.language, c.inputs, c.generate_intro) == ("out", "de", ["a.h"], False)
    assert c.watch["debounce_ms"] == 5 and "other" not in c.watch and c.limits["max_file_size"] == 7 and c.limits["max_include_size"] == 1 << 20
    assert c.modules == [("m", ["*.h"])] and c.lint.exclude == ["t*"] and config.load_string("=").watch == config.WATCH


def test_edits_in_a_table_and_hints(spark):
    from marginalia.streaming import documents

    rows = [("u", 1, "open", "ab\ncd", None, None, None, None), ("u", 2, "change", "X", 1, 0, 1, 1), ("u", 3, "save", None, None, None, None, None), ("u", 4, "close", None, None, None, None, None), ("u", 5, "change", "no", None, None, None, None),
            ("w", 1, "change", "no", None, None, None, None), ("w", 2, "open", None, None, None, None, None), ("w", 3, "change", "t", None, None, None, None), ("w", 4, "save", "s", None, None, None, None), ("w", 5, "save", None, None, None, None, None), (None, 1, "open", "x", None, None, None, None)]
    got = {(r["uri"], r["seq"]): r["text"] for r in documents.states_batch(spark.createDataFrame(rows, documents.EVENTS)).collect()}
    assert got == {("u", 1): "ab\ncd", ("u", 2): "ab\nXd", ("u", 3): "ab\nXd", ("u", 4): None, ("w", 2): "", ("w", 3): "t", ("w", 4): "s", ("w", 5): "s"}
    texts = spark.createDataFrame([("a.h", "int used(int x);\nint lost(int y);\n")], "uri string, text string")
    tests = spark.createDataFrame([("t.cpp", "TEST(a) { used(1); }")], "path string, content string")
    found = documents.diagnose(texts, tests)
    assert [(r["line"], r["message"]) for r in found.where("code = 'T001'").collect()] == [(1, "No tests for 'lost'")] and documents.at_line(found, 0).count() > 0


def test_pages_show_members_groups_and_derived_classes(spark):
    from pyspark.sql.functions import col as F_col

    from marginalia.operators import extract, render, snippets

    code = """/** @brief One. @group g All of them */
int one(int a);
/**
 * @brief Two.
 * @group g All of them
 * @param b The b
 */
int two(const char *b);
/** @brief Base. */
class Base { public: int size; private: int hidden; };
/** @brief Below. */
class Below : public Base {};
"""
    code = code.replace("/** @brief One. @group g All of them */", "/**\n * @brief One.\n * @group g All of them\n */")
    parsed = extract.nodes(spark.createDataFrame([("d/x.hpp", code)], "path string, content string"))
    page = render.module_pages(parsed).first()["content"]
    assert "### All of them" in page and "int one(int a)\nint two(const char *b)\n" in page and "### one" not in page and "- `int size`" in page and "hidden" not in page.replace("{#", "") and page.count("Base <|-- Below") == 2
    assert render.readme(parsed).first()["content"].endswith("- d: 4 declarations in 1 files\n") and "function [`one`]" in render.module_summary(parsed).first()["content"]
    files = spark.createDataFrame([("s.txt", "/// told\n"), ("big.txt", "x" * 50)], "path string, content string")
    own = spark.createDataFrame([("a.h", "{{#include s.txt}}int f();", 1), ("b.h", "int g();", 2), ("c.h", "// {{#include big.txt}}", 3), ("n.h", None, 4)], "path string, content string, ord int")
    got = {r["path"]: r["content"] for r in snippets.expand_sources(own, files).collect()}
    assert got["a.h"] == "/// told\nint f();" and got["b.h"] == "int g();" and got["c.h"] == "// " + "x" * 50 and got["n.h"] is None
    short = snippets.expand_includes(own.select(F_col("path").alias("text_id"), F_col("content").alias("text")), files, 20)
    assert "Include error: big.txt" in {r["text_id"]: r["text"] for r in short.collect()}["c.h"]
