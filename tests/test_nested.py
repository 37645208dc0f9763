import json

from marginalia.operators import nested


def brute(sarif_id, body):
    """The rows of one body by plain recursion."""
    out = set()

    def takes(f, path):
        for kind, ps in (("param", f.get("params")), ("doc_param", f["doc"].get("params") if isinstance(f.get("doc"), dict) else None)):
            for i, p in enumerate(ps if isinstance(ps, list) else []):
                if isinstance(p, dict):
                    out.add((sarif_id, path, kind, i, p["name"] if isinstance(p.get("name"), str) else ""))

    def classes(cs, path):
        for i, c in enumerate(cs if isinstance(cs, list) else []):
            if isinstance(c, dict):
                for j, m in enumerate(c.get("methods") if isinstance(c.get("methods"), list) else []):
                    if isinstance(m, dict):
                        takes(m, f"{path}/{i}/methods/{j}")
                classes(c.get("nestedClasses"), f"{path}/{i}/nestedClasses")

    for n, m in enumerate(nested.modules_of(body)):
        if isinstance(m, dict):
            for j, f in enumerate(m.get("functions") if isinstance(m.get("functions"), list) else []):
                if isinstance(f, dict):
                    takes(f, f"{n}/functions/{j}")
            classes(m.get("classes"), f"{n}/classes")
    return out


def body(modules, version="1.0"):
    return json.dumps({"runs": [{"properties": {nested.VERSION_KEY: version, nested.MODULES_KEY: modules}}]})


def found(spark, rows):
    df = spark.createDataFrame(rows, "sarif_id bigint, body string, name string")
    got = [tuple(r) for r in nested.params(nested.flatten(df)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_shapes_and_places(spark):
    p = {"name": "a"}
    deep = {"methods": [{"params": [p]}]}
    for _ in range(60):
        deep = {"nestedClasses": [7, deep], "methods": None}
    rows = [
        (1, body([{"functions": [{"params": [p, 3, {"name": 5}, {}]}, "no", {"params": {"name": "x"}, "doc": {"params": [p, None, p]}}]}, "odd", {"classes": [deep]}]), "x"),
        (1, body([{"functions": [{"params": [p]}]}]), "x"),
        (2, None, None),
        (3, "", "x"),
        (4, '{"runs": [', "x"),
        (5, body([{"functions": [{"params": [p]}]}], "2.0"), "x"),
        (6, body({"functions": []}), "x"),
        (7, body([{"functions": [{"params": [p]}]}]).replace('"a"', "NaN"), "x"),
        (8, "[" * 100000, "x"),
        (9, body([{"functions": [{"params": [{"name": "\ud800"}, {"name": "long " * 5000}]}]}]), "x"),
    ]
    want = set().union(*(brute(i, b) for i, b, _ in rows))
    want = {(*r[:4], "�" if r[4] == "\ud800" else r[4]) for r in want}
    assert found(spark, rows) == want
    assert any(r[1].count("nestedClasses") == 60 for r in want)


def test_empty_table(spark):
    assert found(spark, []) == set()


def test_equal_objects_are_stored_once(spark):
    b = body([{"functions": [{"name": "f", "params": [{"name": "a"}] * 5}]}] * 4)
    flat = nested.flatten(spark.createDataFrame([(1, b), (2, b)], "sarif_id bigint, body string"))
    assert {r["kind"]: 1 for r in flat.objects.collect()} == {"module": 1, "function": 1, "param": 1}
    assert flat.objects.count() == 3
    assert flat.occurrences.count() == 2 * (4 + 4 + 20)


def test_test_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/sarif_documents.parquet")
    want = set().union(*(brute(r["sarif_id"], r["body"]) for r in df.collect()))
    assert {tuple(r) for r in nested.params(nested.flatten(df)).collect()} == want


def test_any_depth_and_any_number(spark):
    f = '{"name": "f", "odd": %s, "params": [{"name": "a", "default": %s}]}'
    deep, long = "[" * 100000 + "]" * 100000, "9" * 10000
    classes = '{"nestedClasses": [' * 3000 + '{"methods": [{"params": [{"name": "m"}]}]}' + "]}" * 3000
    whole = lambda modules: body(["@"]).replace('"@"', modules)
    rows = [(1, whole('{"functions": [%s]}' % (f % (deep, "1"))), ""), (2, whole('{"functions": [%s]}' % (f % ("1.50", long))), ""), (3, whole('{"classes": [%s]}' % classes), ""), (4, whole("[" * 100000), "")]
    got = found(spark, rows)
    assert {r for r in got if r[0] < 3} == {(1, "0/functions/0", "param", 0, "a"), (2, "0/functions/0", "param", 0, "a")}
    assert [(r[1].count("nestedClasses"), r[4]) for r in got if r[0] == 3] == [(3000, "m")] and len(got) == 3
    from marginalia.sources.sarif import status_of

    assert [status_of(r[1])[0] for r in rows] == ["ok", "ok", "ok", "InvalidJson"]


def test_json_reader():
    from marginalia.functions import jsontext

    for bad in ("", "{", "[1,]", '{"a":1,}', "[1 2]", '{"a" 1}', "{1:2}", "nul", "01", "[1]x", '"a\nb"', "NaN", "[-Infinity]", '{"a":}', "]", "{]", "[}", "-", "1.", "[,1]"):
        for read in (jsontext.load, jsontext.scan):
            try:
                read(bad)
            except jsontext.NotJson:
                continue
            raise AssertionError(bad)
    text = '{"b": [1, {"x": null}, true], "a": "\\ud83d\\ude80 \\n", "a": "last"}'
    assert jsontext.scan(text) == jsontext.load(text) == json.loads(text)
    assert jsontext.canonical(jsontext.load('{"b": 1.50, "a": 1e400}')) == '{"a":1e400,"b":1.50}'


def test_identities_differ_where_content_does(spark):
    shapes = ['"zzz"', "5", "[]", "[3]", '[{"name": "a"}, 3]', '[3, {"name": "a"}]', '{"name": "a"}', "null", "[1.5]", '["1.5"]']
    functions = ", ".join('{"params": %s}' % s for s in shapes) + ', {}, {"doc": {}}, {"doc": []}, {"doc": {"params": [1]}}, {"templateParams": []}'
    flat = nested.flatten(spark.createDataFrame([(1, body(["@"]).replace('"@"', '{"functions": [%s]}' % functions))], "sarif_id bigint, body string"))
    assert flat.objects.where("kind = 'function'").count() == len(shapes) + 5


def test_nothing_is_lost(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/sarif_documents.parquet").dropDuplicates(["sarif_id"])
    flat = nested.flatten(df)
    objects = {r["object_id"]: (r["kind"], json.loads(r["attributes"])) for r in flat.objects.collect()}
    below, tops = {}, {}
    for r in flat.occurrences.select("sarif_id", "child_kind", "pos", "parent_id", "object_id").distinct().collect():
        if r["parent_id"] is None:
            tops.setdefault(r["sarif_id"], {})[r["pos"]] = r["object_id"]
        else:
            below.setdefault(r["parent_id"], set()).add((r["child_kind"], r["pos"], r["object_id"]))
    seen = 0
    for r in df.collect():
        for n, module in enumerate(nested.modules_of(r["body"])):
            if isinstance(module, dict):
                assert nested.rebuild(objects, below, tops[r["sarif_id"]][n]) == module
                seen += 1
    assert seen > 20
