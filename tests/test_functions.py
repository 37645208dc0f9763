from pyspark.sql import functions as F

from marginalia.functions import exprs as X


def one(spark, *columns, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return tuple(row.select(*columns).first())


def test_strings(spark):
    c = F.col
    assert one(spark, X.anchor(c("a")), X.index_anchor(c("a")), X.short_name(c("a")), a="Foo_Bar x::Y_z") == ("foo-bar-x::y-z", "foo_bar x::y_z", "Y_z")
    assert one(spark, X.html_escape(c("a")), X.percent_encode(c("a")), a="<a & b>~*é") == ("&lt;a &amp; b&gt;~*é", "%3Ca%20%26%20b%3E~%2A%C3%A9")
    assert one(spark, X.header_title(c("a")), X.stem(c("a")), X.language(c("a")), X.is_header(c("a")), X.is_cpp(c("a")), a="x/y.z.hpp") == ("y.z", "y.z", "cpp", True, True)
    assert one(spark, X.is_cpp(c("a")), X.language(c("a")), a="b.h") == (False, "c")
    assert one(spark, X.relative_link(c("a"), c("b")), X.relative_link(c("a"), c("c")), a="d/x.h", b="e/x.h", c="y.h") == ("", "x.md")
    assert one(spark, X.class_simple_name(c("a")), X.base_type(c("b")), a="n::Box<std::vector<int>>", b="const struct n::P *") == ("Box", "n::P")
    assert one(spark, X.prefix_group(c("a")), X.prefix_group(c("b")), X.prefix_group(c("c")), a="io_read", b="x_read", c="read") == ("io", "misc", "misc")
    assert one(spark, X.truncate_brief(c("a"), 5), X.truncate_brief(c("b"), 5), X.truncate_brief(c("c"), 5), a="12345", b="123456", c="1234é") == ("12345", "12345...", "1234...")
    assert one(spark, X.signature(F.lit("f"), F.array(c("a"), c("a"))), X.signature(F.lit("f"), F.array().cast("array<string>")), a="int") == ("f(int, int)", "f")
    assert one(spark, *[X.enum_value(F.lit(v)) for v in ("0x1F", "-3", "0b101", "0o17", "1'000", "x", " 7 ")], a="") == (31, -3, 5, 15, 1000, None, 7)
    assert one(spark, X.explorer_url(c("a")), a="int x;")[0].startswith("https://godbolt.org/#g132:-O2%20-std%3Dc%2B%2B20:int%20x%3B")


def test_predicates(spark):
    c = F.col
    got = one(spark, *[X.namespace_hidden(F.lit(n), ["detail"]) for n in ("a::detail::b", "detail", "mydetail::detail::x", "detailed::x", "detail::x", "a::detail")], a="")
    assert got == (True, True, False, False, True, True)
    assert one(spark, X.glob(c("a"), "f*_?x"), X.glob(c("a"), "[f]*"), X.glob(c("a"), "*"), a="foo/b_\nx") == (True, False, True)
    assert one(spark, *[X.is_void(F.lit(v)) for v in ("void", " void\t", "", "void*")], a="") == (True, True, True, False)
    assert one(spark, *[X.is_anchor_id(F.lit(v)) for v in ("a-b_1", "a b", "")], a="") == (True, False, False)
    assert one(spark, X.levenshtein(F.lit("test"), F.lit("tset")), X.levenshtein(F.lit(""), F.lit("abc")), X.levenshtein(F.lit("a" * 21), F.lit("a")), X.levenshtein(F.lit("a" * 20), F.lit("a" * 19)), a="") == (2, 3, 100, 1)


def test_offsets_and_excerpts(spark):
    text = "aé\nbc\n"
    assert one(spark, X.text_offset(F.col("t"), F.lit(1), F.lit(1)), X.text_offset(F.col("t"), F.lit(9), F.lit(0)), X.splice(F.col("t"), F.lit(4), F.lit(5), F.lit("XY")), t=text) == (5, 7, "aé\nXYc\n")
    body = "x\n# [part]\nkept\n# [part]\ny\n// [other]\nz\n// [other]"
    s = lambda p, n: X.snippet(F.lit(p), F.col("t"), F.lit(n))
    assert one(spark, s("a.py", "part"), s("a.py", "other"), s("a.cpp", "part"), s("a.py", "none"), t=body) == ("kept", "z", None, None)
    assert one(spark, *[X.snippet_marker(F.lit(p), F.lit("a")) for p in ("x.css", "x.html", "x.sql", "Makefile", "x.zig")], t="") == ("/* [a] */", "<!-- [a] -->", "-- [a]", "# [a]", "// [a]")
