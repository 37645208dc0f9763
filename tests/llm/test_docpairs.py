from marginalia.llm import docpairs

CODE = r'''
/** Adds two numbers and returns their sum. */
int add(int a, int b);

/* Adds two numbers and returns their sum. */
int plain(int a);

/*** Adds two numbers and returns their sum. */
int stars(int a);

//// Adds two numbers and returns their sum.
int slashes(int a);

/// Opens the given file
/// for reading only.
template <typename T>
[[nodiscard]] T
open_file(const char *name, T mode = f(1, "a)b"))
{
    /** Not a declaration of anything at all here. */
    int inner(int x);
    return mode;
}

/** Far away from what follows, really far. */

void gap(void);

void behind(int a,
            int b); ///< Stands behind the declaration it explains.

/** Open the file. */
void open_the_file();

/** @brief Todo: function this
 * @param x a long text that explains the parameter x
 */
void only_tags(int x);

/*! \brief Callback that is stored elsewhere. */
typedef int (*callback_t)(int, void *);
/** A variable with a long explanation here. */
static int counter = compute(3);
/** A macro with a long explanation here. */
#define TWICE(x) ((x) + (x))

namespace a::b { namespace {
/** A box that holds any number of things. */
class Box : public Base<int> {
public:
    /** Builds a box with room for things. */
    explicit Box(int n) : n_{n}, m_(std::vector<int>{1, 2}) { run(); }
    /** Frees everything that the box still holds. */
    virtual ~Box() noexcept;
    /** Compares the contents of both boxes in order. */
    friend bool operator==(const Box &l, const Box &r) = default;
    /** Calls the stored thing with given arguments. */
    int operator()(int x) const;
    /** Tells whether anything is left inside it. */
    explicit operator bool() const { return n_; }
    //! 返回当前的数量。
    int size() const;
    struct Inner {
        /** Deeply nested but still a method here. */
        auto run(int (*f)(int), const char *s = "};") -> int;
    };
private:
    int n_; ///< Number of things that are held inside.
    int late();
};
}}
/** Out of class but it belongs there anyway. */
a::b::Box::Box(int n) { if (n) { late(); } }
extern "C" {
/// Comes from the other language, unchanged otherwise.
void legacy(void);
}
'''


def names(code):
    return [(r[2], r[1]) for r in docpairs.pairs_of("p", code)]


def line(text, code=CODE):
    return next(n for n, x in enumerate(code.split("\n"), 1) if text in x)


WANT = {
    ("add", line("int add(")), ("open_file", line("open_file(")), ("behind", line("void behind(")), ("Box", line("explicit Box(")), ("~Box", line("~Box()")), ("operator==", line("operator==")), ("operator()", line("operator()(")),
    ("operator bool", line("operator bool")), ("size", line("int size()")), ("run", line("auto run(")), ("Box", line("a::b::Box::Box")), ("legacy", line("void legacy")),
}


def test_which_functions_count():
    got = names(CODE)
    assert len(got) == len(set(got)) and set(got) == WANT
    assert set(names(CODE.replace("\n", "\r\n"))) == WANT


def test_ranges_and_texts():
    by = {(r[2], r[1]): r for r in docpairs.pairs_of("p", CODE)}
    add = by["add", line("int add(")]
    assert add[9] == "int add(int a, int b);" and add[10] == "Adds two numbers and returns their sum." and add[11] is None
    opened = by["open_file", line("open_file(")]
    assert opened[9].startswith("template <typename T>") and opened[9].endswith("}") and opened[10] == "Opens the given file\nfor reading only."
    assert by["run", line("auto run(")][3] == "a::b::anonymous::Box::Inner::run"


def test_trivial_words():
    assert docpairs.telling_words("Open the XML file for reading twice", "openXMLFile") == 2
    assert docpairs.telling_words("设置窗口", "set") == 4
    assert docpairs.description("Brief.\n\nMore text\n@param x y\nlost") == ("Brief.", "More text")
    assert docpairs.description("@brief Short one\n@details Long one\n@return no") == ("Short one", "Long one")


def test_broken_text_never_raises():
    for cut in range(0, len(CODE), 7):
        docpairs.pairs_of("p", CODE[cut:])
        docpairs.pairs_of("p", CODE[:cut])
    docpairs.pairs_of("p", "{" * 5000 + "}" * 10)
    docpairs.pairs_of("p", "class A {" * 3000)
    assert names("/** One two three four five. */\n" + "int f(" * 2000) == []


def test_rows(spark):
    df = spark.createDataFrame([("p", CODE, "x"), ("p", CODE, "x"), ("q", None, "x"), ("r", "", "x"), ("s", "int x; " * 20000, "x")], "path string, content string, name string")
    assert {(r["path"], r["name"], r["line"]) for r in docpairs.pairs(df).collect()} == {("p", *w) for w in WANT}
    assert docpairs.pairs(df).count() == len(WANT)
    assert docpairs.pairs(df.limit(0)).count() == 0


def test_agrees_with_the_parsed_declarations(spark):
    from marginalia.functions import cdecl

    base = "/root/testdata/sf0.01"
    files = {r["path"]: r["content"] for r in spark.read.parquet(f"{base}/sources.parquet").collect()}
    ents = spark.read.parquet(f"{base}/entities.parquet").select("module", "kind", "line", "name").distinct().collect()
    for kind in ("function", "method", "class", "struct", "enum", "typedef"):
        want = {(r["module"], r["line"], r["name"]) for r in ents if r["kind"] == kind and r["module"] in files}
        got = {(m, n.line, n.name) for m in {r["module"] for r in ents} & set(files) for n in cdecl.parse(files[m]) if n.kind == kind}
        assert got == want
