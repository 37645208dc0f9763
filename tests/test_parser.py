from marginalia.functions import cdecl, clex, doccomment


def by(code, kind, cpp=True):
    return [n for n in cdecl.parse(code, cpp) if n.kind == kind]


def test_tokens():
    t = clex.tokens('#define A(x) \\\n  x\nint a = 1\'000; // c \\\nd\nR"x(a)")x" "b\\"c" \'\\\'\' /* e */ a->b ::c ...')
    assert [x.kind for x in t] == ["pp", "id", "id", "p", "num", "p", "lc", "raw", "str", "chr", "bc", "id", "p", "id", "p", "id", "p"]
    assert clex.string_value(clex.Token("str", r'"a\n\x41é\101\
b\q"', 0)) == "a\nAéAbq"
    assert [clex.doc_kind(c) for c in ("/** a */", "/*! a */", "/*** a */", "/**/", "/* a */", "/// a", "//! a", "//// a", "// a", "///< a", "/**< a */")] == ["block", "block", None, None, None, "line", "line", None, None, "trailing", "trailing"]
    assert clex.comment_text("/**\n * A\n *  b\n */") == "\nA\n b\n"


def test_functions_and_parameters():
    f = by("static inline unsigned long *get(const char *name, int (*cb)(int), T<a, b> v = T<a, b>{1}, int x[3], ...) noexcept;", "function")[0]
    assert f.return_type == "unsigned long *" and [(p.name, p.type) for p in f.params[:4]] == [("name", "const char *"), ("cb", "int(*)(int)"), ("v", "T<a, b>"), ("x", "int[3]")]
    assert f.flags >= {"is_static", "is_inline", "is_noexcept", "is_variadic"}
    assert by("int f(void);", "function")[0].params == []
    assert by("int a(3), b; Foo x(\"s\"); int (*fp)(int); typedef int (*t)(int); using u = int(int); MACRO(a) return f(x);", "function") == []
    assert [n.name for n in by("int operator+(A a, A b); bool operator()(int); operator bool(); A& operator[](int); void* operator new(size_t); int operator\"\"_x(char);", "function")] == ["operator+", "operator()", "operator bool", "operator[]", "operator new", 'operator""_x']


def test_classes():
    code = """
namespace n { inline namespace m {
template <typename T, int N = 3> class [[nodiscard]] Box final : public A<T>, private virtual b::B {
  int hidden(); int x, y;
 public: Box(); Box(const Box& o); Box(Box&& o); virtual ~Box() = default; virtual void go() const = 0;
  struct In { int f(); } in;
  enum class E : char { A = 1, B };
};
union U { int a; float b; }; typedef struct { int q; } Named; struct Fwd; concept C = true;
}}"""
    box = by(code, "class")[0]
    assert box.qualified == "n::m::Box" and box.bases == [("A<T>", "public", False), ("b::B", "private", True)] and [(p.name, p.type, p.default) for p in box.tparams] == [("T", "typename", None), ("N", "int", "3")]
    methods = {m.qualified.removeprefix("n::m::Box::"): m for m in by(code, "method")}
    assert set(methods) == {"hidden", "Box", "~Box", "go", "In::f"}
    assert methods["hidden"].access == "private" and methods["go"].flags >= {"is_pure_virtual", "is_const", "is_virtual"} and methods["~Box"].flags >= {"is_default"}
    assert by(code, "enum")[0].values == [("A", "1"), ("B", None)] and by(code, "enum")[0].return_type == "char"
    assert [n.name for n in by(code, "struct")] == ["In", "Named"] and by(code, "union")[0].name == "U"


def test_other_declarations():
    code = '#include <a/b.h>\n#  include "c.h"\n#define F(a, b) ((a) + \\\n (b))\n#define V 3\ntypedef unsigned long size;\nusing X = std::vector<int>;\nextern int g;\nnamespace q = a::b;\n'
    kinds = {(n.kind, n.name) for n in cdecl.parse(code)}
    assert kinds == {("include", "a/b.h"), ("include", "c.h"), ("macro", "F"), ("macro", "V"), ("typedef", "size"), ("type_alias", "X"), ("variable", "g")}
    f = next(n for n in cdecl.parse(code) if n.name == "F")
    assert [p.name for p in f.params] == ["a", "b"] and "is_function_like" in f.flags


def test_doc_record():
    text = """Brief line here.

More details
 of it, see @ref other "shown" and user@@host.
@param name The name
  goes on here
@param empty
@param[in] odd none
@tparam T type
@return what \\ref back(int, char) is
@retval 0 fine
@throw E when bad
@throws F never
@deprecated
@note one
@note two
@see a::b
@code{.cpp, lineno}
int x;
@endcode
@test t file.cpp
@snippet f.cpp part py
@date 2024 (made)
@group io Input
@exclude return
@todo later
@since 1.2
@since 1.3
"""
    d = doccomment.parse(text)
    assert d["brief"] == "Brief line here." and d["details"] == 'More details\nof it, see @ref other "shown" and user@host.'
    assert d["params"] == [{"name": "name", "description": "The name goes on here"}, {"name": "empty", "description": ""}] and d["tparams"] == [{"name": "T", "description": "type"}]
    assert d["returns"] == "what \\ref back(int, char) is" and d["retvals"] == [{"value": "0", "description": "fine"}] and [e["type"] for e in d["exceptions"]] == ["E"]
    assert d["deprecated"] == "This is deprecated." and d["notes"] == ["one", "two"] and d["see_also"] == ["a::b"] and d["since"] == "1.3" and d["exclude"] == "return_type"
    assert d["code_blocks"] == [{"code": "int x;", "language": "cpp", "lineno": "true"}] and d["tests"] == [{"name": "t", "file": "file.cpp"}] and d["snippets"][0]["language"] == "py"
    assert d["dates"] == [{"date": "2024", "description": "made"}] and d["group_name"] == "io" and d["group_heading"] == "Input" and d["todos"] == ["later"]
    assert [(r["target"], r["display_text"]) for r in d["refs"]] == [("other", "shown"), ("back(int, char)", None)]
    plain = doccomment.parse("Only text @note nothing parsed")
    assert plain["format"] == "unknown" and plain["notes"] == [] and plain["brief"].startswith("Only")
    assert doccomment.parse("## Head\ntext")["format"] == "markdown" and doccomment.parse(None) is None and doccomment.parse("")["brief"] is None


def test_pages_and_groups():
    assert doccomment.parse_page("@page intro The Intro\ntext") == {"id": "intro", "title": "The Intro", "content": "text", "is_mainpage": False}
    assert doccomment.parse_page("@mainpage Hello\nx")["is_mainpage"] and doccomment.parse_page("@page only")["title"] == "only"
    assert doccomment.parse_group("@defgroup io Input\nReads things.") == {"id": "io", "name": "Input", "brief": "Reads things."}
    assert doccomment.parse_group("@addtogroup io")["id"] == "io" and doccomment.parse_group("x") is None


def test_constraints_and_friends():
    code = "template <typename T> requires Sized<T> && (sizeof(T) > 2) T* get(T t);\ntemplate <class T> void put(T t) requires requires(T x) { x.a(); } { body(); }\nclass A { friend class B; friend int f(A a); };\nconcept C = true;"
    f = {n.name: n for n in by(code, "function")}
    assert f["get"].requires == "Sized<T> && (sizeof(T) > 2)" and f["get"].return_type == "T *" and f["put"].requires.startswith("requires(T x) {") and "has_body" in f["put"].flags
    assert [n.name for n in by(code, "friend")] == ["B"] and [n.name for n in by(code, "method")] == ["f"]
