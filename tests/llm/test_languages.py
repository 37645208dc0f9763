import numpy as np
import pytest

from marginalia.llm import codelang, labels
from marginalia.llm.langtext import is_code, labelled_sample, paragraphs, prose

BASE = "/root/testdata/sf0.01"
HELD = {  # sentences of our own, of no test table
    "en": "The reader should remember that this small program has never been tested with such a large number of old files.",
    "de": "Der Leser sollte bedenken, dass dieses kleine Programm noch nie mit einer so großen Zahl von alten Dateien geprüft wurde.",
    "fr": "Le lecteur doit se rappeler que ce petit programme n'a jamais été essayé avec un si grand nombre de vieux fichiers.",
    "es": "El lector debe recordar que este pequeño programa nunca se ha probado con un número tan grande de archivos antiguos.",
    "pt": "O leitor deve lembrar que este pequeno programa nunca foi testado com um número tão grande de arquivos antigos.",
    "it": "Il lettore deve ricordare che questo piccolo programma non è mai stato provato con un numero così grande di vecchi file.",
    "nl": "De lezer moet bedenken dat dit kleine programma nog nooit is getest met een zo groot aantal oude bestanden.",
    "pl": "Czytelnik powinien pamiętać, że ten mały program nie był jeszcze sprawdzany na tak dużej liczbie starych plików.",
    "ru": "Читатель должен помнить, что эта маленькая программа ещё никогда не проверялась на таком большом числе старых файлов.",
    "zh": "读者应当记住，这个小程序还没有用这么多的旧文件测试过，请小心使用。",
    "ja": "読者は、この小さなプログラムがこれほど多くの古いファイルで試されたことがないことを覚えておくべきです。",
}


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{BASE}/documents.parquet"), spark.read.parquet(f"{BASE}/lang_aliases.parquet")


@pytest.fixture(scope="module")
def regression(tables):
    return labels.train(*tables)


@pytest.fixture(scope="module")
def bayes(tables):
    return codelang.train(*tables)


def test_paragraphs():
    assert paragraphs("\r\n a\r\nb \r\n\t\r\n\xa0\n c\n\n\n") == [" a\r\nb \r", " c"]
    assert paragraphs(None) == paragraphs("") == paragraphs(" \r\n\t") == []


def test_code_is_no_prose():
    for code in ("void f(const char *x);", "if (a->b > 0) return c;", "```cpp\nint f(int x);\n```", "@code{.cpp}\nf(7);\n@endcode", "0x12ab 0x34cd", "---", "1.2.3", "#include <a b c d>", "return old value here;"):
        assert prose(code)[1] < 4 and prose(code)[2] == 0, code
    assert not is_code("Set run_it to 5 to make sure that it works; then go on.")
    assert prose("Call openFile() or a::b with my_name 12 times, can't fail.")[0] == "Call or with times, can't fail.".replace(",", "").replace(".", "")


def test_held_out_sentences(regression, bayes):
    best, sure = regression.predict(list(HELD.values()))
    right = [regression.langs[b] == lang for b, lang in zip(best, HELD)]
    assert sum(right) >= 9 and (sure > 1 / 11).all() and (sure <= 1).all()
    found = [codelang.passages(bayes, f"// {t}\n") for t in HELD.values()]
    assert sum([p[2] for p in f] == [lang] for f, lang in zip(found, HELD)) >= 9


def test_held_out_labels(tables):
    sample = labelled_sample(*tables, docs=60)
    train = {k: v[::2] for k, v in sample.items()}
    model = labels.fit(train, labels.inverse_frequencies(labels.naturals(tables[0])))
    texts = [(k, prose(p)[0]) for k, v in sample.items() for t in v[1::2] for p in paragraphs(t) if prose(p)[1] >= 4 or prose(p)[2] >= 6]
    best, _ = model.predict([t for _, t in texts])
    assert np.mean([model.langs[b] == k for b, (k, _) in zip(best, texts)]) > 0.75  # labels themselves are wrong in part
    scripts = [("ru", "Ѐ", "ӿ"), ("ja", "ぁ", "ヿ")]
    for lang, low, high in scripts:
        own = [model.langs[b] for b, (_, t) in zip(best, texts) if np.mean([low <= c <= high for c in t]) > 0.4]
        assert own and all(x == lang for x in own)


def test_segments(spark, regression, tables):
    schema = "doc_id bigint, text string, lang string, named string"
    two = HELD["en"] + "\n \r\nint f(int x);\r\n\r\n" + HELD["ru"]
    rows = [(1, two, "en", "x"), (2, two, "Deutsch", "x"), (3, None, "en", "x"), (4, "", None, "x"), (5, " \n\n", "en", "x"), (6, HELD["ru"] * 3000, "", "x"), (1, two, "en", "x"), (7, "```\ncode\n```", "ru", "x")]
    seg = labels.segments(spark.createDataFrame(rows, schema), tables[1], regression)
    assert {tuple(r) for r in labels.wrong(seg).collect()} == {(1, 2, "ru"), (2, 0, "en"), (2, 2, "ru"), (6, 0, "ru")}
    docs = {r["doc_id"]: r for r in labels.documents_languages(seg).collect()}
    assert docs[1]["mixed"] and not docs[6]["mixed"]
    assert labels.segments(spark.createDataFrame([], schema), tables[1], regression).collect() == []
    assert labels.segments(spark.createDataFrame([], schema), tables[1]).collect() == []


def test_frequencies_cover_all_documents(spark):
    texts = ["the quick brown fox jumps", "the quick brown dog\n\nno one here to see", None, ""]
    idf = labels.inverse_frequencies(labels.naturals(spark.createDataFrame([(n, t, None) for n, t in enumerate(texts)], "doc_id long, text string, lang string")))
    want = np.zeros(1 << labels.BITS, int)
    segs = ["the quick brown fox jumps", "the quick brown dog", "no one here to see"]
    for s in segs:
        want[np.unique(np.concatenate([b for _, b in labels.ngrams([s])]))] += 1
    assert np.allclose(idf, np.log(4 / (1 + want)) + 1, atol=1e-5)


def test_summing_occurrences_is_the_sparse_product(regression):
    texts = [*HELD.values(), "", "x"]
    ptr, col, val = labels.tfidf(texts, regression.idf)
    assert np.allclose(labels._dot(ptr, col, val, regression.weights), regression.logits(texts), atol=1e-3)


def test_fit_without_rows(spark, tables):
    model = labels.train(spark.createDataFrame([], tables[0].schema), tables[1])
    assert model.predict(["any text"])[1].shape == (1,)


def test_literals():
    code = 'int x; // one\n// two\n/* three\n * four */ char *s = "a\\n" /* in */ "b\\x41" u8R"(raw "x")"; #define\n  #define M "in macro"\n// five\n\nf(\'"\', "x//y");'
    got = [(k, t) for k, _, t, _ in codelang.literals(code)]
    assert ("comment", "one") in got and ("comment", "two") in got and ("comment", "three\nfour") in got and ("comment", "five") in got
    assert ("string", 'a\nbAraw "x"') in got and ("string", "in macro") in got and ("string", "x//y") in got


def test_passages(spark, bayes):
    mixed = f"/** {HELD['en']} {HELD['de']}\n * @param x too short here\n * void f(int x);\n */"
    assert sorted(p[2] for p in codelang.passages(bayes, mixed)) == ["de", "en"]
    assert [p[2] for p in codelang.passages(bayes, f'puts("{HELD["zh"][:20]}" "{HELD["zh"][20:]}");')] == ["zh"]
    assert codelang.passages(bayes, '// int old_value(const char *a, int b, int c, int d);\nputs("SELECT a FROM b WHERE c = d");') == []
    assert codelang.passages(bayes, None) == codelang.passages(bayes, "") == []
    rows = [("p", mixed, "x"), ("p", mixed, "x"), ("q", None, "x"), ("r", "", "x"), ("s", f"/* {HELD['ru']} */" * 2000, "x")]
    found = codelang.find(spark.createDataFrame(rows, "path string, content string, lang string"), bayes)
    shares = {(r["path"], r["lang"]): r["share"] for r in codelang.shares(codelang.distinct(found)).collect()}
    assert set(shares) == {("p", "en"), ("p", "de"), ("s", "ru")} and all(0 < x <= 1 for x in shares.values()) and shares["s", "ru"] > 0.9


def test_prose_that_looks_like_code_stays():
    for line in (
        "Note that the clean task may differ from notifyLocalPier(), until somebody closes the session; the empty buoy stays valid. Between both ends nothing moves.",  # a call, then ';'
        "while the strong buoy was detached; which value does",  # a word of the language first
        "for the following reasons the old files stay where they are:",
        "Note that the default value = 5 holds for all files, so take care;",
    ):
        assert not is_code(line) and prose(line)[1] >= 4, line
    assert "stays valid Between both ends nothing moves" in prose("Note that the clean task may differ from notifyLocalPier(), until then; the empty buoy stays valid. Between both ends nothing moves.")[0]
    assert prose("int f(int x); // adds the two given values\r")[0] == "adds the two given values"
    for code in ("for (int i = 0; i < n; i++) { a(i); }", "int a = f(x); int b = g(y);", "static int width, height, depth;", "case foo:", "public:", "class widget final : public base {", "void f(const char *x);\r", "EXPORT widget make(int x);", 'log("the file could not be opened");'):
        assert is_code(code), code


def test_paragraph_with_a_call_and_a_semicolon_has_a_language(spark, regression, tables):
    text = f"Note that the clean task may differ from notifyLocalPier(), until somebody closes the session; the empty buoy stays valid. {HELD['en']}"
    seg = labels.segments(spark.createDataFrame([(1, text, "ru")], "doc_id bigint, text string, lang string"), tables[1], regression)
    assert [tuple(r) for r in labels.wrong(seg).collect()] == [(1, 0, "en")]


def test_passage_behind_code_on_one_line(bayes):
    note = "Note that the shared epoch may differ from scheduleStaleModule(), while no other thread is waiting; the empty buoy stays valid."
    found = codelang.passages(bayes, f"/// {note}\n")
    assert [(p[2], p[5]) for p in found] == [("en", note)]
    found = codelang.passages(bayes, f"/* int f(int x); {HELD['de']} */")
    assert [(p[2], p[5]) for p in found] == [("de", HELD["de"])]
    assert codelang.passages(bayes, "/* for (int i = 0; i < n; i++) { add(first, second, third); }\n * int a = read(b); int c = read(d); */") == []


def test_shares_are_bytes_of_the_file(spark, bayes):
    words = "the caller must close the file before the next step begins here"
    german = "der Aufrufer muss die Datei schließen, bevor der nächste Schritt beginnt"
    files = {
        "a.h": (f"// the caller must   close\n//     the file before\n//\tthe next step begins here\nint a;\n", [("en", len("the caller must   close\n//     the file before\n//\tthe next step begins here"))]),
        "b.h": (f"/* {words}\n */", [("en", len(words))]),
        "c.h": (f'puts("{german.replace("ß", chr(92) + "xc3" + chr(92) + "x9f")}");', [("de", len(german.encode()) - 2 + 8)]),
        "d.h": ("int x;", []),
        "e.h": (f'f("the caller must close " /* x */ "the file before the next step begins\\n");', None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in files.items()], "path string, content string")
    found = codelang.find(df, bayes)
    got = {(r["path"], r["lang"]): r for r in codelang.shares(codelang.distinct(found)).collect()}
    for path, (content, want) in files.items():
        for lang, size in want or []:
            assert got[path, lang]["bytes"] == size, path
            assert got[path, lang]["share"] == round(size / len(content.encode()), 6)
    for r in found.collect():
        part = files[r["path"]][0][r["from_char"] : r["to_char"]]
        assert part[0].isalpha() and r["bytes"] == len(part.encode())
    assert ("d.h", "en") not in got
