"""Golden token lists, and the generic tokeniser against another regex engine."""

import random

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexloom.functions import lexis
from lexloom.operators import declared, profile
from lexloom.plans import model

GOLDEN = [
    (
        "C++",
        "#include <x>\nint main() { int a = 0x1F; /* c */ float f = 1.5f; return a; }",
        "int main ( ) { int a = INT_LITERAL ; float f = FLOAT_LITERAL ; return a ; }",
        {"a", "f"},
    ),
    (
        "C#",
        "class A { void M(int n) { var s = $\"x{n}\"; bool b = true; char c = 'q'; n = 0b1; } }",
        "class A { void M ( int n ) { var s = STRING_LITERAL ; bool b = BOOL_LITERAL ; "
        "char c = STRING_LITERAL ; n = INT_LITERAL ; } }",
        {"n", "s", "b", "c"},
    ),
    (
        "Go",
        "package m\nfunc f(x int) { y := 'a' + 2i; s := \"q\"; _ = 1.5 }",
        "package m \n func f ( x int ) { y := INT_LITERAL + INT_LITERAL ; "
        "s := STRING_LITERAL ; _ = FLOAT_LITERAL }",
        {"x", "y", "s"},
    ),
    (
        "Python",
        "def g(a, b=1):\n    c = \"x\" 'y'  # hi\n    return True\n",
        "def g ( a , b = FLOAT_LITERAL ) : \n c = STRING_LITERAL STRING_LITERAL \n return BOOL_LITERAL \n",
        {"a", "b", "c"},
    ),
    # Prefixes, raw strings, suffixed literals, macros over two lines.
    (
        "C++",
        "#define A \\\n b\nauto s = R\"(ab c)\"; x = 12_km + 1'000ull; p->*q >>= b >> .5e3;\n"
        "u8\"z\\\"q\"_s 'a' true nullptr",
        "auto s = STRING_LITERAL ; x = 12_km + INT_LITERAL ; p ->* q >>= b > > FLOAT_LITERAL ; "
        "u8\"z\\\"q\"_s STRING_LITERAL BOOL_LITERAL nullptr",
        {"s"},
    ),
    (
        "C#",
        "#region x\nvar s = $\"a{d[\"k\"]}b\"; var t = @\"a\"\"b\"; x = 0.Equals(1) + 1.5e3f; a ??= b?.c;",
        "var s = STRING_LITERAL ; var t = STRING_LITERAL ; x = 0.Equals ( INT_LITERAL ) + "
        "FLOAT_LITERAL ; a ??= b ? . c ;",
        {"s", "t"},
    ),
    # A line end counts only where it can close a statement.
    (
        "Go",
        "import (\n\"a\"\n)\n\n// c\nx++ // d\n/* a\n b */ y := `raw\n` +\n0x1p-2\nfor i := range y {\n}\n",
        "import ( STRING_LITERAL \n ) \n x ++ \n y := STRING_LITERAL + FLOAT_LITERAL \n "
        "for i := range y { } \n",
        {"y"},
    ),
    # Lines joined by brackets and by backslashes; blank and comment lines.
    (
        "Python",
        "x = [1,\n  2j,\n\n 3.e5]\n\n# c\ny = '''a'b\n''' \\\n + rb\"q\"\nself.z = lambda q: q\n",
        "x = [ FLOAT_LITERAL , FLOAT_LITERAL , FLOAT_LITERAL ] \n y = STRING_LITERAL + "
        "STRING_LITERAL \n self . z = lambda q : q \n",
        {"x", "y", "z", "q"},
    ),
    ("X", "a1.5 = 0xFFg 'it\\'s' \"q\" é—était\r\n x",
     "a INT_LITERAL . INT_LITERAL = INT_LITERAL STRING_LITERAL STRING_LITERAL é —é tait \r x", set()),
    ("X", "it's a — naïve don't 3½ ٣ \\", "it STRING_LITERAL t INT_LITERAL ½ INT_LITERAL \\", set()),
    ("X", "if(x){y=\"a\\\"b\";}//z", "if ( x ) { y = STRING_LITERAL ; } / / z", set()),
]


def tokens_of(spark, rows, ignored=None):
    files = spark.createDataFrame(rows, "doc_id long, language string, content string")
    return profile.tokenise(files, ignored)


def test_golden_tokens(spark):
    rows = [(n, case[0], case[1]) for n, case in enumerate(GOLDEN)]
    found = {r.doc_id: r.tokens for r in tokens_of(spark, rows).collect()}
    for n, (_, _, expected, _) in enumerate(GOLDEN):
        assert found[n] == expected.split(" ")


def test_golden_masks(spark):
    rows = [(n, case[0], case[1]) for n, case in enumerate(GOLDEN)]
    masked = declared.masked_tokens(tokens_of(spark, rows)).collect()
    found = {r.doc_id: r.tokens for r in masked}
    for n, (_, _, expected, names) in enumerate(GOLDEN):
        assert found[n] == ["VARIABLE" if t in names else t for t in expected.split(" ")]


def test_names_are_masked_from_their_declaration_on(spark):
    text = "print(a)\na = 1\nprint(a)\n"
    (row,) = declared.masked_tokens(tokens_of(spark, [(1, "Python", text)])).collect()
    assert row.tokens == "print ( a ) \n VARIABLE = FLOAT_LITERAL \n print ( VARIABLE ) \n".split(" ")


@pytest.mark.parametrize(
    "language,text,names",
    [
        ("C++", "int a, b; Foo c, d = a; int f(int p, Foo q) { return p; }", {"a", "b", "c", "d"}),
        ("C#", "int a, b; F(c, d); string[] e = null;", {"a", "b", "e"}),
        ("Go", "var a int\nconst b = 1\nc, d := 1, 2\nfunc f(p string, q []int) {}\n", {"a", "b", "c", "d", "p", "q"}),
        ("Python", "a, b = 1, 2\nc += f(a, k=b)\nd: int = 3\nfor e in d:\n  g.h = e\n", {"a", "b", "c", "d", "h"}),
        ("Go", "select {\ncase a := <-b:\n}\nc := a\n", {"c"}),
        ("Python", "_ = 1\nmatch q:\n  case a: f(_)\ntry: b = 1\nexcept E as c: f(c)\nwith f() as d: f(d)\n", {"a", "b", "d"}),
        ("Python", "def f(a: int = 3, *b): c = 1\nif f(q): d = 2\n", {"a", "b", "c", "d"}),
        ("Go", "func f(p *T, a, b int) { g(x * y, z) }\nfunc (r *R) m() {}\n", {"p", "a", "b", "r"}),
        ("Go", "var c, d = 1, 2\nconst (\n\tE = iota\n\tF\n)\nh, i, j := 1, 2, 3\n", {"c", "d", "E", "F", "h", "i", "j"}),
        ("C#", "List<int> xs = f(); int a, b, c; int d = 1, e = 2; if (q > r) { s = t > u; }", {"xs", "a", "b", "c", "d", "e"}),
        ("C#", "void M(Map<int, string> m, Foo[] n) { g(v, w); }", {"m", "n"}),
        ("C++", "std::vector<int> v; Foo* p; int a, b, c; int k(5); int m{6}; f(x * y); z = u * w;", {"v", "p", "a", "b", "c", "k", "m"}),
        ("Python", "a, b, c = t\n(x, y) = t\nf(q, r).s = 1\ng(u, v=w)\n", {"a", "b", "c", "x", "y", "s"}),
        ("Python", "with o() as f, p() as g: h(f)\nimport k as l, m as n\n", {"f", "g"}),
    ],
)
def test_declared_names(spark, language, text, names):
    tokenised = tokens_of(spark, [(1, language, text)])
    (plain,), (masked,) = tokenised.collect(), declared.masked_tokens(tokenised).collect()
    hidden = {p for p, m in zip(plain.tokens, masked.tokens) if p != m}
    assert hidden == names
    assert set(masked.tokens) - set(plain.tokens) == {"VARIABLE"}


@pytest.mark.parametrize(
    "language,text,shown",
    [
        ("C#", "void M(){int z=1; z=3;} void N(){z=2;}", [False, False, True]),
        ("C++", "void m(){int z=1; { z=3; }} void n(){z=2;}", [False, False, True]),
        ("Go", "func m() {\nz := 1\nif q { z = 3 }\n}\nfunc n() { z = 2 }\n", [False, False, True]),
        ("Go", "var z = 1\nfunc m() { z = 3 }\nfunc n() { z = 2 }\n", [False, False, False]),
    ],
)
def test_names_are_masked_to_the_end_of_their_block(spark, language, text, shown):
    tokenised = tokens_of(spark, [(1, language, text)])
    (plain,), (masked,) = tokenised.collect(), declared.masked_tokens(tokenised).collect()
    assert [m == "z" for p, m in zip(plain.tokens, masked.tokens) if p == "z"] == shown


def test_files_do_not_share_names(spark):
    rows = [(1, "C++", "int a = 1;"), (2, "C++", "a = 2;")]
    masked = {r.doc_id: r.tokens for r in declared.masked_tokens(tokens_of(spark, rows)).collect()}
    assert masked[1][1] == "VARIABLE" and masked[2][0] == "a"


def test_ignored_and_unknown_languages(spark):
    rows = [(1, "Go", "x"), (2, None, "x"), (3, "Kotlin", "X")]
    found = {r.doc_id: r.tokens for r in tokens_of(spark, rows, ["Go"]).collect()}
    assert found == {1: None, 2: None, 3: ["x"]}


@pytest.mark.parametrize(
    "language,text,count",
    [
        ("C++", '"' + "a" * 200_000 + '"' + "/*" + "* " * 60_000 + "*/", 1),
        ("C++", "'" + "\\n" * 100_000 + "'", 1),
        ("C#", '$"' + "{a}" * 60_000 + '"', 1),
        ("Go", '"' + "\\n" * 100_000 + '"', 1),
        ("Python", "'''" + "'a" * 100_000 + "'''", 1),
        ("Python", "f(\n1,)\n" * 5_000, 30_000),
        ("X", "'" + "\\n" * 100_000 + "'", 1),
    ],
)
def test_long_literals_do_not_overflow(spark, language, text, count):
    (row,) = tokens_of(spark, [(1, language, text)]).collect()
    assert len(row.tokens) == count


def _by_regex_module(text):
    text = text.lower()
    for pattern, written in lexis.GENERIC_REPLACEMENTS:
        text = regex.sub(lexis.greedy(pattern), written, text)
    return regex.findall(lexis.greedy(lexis.GENERIC_TOKEN), text)


ALPHABET = "aZ09_ .'\"\\/<>{}[]()\n\t+-=é—½x#"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(ALPHABET, max_size=60), min_size=20, max_size=40))
def test_generic_tokens_equal_another_engine(spark, texts):
    rows = list(enumerate(texts))
    frame = spark.createDataFrame(rows, "n int, text string")
    found = dict(frame.select("n", lexis.generic_tokens(F.col("text"))).collect())
    for n, text in rows:
        assert found[n] == _by_regex_module(text)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("()[]{}\n#'ab= ,", max_size=60), min_size=20, max_size=30))
def test_python_line_ends(spark, texts):
    """No line end inside brackets and none twice in a row."""
    rows = [(n, "Python", text) for n, text in enumerate(texts)]
    for row in tokens_of(spark, rows).collect():
        depth, before = 0, None
        for token in row.tokens:
            if token == "\n":
                assert depth <= 0 and before != "\n"
            depth += (token in "([{") - (token in ")]}")
            before = token


def test_fast_python_pattern_finds_the_same_tokens(spark):
    rng = random.Random(5)
    pieces = ["f", "rb", "Br", "u", "x", "é", "9", "_", "'", '"', "'''", "\\", "#", "\n", " ", "(", "0x1f", ".5", "namé", "uf"]
    rows = [(n, "".join(rng.choices(pieces, k=rng.randrange(1, 30)))) for n in range(3_000)]
    frame = spark.createDataFrame(rows, "doc_id int, content string")
    fast = lexis.find_all(F.col("content"), lexis._PYTHON_FAST_TOKEN)
    plain = lexis.find_all(F.col("content"), lexis.PYTHON_TOKEN)
    assert frame.where(fast != plain).count() == 0


@pytest.mark.parametrize("language", ["C++", "C#", "Go", "Python", "generic"])
def test_fast_patterns_find_the_same_tokens(spark, language):
    """Blanks passed over in runs and names tried first change no token."""
    plain, fast, blanks = {
        "C++": (lexis.CPP_TOKEN, lexis._CPP_FAST_TOKEN, r" \t\r\n"),
        "C#": (lexis.CSHARP_TOKEN, lexis._CSHARP_FAST_TOKEN, r" \t\r\n"),
        "Go": (lexis.GO_TOKEN, lexis._GO_FAST_TOKEN, r" \t"),
        "Python": (lexis.PYTHON_TOKEN, lexis._PYTHON_FAST_TOKEN, r" \t"),
        "generic": (lexis.GENERIC_TOKEN, lexis._GENERIC_FAST_TOKEN, r" \t\n"),
    }[language]
    rng = random.Random(8)
    pieces = ["u8", "R", "L", "x", "é", "9", "_", "'", '"', "$", "@", "`", "\\", "#", "\n", "\r", " ", "\t ", "(", "]", "?", "=", ":", "0x1f", ".5", "namé", "½"]
    rows = [(n, "".join(rng.choices(pieces, k=rng.randrange(1, 30)))) for n in range(3_000)]
    rows.append((3_000, " " * 200_000 + "½" + " " * 200_000))
    frame = spark.createDataFrame(rows, "doc_id int, content string")
    found = lexis.find_all(F.col("content"), fast, blanks)
    assert frame.where(found != F.regexp_extract_all("content", F.lit(plain), F.lit(0))).count() == 0


def test_shaping_patterns_start_at_words(spark):
    """Patterns tried once a word write the same text as those tried at every letter."""
    rng = random.Random(9)
    rows = [("".join(rng.choices(["a", "bc", "D", " ", ". ", ", ", ".", "é"], k=40)),) for _ in range(2_000)]
    frame = spark.createDataFrame(rows, "text string")
    for pattern in ("([a-z]+) ([a-z]+)\\.", "([a-z]+), "):
        whole = model._whole_words(pattern)
        assert frame.where(F.regexp_replace("text", pattern, "<$1>") != F.regexp_replace("text", whole, "<$1>")).count() == 0


def test_python_line_ends_inside_brackets(spark):
    rng = random.Random(6)
    rows, expected = [], {}
    for number in range(200):
        words = rng.choices(["(", ")", "[", "]", "{", "}", "\n", "ab", "c"], k=rng.choice([0, 1, 5, 60, 900]))
        kept, depth = [], 0
        for at, word in enumerate(words):
            depth += (word in "([{") - (word in ")]}") if len(word) == 1 else 0
            if word != "\n" or (depth <= 0 and not (at and words[at - 1] == "\n")):
                kept.append(word)
        rows.append((number, " ".join(words)))
        expected[number] = kept
    frame = spark.createDataFrame(rows, "doc_id int, content string")
    found = frame.select("doc_id", lexis.python_tokens(F.col("content"))).collect()
    assert dict(map(tuple, found)) == expected
