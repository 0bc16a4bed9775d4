"""Which bodies document their function, and what is captured."""

from __future__ import annotations

import time

import pytest

from tessellar.llm.documented import description_of, documented, first_pair, pairs

RUST, GO, SCRIPT, PYTHON = "fn merge_list(a: i64) -> i64 {\n    a\n}", "func MergeList(a int) int {\n\treturn a\n}", "function mergeList(a) {\n  return a;\n}", "def merge_list(a):\n    {}return a\n"
CASES = [
    ("a.rs", "merge_list", "/// Panics once the queue is gone.\n" + RUST, True),
    ("a.rs", "merge_list", "/// Merges the list.\n" + RUST, False),
    ("a.rs", "merge_list", "/// TODO: say more\n#[inline]\n" + RUST, False),
    ("a.rs", "merge_list", "/// # Arguments\n/// * `a`\n" + RUST, False),
    ("a.rs", "merge_list", "/// # Arguments\n/// * `a` - the colder side\n" + RUST, True),
    ("a.rs", "merge_list", "/** Überspringt leere Zeilen. */\n#[must_use]\n" + RUST, True),
    ("a.rs", "merge_list", "// let total = a + 1;\n// log(total);\n" + RUST, False),
    ("a.rs", "merge_list", "fn merge_list() {\n    // Falls back to the planner.\n    let s = r#\"}\"#;\n}", False),
    ("a.go", "MergeList", "// MergeList ...\n" + GO, False),
    ("a.go", "MergeList", "//nolint: errcheck\n" + GO, False),
    ("a.go", "MergeList", "// ---- helpers ----\n" + GO, False),
    ("a.go", "MergeList", "// O(n) in the cache size.\n" + GO, True),
    ("a.ts", "mergeList", "/**\n * @param {number} a\n * @returns {number}\n */\n" + SCRIPT, False),
    ("a.ts", "mergeList", "/**\n * @param a the noisy side\n */\n" + SCRIPT, True),
    ("a.js", "mergeList", "// eslint-disable-next-line no-unused-vars\n" + SCRIPT, False),
    ("a.js", "mergeList", "/** Keeps at most 5 entries. */\nconst mergeList = async (a) => {\n  return `}${a}`;\n};", True),
    ("a.TSX", "View", "// Cheap; allocates nothing.\nexport function View() {\n  return (<h2>{a} Don't (yet</h2>);\n}", True),
    ("a.py", "merge_list", PYTHON.format('"""Falls back to the cache."""\n    '), True),
    ("a.py", "merge_list", PYTHON.format('b"""Falls back to the cache."""\n    '), False),
    ("a.py", "merge_list", PYTHON.format('"""Merge list.\n\n    TODO: describe\n    """\n    '), False),
    ("a.py", "merge_list", PYTHON.format('"""\n    :param a: \n    :return:\n    """\n    '), False),
    ("a.py", "merge_list", PYTHON.format('"""Args:\n        a: the colder side\n    """\n    '), True),
    ("a.py", "merge_list", "# Evita recorrer dos veces la lista.\n@cached\n" + PYTHON.format(""), True),
    ("a.py", "merge_list", PYTHON.format("# inside only\n    "), False),
    ("a.md", "merge_list", "/// Panics once the queue is gone.\n" + RUST, False),
]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, f, "fn", n, b) for i, (f, n, b, _) in enumerate(CASES)]
    rows += [(100, "a.rs", "fn", None, CASES[0][2]), (101, "a.rs", "fn", "x", None), (102, "a.rs", "struct", "x", CASES[0][2]), (103, None, "fn", "x", CASES[0][2]), (104, "a.rs", "fn", "x", ""), (0, *rows[0][1:])]
    rows += [(105, "a.rs", "getter", "big", "/// Reads once.\nfn big() {\n" + "    let a = vec![1, 2];\n" * 20_000 + "}")]
    table = spark.createDataFrame(rows, "sym_id long, file string, kind string, name string, body string").selectExpr("*", "1 AS ext", "2 AS code")
    return documented(table).collect()


def test_cases(found):
    got = {r["sym_id"] for r in found}
    for i, (f, _, body, want) in enumerate(CASES):
        assert (i in got) == want, (f, body)
    assert {100, 105} <= got and not got & {101, 102, 103, 104}
    assert len(found) == len(got)


def test_parts(found):
    row = next(r for r in found if r["sym_id"] == 0)
    assert (row["name"], row["kind"], row["description"], row["code"]) == ("merge_list", "fn", "Panics once the queue is gone.", RUST)
    assert next(r for r in found if r["sym_id"] == 100)["name"] == "merge_list"


def test_several_functions_of_a_file():
    text = "/// Reads once.\nfn a() { let c = '}'; }\n\nfn b() {}\n\n/// Blocks until it settles.\nfn c(x: &'static str) -> Vec<[u8; 2]> { x }\n"
    assert [(n, d) for n, d, _ in pairs(text, "rust")] == [("a", "Reads once."), ("c", "Blocks until it settles.")]


HEADS = {"rust": "/// Rotates the blades.\nfn outer() {", "go": "// Rotates the blades.\nfunc outer() {", "script": "/** Rotates the blades. */\nfunction outer() {", "python": 'def outer():\n    """Rotates the blades."""\n    {'}


@pytest.mark.parametrize("family", HEADS)
@pytest.mark.parametrize("piece", ["{ ( [ ", "{ if (x) { a(b[c]); } ", "'it ", '"q ', "`t ${ ", "/* c ", "<p>it's (a) {b} "])
def test_long_bodies_that_do_not_close(family, piece):
    for size in (16_000, 1_000_000):
        began = time.perf_counter()
        found = first_pair(HEADS[family] + piece * (size // len(piece)), family, "outer")
        assert found[1].endswith("Rotates the blades.") and time.perf_counter() - began < 2


@pytest.mark.parametrize("family", ["rust", "go", "script"])
def test_long_bodies_end_as_short_ones(family):
    head = HEADS[family]
    for inside in (' a("}", [1]); /* } */ // }\n', " f({}); " if family != "rust" else " f('}', &'a b); "):
        for times in (3, 5_000):
            body = head + inside * times + "}\n\nrest {"
            assert first_pair(body, family, "outer")[2].endswith(inside.rstrip() + " }" if inside.endswith(" ") else "}")
            assert not first_pair(body, family, "outer")[2].endswith("{")


ENDS = [
    ("rust", "fn outer() {", " /* a /* b */ } */", "}"),
    ("rust", "fn outer() {", ' r###"a }"## } "###;', "}"),
    ("rust", "fn outer() {", ' r#type(b"}", br"\\", \'}\');', "}"),
    ("rust", "fn outer(a: [u8; { N }]);", "", ""),
    ("go", "func outer(){", " a(`}`, '}', \"}\");", "}"),
    ("go", "func outer() int", "", ""),
    ("go", "func outer(a int) <-chan int{", " a(b);", "}"),
    ("go", "func outer(a int) /* { */ int{", " a(b);", "}"),
    ("script", "function outer() {", " a = /[/}]}/;", "}"),
    ("script", "function outer() {", " `a ${ `}` } b`;", "}"),
    ("script", "function outer() {", " `a ${ f(`x`, { b }) + '}' } b`;", "}"),
    ("script", "outer(a: number): { b: string } | { c: string } {", " a(b[c]);", "}"),
    ("script", "function outer(a);", "", ""),
    ("script", "function outer(a) /* { */ {", " a(b);", "}"),
    ("script", "outer(a): Promise<{ b: string }> {", " a(b);", "}"),
    ("script", "const outer = (a) => a.b(c);", "", ""),
    ("script", "const outer = (a) => ({", " b: {},\n", "});"),
    ("script", "const outer = (a: number): boolean => a === [", "\n  b,", "\n];"),
    ("script", "const outer = (a): ((b: T) => U) => a === [", "\n  b,", "\n];"),
    ("script", "const outer = (a): (b: T) => { c: U } => {", " b({});\n", "}"),
    ("script", "const outer: (a: T) => U = (a) => {", " b({});\n", "};"),
    ("script", "const outer = (a) =>\n  a", "\n    .b({ c })", ";"),
    ("script", "const View = () => <p>", "\n  <a>Don't (yet</a>", "\n</p>;"),
]


@pytest.mark.parametrize("times", [1, 2_000])
@pytest.mark.parametrize(("family", "head", "inside", "close"), ENDS)
def test_no_size_decides_where_a_body_ends(family, head, inside, close, times):
    doc = "// Rotates the blades.\n"
    code = head + inside * times + close
    for rest in ("\n", "\nrest(a) { b }\n" * 2_000):
        assert first_pair(doc + code + rest, family, None)[2] == code


@pytest.mark.parametrize(("family", "head"), [("rust", "fn outer() {"), ("go", "func outer() {"), ("script", "function outer() {"), ("script", "const outer = (a: number): string => {")])
def test_no_size_decides_what_does_not_balance(family, head):
    for inside in (" if (a) ] { b }", " if (a { b }"):
        for times in (1, 5_000):
            body = "// Rotates the blades.\n" + head + inside * times + "\n}\n\nrest()"
            assert first_pair(body, family, "outer")[2].endswith("rest()")


@pytest.mark.parametrize("times", [1, 5_000])
@pytest.mark.parametrize(("family", "head"), [("rust", "fn outer("), ("rust", "fn outer() -> (a, "), ("rust", "fn outer<"), ("go", "func outer()(a int, "), ("script", "outer(a): [")])
def test_no_size_decides_what_is_cut_in_the_signature(family, head, times):
    code = head + "b, " * times + "c"
    assert first_pair("// Rotates the blades.\n" + code, family, "outer")[2] == code


@pytest.mark.parametrize("piece", ["= /[ ", "= /[=/]x", "\n\n", "`${`", "f({}); "])
def test_long_scripts_take_one_pass(piece):
    for head in ("function outer() {", "function outer(a: number): string {"):
        began = time.perf_counter()
        assert first_pair("// Rotates the blades.\n" + head + piece * (300_000 // len(piece)), "script", "outer") and time.perf_counter() - began < 2


def test_no_pair_of_an_inner_or_other_function():
    inner = "/// Rotates the turbine.\nfn inner(b: i64) { b }"
    assert first_pair("fn outer(a: i64) {\n    if a {\n" + inner, "rust", "outer") is None
    assert first_pair(inner, "rust", "outer") is None and first_pair(inner, "rust", "inner")
    assert first_pair("/// Rotates the turbine.\nfn outer(a: i64) {\n    if a {", "rust", "outer")[2] == "fn outer(a: i64) {\n    if a {"


@pytest.mark.parametrize("line", ["Gibt den Wert zurück", "Renvoie la valeur", "Devuelve el valor", "Возвращает значение", "返回值", "値を返す", "Returns the value", "Επιστρέφει την τιμή"])
def test_nothing_said_in_any_language(line):
    assert description_of([line], "load") is None


@pytest.mark.parametrize("line", ["Gibt die Temperatur zurück", "Renvoie la température", "Devuelve la temperatura", "Возвращает температуру", "返回温度", "温度を返す", "Returns the temperature"])
def test_something_said_in_any_language(line):
    assert description_of([line], "load") == line



def test_empty(spark):
    assert documented(spark.createDataFrame([], "sym_id long, file string, kind string, name string, body string")).count() == 0


PROSE = """Standard deviation of the window
Standardizes the incoming rows
Denotes the colder side
Denormalizes rows for export
Suppresses duplicates in the queue
Regional totals by month
Region of interest on the map
Coverage of the planet by sensors
Black pixels are skipped
Cargo weight in tonnes
Flow control over the socket
Prettier layouts win ties
Lint rules apply in order
Export rows
Pragmatic choice of buckets
Type: kind of node
Biome names by climate
Linted sources come first
Optimize the plan before execution
Bug-compatible with older clients
Hack around the broken clock
Todo lists of the user""".splitlines()
TOOLS = """standard:disable
deno-lint-ignore no-explicit-any
deno-fmt-ignore
coverage:ignore-line
#region Helpers
#endregion
suppress(unused)
eslint-disable no-alert
eslint no-alert: 0
prettier-ignore
biome-ignore lint/style: generated
istanbul ignore next
c8 ignore start
@ts-expect-error wrong upstream
@flow strict
jshint esversion: 6
webpackChunkName: "editor"
pragma: no cover
fmt: off
rustfmt: skip
clippy::too_many_lines
cargo:rerun-if-changed=build.rs
go:generate stringer
#cgo LDFLAGS: -lpng
line parser.go:10
lint:ignore U1000 kept
type: ignore[attr-defined]
noqa: E501
nolint: errcheck
TODO later today
todo: describe purpose
Optimize (later today)
bug: crashes sometimes
fixme
tbd
xxx later
n/a""".splitlines()


@pytest.mark.parametrize("line", PROSE)
def test_sentences_that_begin_like_a_directive_state_something(line):
    for family, body in (("rust", f"/// {line}\n{RUST}"), ("go", f"// {line}\n{GO}"), ("script", f"/** {line} */\n{SCRIPT}"), ("python", f"# {line}\n" + PYTHON.format(""))):
        assert [p[1] for p in pairs(body, family)] == [line]


@pytest.mark.parametrize("line", TOOLS)
def test_directives_and_notes_state_nothing(line):
    assert not list(pairs(f"// {line}\n{GO}", "go"))


def test_fold_marks_and_exports():
    assert not list(pairs("#region Geometry\n" + PYTHON.format(""), "python"))
    assert not list(pairs("//export MergeList\n" + GO, "go"))
