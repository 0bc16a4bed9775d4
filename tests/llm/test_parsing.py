"""Valid and faulty sources of each language, chunks of any size, and rates."""

from __future__ import annotations

import random

import pytest

from tessellar.llm.parsing import fault_of, fault_rates, file_faults, language_of

VALID = {
    "rust": [
        "",
        "// only a comment",
        "#!/usr/bin/env run\nfn main() {}",
        "use std::{collections::HashMap, io::{self, Read}};\npub(crate) mod a;\n#[derive(Debug)]\nstruct A<'a, T: Clone + 'a> where T: Copy { x: &'a [T], y: Option<Vec<Vec<u8>>> }\nstruct B(pub i64, u8);\nstruct C;",
        "impl<'a, T> Iterator for A<'a, T> where T: Fn(i64) -> bool { type Item = u8; fn next(&mut self) -> Option<Self::Item> { self.x.iter().map(|v| v + 1).sum::<i64>(); None } }",
        "fn f(x: i64) -> i64 { if let Some(y) = g(x) && y > 0 { return y } match x { 0 => 1, 1 | 2 if x >> 1 >= 0 => { 3 } -1..=9 => 4, _ => {} }\n let A { a, ref b, .. } = z; 'l: loop { break 'l; } for (i, _) in v.iter().enumerate() { continue } x as i64 }",
        "enum E { A, B(u8), C { x: i64 } = 3 }\ntrait T: Send { const N: usize; fn a(&self) where Self: Sized; fn b() {} }\nmacro_rules! m { ($x:expr) => { $x + 1 }; }\nm!(1);\nstatic S: &str = r#\"\n<<<<<<< ours\n\"#;",
        "async fn f() { let x = async move { g().await? }; let c = move |a: i64, (b, c)| -> i64 { a }; let r = ..3; let s = &v[1..]; let t = (1,); let u = [0u8; 4]; unsafe { *p = 1 } let Some(q) = w else { return }; }",
        "fn f() { let a = S { x: 1, ..Default::default() }; println!(\"{}\", a.0.1); let c = '\\u{1F600}'; let d = b'x'; let e = 1.0e5_f64; let f = a < b && c > d; /* a /* b */ */ }",
    ],
    "go": [
        "",
        "// only a comment\n",
        "package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype T[K comparable, V any] struct {\n\ta, b int `json:\"a\"`\n\t*Base\n\tm map[string][]K\n}\n\ntype I interface {\n\tF(a int, b ...string) (int, error)\n\t~int | string\n}\n",
        "package a\nfunc (t *T[K, V]) F(x int, f func(int) string) (n int, err error) {\n\tfor i := 0; i < 3; i++ {\n\t\tn += i\n\t}\n\tfor k, v := range m {\n\t\t_ = k\n\t}\n\tfor {\n\t\tbreak\n\t}\n\tif v, ok := m[x]; ok && v > 0 {\n\t\treturn v, nil\n\t} else if x == 1 {\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T:\n\t\tn++\n\tdefault:\n\t}\n\tselect {\n\tcase a := <-c:\n\tcase c <- 1:\n\t}\n\tgo func() { defer g() }()\n\treturn\n}\n",
        "package a\nvar (\n\tx = []T{{1, 2}, {a: 3}}\n\ty map[string]int = map[string]int{\"a\": 1}\n)\nconst s = `\n<<<<<<< ours\n`\nfunc f() { a, b := x[1:2], y[:]; L: for { continue L }; _ = struct{ a int }{1}; _ = '\\n'; _ = f[int](3) }\n",
    ],
    "javascript": [
        "",
        "import a, { b as c } from 'x';\nimport * as d from \"y\"\nexport default class extends A { #p = 1; static s = 2; static { f() } get x() { return 1 } set x(v) {} async *g() {} [k]() {} constructor() { super() } }",
        "const re = /[{\"'\\/]9/g, t = `a${b + `${c}`}d`;\nfor (const [k, v] of Object.entries(o)) { if (k in o) continue; }\nlabel: while (true) { break label }\nconst { a = 1, ...rest } = { a, 'b': 2, [c]: 3, d() {}, get e() { return 1 } }",
        "let f = async (a, { b }) => { await a?.b?.[c]?.(d) ?? e }\nvar g = function* () { yield* h() }, i = x => ({ ...x })\nif (a) b\nelse c\ndo { } while (0)\ntry { f() } catch { } finally { }\nswitch (a) { case 1: default: b() }",
        "const V = () => (<><A.B x=\"1\" {...p} y={z > 1}>Don't (yet {n} &amp; more<br/></A.B></>);\nconst q = a / b / c;",
        "const s = `\n<<<<<<< ours\n`;",
    ],
    "typescript": [
        "interface A<T extends object = {}> extends B, C<T> { readonly a?: string; [k: string]: unknown; m<U>(x: U): void; new (x: number): A<T>; (y: string): void }\ntype F = (a: number, ...b: string[]) => asserts a is string;\ntype G<T> = T extends (infer U)[] ? U : { -readonly [K in keyof T]?: T[K] };",
        "export abstract class A<T> extends B<T> implements C { private readonly x: number = 1; constructor(private a: string, public b?: number) { super() } abstract f(): void; static async g<T>(this: A<T>, x?: T): Promise<Map<string, Array<T>>> { return new Map<string, T[]>() as any } declare y: string; get z(): number { return 1 } }",
        "enum E { A = 1, B }\ndeclare module 'x' { export const y: number; }\nnamespace N.M { }\nfunction f(a: string): string;\nfunction f(a: any, b = 1): asserts a {}\nconst x = <any>y, z = a! as unknown as T, g = <T,>(v: T): T => v, h = f<string>('a') satisfies string;",
        "import type { A } from 'a';\nimport B = require('b');\nexport type { A };\nlet t: [a: string, b?: number, ...c: boolean[]] = u, n: typeof x[number], o: `a${string}`, v: unique symbol;\nfor (let i = 0; i < n; i++) {}\nconst r = a < b || c > d ? (x) : (y);\nlet w = (a: number): number => a >>> 1;",
    ],
    "tsx": ["export function V({ a }: { a: string }) {\n  return (\n    <section className=\"x\" data-n={1}>\n      <h2>{a} Don't (yet</h2>\n      {a > 'b' ? <b>x</b> : null}\n    </section>\n  );\n}\nconst g = <T extends object>(x: T) => x;\nconst s = useState<string>('');"],
    "python": ["", "def f(a, *, b=1):\n    '''x'''\n    return f\"{a!r:>{b}} {{x}} {d['k']}\"\n", "match a:\n    case [x, *_]:\n        pass\n"],
}
FAULTY = {
    "rust": ["fn f() {", "fn f() }", "use a::b", "let x = 1;", "fn f() { let x = ; }", "<<<<<<< a\nfn f() {}\n=======\nfn g() {}\n>>>>>>> b", "fn f( { }", "struct A { x }", "fn f() { a b }", "/** open", "const S: &str = \"open", "def f(x):\n    pass", "pub"],
    "go": ["func f() {}", "package a\nfunc f() {", "package a\n=======\n", "package a\nvar", "package a\nfunc f() { x := }", "package a\nx := 1", "package a\nfunc f() int { return 1 } }", "package a\nfunc f() {\n\ta b\n}", "package a\nconst s = `open", "function f() {}"],
    "javascript": ["function f( {", "const a;", "import a", "export", "let x: number = 1;", "interface A { }", "a b", "if (a {", "`open", "/* open", "class A { x: 1 }", "const a = <b>x</c>;", "=======", "def f(x):\n  pass", "function f(a: number) {}", "for (;;", "x = {a: 1,"],
    "typescript": ["const a: = 1;", "interface A {", "type A = ;", "const v = <b>text</b>;", "pub fn f() {}", "package a", "function f(): {", "<<<<<<< ours\n"],
    "tsx": ["const v = <b>text;", "const v = <b>a } b</b>;", "<!DOCTYPE html>\n<html><p>x</html>"],
    "python": ["def f(:\n", "x = [1,\n", "=======\n", "function f() {}\n"],
}


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert fault_of(text, language) is None
    assert fault_of("\ufeff" + text.replace("\n", "\r\n"), language) is None
    assert fault_of(text, language, 40) is None


@pytest.mark.parametrize(("language", "text"), [(k, t) for k, v in FAULTY.items() for t in v])
def test_faulty(language, text):
    assert fault_of(text, language) is not None
    assert fault_of(text, language, 10) is not None


def test_chunks_agree_on_cut_texts():
    rng = random.Random(8)
    for language, texts in VALID.items():
        for text in texts:
            for _ in range(12):
                cut = text[: rng.randrange(len(text) + 1)]
                assert (fault_of(cut, language) is None) == (fault_of(cut, language, 25) is None), (language, cut)


def test_merging_in_any_order():
    """The law of the maps: however neighbours are joined, the whole says the same for every start."""
    from tessellar.llm.parsing import chunks_of
    from tessellar.llm.syntax.lexing import LEXERS, Chunk, Chunks, merge

    rng = random.Random(4)
    for language in ("rust", "go", "javascript", "tsx"):
        for text in [*VALID[language], *FAULTY[language]]:
            parts = chunks_of(text, 15)
            if len(parts) < 3:
                continue
            merged = merge([Chunk(c, language) for c in parts])
            for _ in range(4):
                some = [Chunk(c, language) for c in parts]
                while len(some) > 1:
                    i = rng.randrange(len(some) - 1)
                    some[i : i + 2] = [Chunks(some[i], some[i + 1])]
                for mode in LEXERS[language][2]:
                    a, b = merged.run(mode), some[0].run(mode)
                    assert bool(a.fault) == bool(b.fault) and (a.fault or a == b), (language, text, mode)


@pytest.mark.parametrize(("language", "head", "tail"), [("rust", "fn f() { let x = ", "; }"), ("go", "package a\nvar x = ", "\n"), ("javascript", "x = ", ";"), ("typescript", "x = ", ";"), ("tsx", "x = ", ";"), ("python", "x = ", "\n")])
def test_depth_is_no_fault(language, head, tail):
    n = 10_000
    text = head + "(" * n + "1" + ")" * n + tail
    assert fault_of(text, language) is None
    assert fault_of(text.replace(")", "", 1), language) is not None and fault_of(text.replace("1", "1 1"), language) is not None


def test_parts_of_python():
    n = 300
    for inner in ("a=1", "*b", "i for i in c", "lambda: (yield)", "d := 2"):
        assert fault_of("f(" * n + inner + ")" * n, "python") is None, inner
    assert fault_of("x" + "[" * n + "1:2" + "]" * n, "python") is not None and fault_of("x[" * n + "1:2" + "]" * n, "python") is None
    assert fault_of("x = " + "{1: [" * n + "]}" * n + "\nif (y):\n    pass\n", "python") is None
    assert fault_of("x = " + "1 + " * 200_000 + "1", "python") is None


def test_language():
    assert [language_of(p) for p in ("a/b.RS", "x.Tsx", "y.jsx", "z.md", "none", None, "a.py")] == ["rust", "tsx", "javascript", None, None, None, "python"]


def test_files(spark):
    rows = [(1, "r", "a.rs", "fn f() {}"), (2, "r", "b.RS", "fn f() {"), (2, "r", "b.RS", "fn f() {"), (3, "r", "c.md", "{"), (4, "s", "d.go", None), (5, "s", "e.go", ""), (6, "s", None, "x"), (None, "s", "f.go", "x"),
            (7, "s", "big.rs", "/* { */ fn f() { g(); }\n" * 9_000), (8, "s", "big2.rs", "fn f() { g(); }\n" * 9_000 + "}")]
    files = spark.createDataFrame(rows, "file_id long, repo string, path string, source string").selectExpr("*", "'x' AS language", "1 AS chunk")
    faults = {r["file_id"]: r["fault"] for r in file_faults(files).collect()}
    assert set(faults) == {1, 2, 4, 5, 7, 8} and {k for k, v in faults.items() if v} == {2, 8}
    assert {r["file_id"]: bool(r["fault"]) for r in file_faults(files, chunk=900, spread=20_000).collect()} == {k: bool(v) for k, v in faults.items()}
    rates = {(r["repo"], r["language"]): (r["files"], r["invalid"], r["share"]) for r in fault_rates(files, file_faults(files)).collect()}
    assert rates == {("r", "rust"): (2, 1, 0.5), ("s", "go"): (2, 0, 0.0), ("s", "rust"): (2, 1, 0.5)}
    assert file_faults(files.limit(0)).count() == 0


def test_chunk_borders_decide_nothing():
    icon = """export const Icon = () => (
  <svg
    d="M0 0
L10 10
Z <"
  >
    <b>{`x
${[1,
2].map((n) => <i key={n}>it's</i>)}`}</b>
  </svg>
);
"""
    long = """const a = "one \\
 two } \\
 three";
const r = [1
/ 2, 3 / 4];
function f() {
  return `a
${{ b: `c
}` }.b}`;
}
"""
    for text, language in ((icon, "javascript"), (icon, "tsx"), (long, "javascript"), (long, "typescript"), (long, "tsx")):
        for broken in (text, text + "}\n", text.replace("(", "((", 1), text + "`\n"):
            whole = fault_of(broken, language) is None
            assert whole == (broken == text), (language, broken, fault_of(broken, language))
            for size in (1, 5, 12, 30, 60):
                assert (fault_of(broken, language, size) is None) == whole, (language, size, broken)
