"""Symbols, imports and references of small programs in each language."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessellar.operators.code import facts, graph
from tessellar.session import cut

# Each case: files of a small program, the file and name of a symbol, and how often other files use it.
# A use is a name in a place where a value or type is read, and a line that passes the name on.
OVEN = "pub mod oven;\npub mod menu;\npub mod till;\n"
BREAD = ("src/oven.rs", "pub struct Loaf {\n    pub grams: u32,\n}\n\npub fn bake(grams: u32) -> Loaf {\n    Loaf { grams }\n}\n\npub trait Crust {\n    fn thick(&self) -> bool;\n}\n")
LIB = ("src/lib.rs", OVEN)
GOMOD = ("go.mod", "module tides.example/harbour\n\ngo 1.22\n")
BUOY = ("sea/buoy.go", "package sea\n\ntype Buoy struct {\n\tDepth int\n}\n\nfunc Moor(depth int) *Buoy {\n\treturn &Buoy{Depth: depth}\n}\n\nvar Limit = 40\n")
KILN = ("pottery/kiln.ts", "export function fire(cone: number) {\n  return cone * 2;\n}\nexport class Glaze {\n  shade = 'celadon';\n}\nexport interface Batch {\n  pieces: number;\n}\nexport const shelves = { top() {}, low() {} };\n")
ORBIT = ("orbit.py", "def transfer(a, b):\n    return a + b\n\n\nclass Probe:\n    pass\n\n\ndef logged(f):\n    return f\n")
CASES = {
    "rust: two calls after one import": ([LIB, BREAD, ("src/till.rs", "use crate::oven::bake;\n\npub fn morning() {\n    let first = bake(500);\n    let second = bake(750);\n    drop((first, second));\n}\n")], "src/oven.rs", "bake", 2),
    "rust: a list of names, one of them unused": ([LIB, BREAD, ("src/till.rs", "use crate::oven::{bake, Crust, Loaf};\n\npub fn weigh(l: &Loaf) -> u32 {\n    l.grams + bake(1).grams\n}\n")], "src/oven.rs", "Loaf", 1),
    "rust: another name for it": ([LIB, BREAD, ("src/till.rs", "use crate::oven::Loaf as Item;\n\npub fn cheapest(a: Item, b: Item) -> Item {\n    if a.grams < b.grams { a } else { b }\n}\n")], "src/oven.rs", "Loaf", 3),
    "rust: passed on by a menu": ([LIB, BREAD, ("src/menu.rs", "pub use crate::oven::Loaf;\n"), ("src/till.rs", "use crate::menu::Loaf;\n\npub fn sell(l: Loaf) -> u32 {\n    l.grams\n}\n")], "src/oven.rs", "Loaf", 2),
    "rust: passed on twice under a new name": ([("src/lib.rs", OVEN + "pub mod shop;\n"), BREAD, ("src/menu.rs", "pub use crate::oven::bake as cook;\n"), ("src/shop.rs", "pub use crate::menu::cook;\n"), ("src/till.rs", "use crate::shop::cook;\n\npub fn noon() {\n    cook(3);\n}\n")], "src/oven.rs", "bake", 3),
    "rust: everything of a module": ([LIB, BREAD, ("src/till.rs", "use crate::oven::*;\n\npub fn stock() -> Vec<Loaf> {\n    vec![bake(2)]\n}\n")], "src/oven.rs", "Loaf", 1),
    "rust: behind the name of its module": ([LIB, BREAD, ("src/till.rs", "use crate::oven;\n\npub struct Roll;\n\nimpl oven::Crust for Roll {\n    fn thick(&self) -> bool {\n        oven::bake(9).grams > 4\n    }\n}\n")], "src/oven.rs", "Crust", 1),
    "rust: in generics and in bounds": ([LIB, BREAD, ("src/till.rs", "use crate::oven::Crust;\n\npub fn any<C: Crust>(x: Option<Box<dyn Crust>>, y: C) -> bool {\n    y.thick() && x.is_some()\n}\n")], "src/oven.rs", "Crust", 2),
    "rust: a name in a comment or text is no use": ([LIB, BREAD, ("src/till.rs", "use crate::oven::bake;\n\n// bake is called later\npub fn label() -> &'static str {\n    \"bake\"\n}\n")], "src/oven.rs", "bake", 0),
    "rust: from another crate of the workspace": ([("grain/Cargo.toml", '[package]\nname = "stone-mill{k}"\n'), ("grain/src/lib.rs", "pub mod flour;\n"), ("grain/src/flour.rs", "pub fn grind() {}\n"), ("bakery/src/main.rs", "use stone_mill{k}::flour::grind;\n\nfn main() {\n    grind();\n    grind();\n}\n")], "grain/src/flour.rs", "grind", 2),
    "ts: two names of one list": ([KILN, ("pottery/wheel.ts", "import { fire, Glaze } from './kiln';\n\nconst coat = new Glaze();\nexport const done = [fire(6), fire(10), coat];\n")], "pottery/kiln.ts", "fire", 2),
    "ts: another name for it": ([KILN, ("pottery/wheel.ts", "import { Glaze as Finish } from './kiln';\n\nexport function dip(f: Finish): Finish {\n  return f;\n}\n")], "pottery/kiln.ts", "Glaze", 2),
    "ts: all under one name": ([KILN, ("pottery/wheel.ts", "import * as kiln from './kiln';\n\nexport const hot = kiln.fire(kiln.fire(1));\n")], "pottery/kiln.ts", "fire", 2),
    "ts: the default export under any name": ([("pottery/clay.ts", "export default class Stoneware {\n  grog = 3;\n}\n"), ("pottery/wheel.ts", "import Body from './clay';\n\nexport const lump = new Body();\n")], "pottery/clay.ts", "Stoneware", 1),
    "ts: types only": ([KILN, ("pottery/wheel.ts", "import type { Batch } from './kiln';\n\nexport const sizes = (b: Batch, c?: Batch): number => b.pieces;\n")], "pottery/kiln.ts", "Batch", 2),
    "ts: members of a value": ([KILN, ("pottery/wheel.ts", "import { shelves } from './kiln';\n\nshelves.top();\nshelves.low();\nshelves.top();\n")], "pottery/kiln.ts", "shelves", 3),
    "ts: passed on by name": ([KILN, ("pottery/index.ts", "export { Glaze } from './kiln';\n"), ("shop.ts", "import { Glaze } from './pottery';\n\nexport const g = new Glaze();\n")], "pottery/kiln.ts", "Glaze", 2),
    "ts: passed on whole, through two folders": ([KILN, ("pottery/index.ts", "export * from './kiln';\n"), ("index.ts", "export * from './pottery';\n"), ("shop.ts", "import { fire } from '.';\n\nfire(4);\n")], "pottery/kiln.ts", "fire", 1),
    "ts: a default passed on under a name": ([("pottery/clay.ts", "export default function wedge() {}\n"), ("pottery/index.ts", "export { default as knead } from './clay';\n"), ("shop.ts", "import { knead } from './pottery/index';\n\nknead();\nknead();\n")], "pottery/clay.ts", "wedge", 3),
    "js: required with braces": ([("loom.js", "function weave() {}\nfunction spin() {}\nmodule.exports = { weave, spin };\n"), ("mill.js", "const { spin } = require('./loom');\n\nspin(spin());\n")], "loom.js", "spin", 2),
    "tsx: as an element that closes itself": ([("ui/lamp.tsx", "export function Lamp() {\n  return null;\n}\n"), ("ui/room.tsx", "import { Lamp } from './lamp';\n\nexport const Room = () => (\n  <section>\n    <Lamp />\n    <Lamp key={2} />\n  </section>\n);\n")], "ui/lamp.tsx", "Lamp", 2),
    "tsx: both tags of an element count": ([("ui/frame.tsx", "export const Frame = () => null;\n"), ("ui/room.tsx", "import { Frame } from './frame';\n\nexport function Wall() {\n  return <Frame>a picture of a Frame</Frame>;\n}\n")], "ui/frame.tsx", "Frame", 2),
    "tsx: inside an expression and an attribute": ([("ui/knob.tsx", "export const Brass = () => null;\nexport const Steel = () => null;\n"), ("ui/door.tsx", "import { Brass, Steel } from './knob';\n\nexport const Door = ({ old }) => <div title={String(Steel)}>{old ? <b>{Brass}</b> : Steel}</div>;\n")], "ui/knob.tsx", "Steel", 2),
    "ts: a package of the workspace by its name": ([("dye/package.json", '{"name": "@loft{k}/dye", "main": "./lib/vat.ts"}'), ("dye/lib/vat.ts", "export function steep() {}\n"), ("app/run.ts", "import { steep } from '@loft{k}/dye';\n\nsteep();\n")], "dye/lib/vat.ts", "steep", 1),
    "ts: a file inside such a package": ([("dye/package.json", '{"name": "@loft{k}/dye"}'), ("dye/src/madder.ts", "export const red = 1;\n"), ("app/run.ts", "import { red } from '@loft{k}/dye/madder';\n\nexport const twice = red + red;\n")], "dye/src/madder.ts", "red", 2),
    "ts: a path that the configuration maps": ([("tsconfig.json", '{\n  // where things are\n  "compilerOptions": {"baseUrl": ".", "paths": {"~loom{k}/*": ["weaving/*"],}}\n}'), ("weaving/warp.ts", "export function thread() {}\n"), ("app/run.ts", "import { thread } from '~loom{k}/warp';\n\nthread();\n")], "weaving/warp.ts", "thread", 1),
    "py: a name, called twice": ([ORBIT, ("mission.py", "from orbit import transfer\n\nleg = transfer(1, 2)\nback = transfer(leg, 0)\n")], "orbit.py", "transfer", 2),
    "py: behind its module": ([ORBIT, ("mission.py", "import orbit\n\nx = orbit.transfer(1, 2)\ny = orbit.Probe()\n")], "orbit.py", "Probe", 1),
    "py: another name for the module": ([ORBIT, ("mission.py", "import orbit as mechanics\n\nprint(mechanics.transfer(3, 4))\n")], "orbit.py", "transfer", 1),
    "py: another name for it": ([ORBIT, ("mission.py", "from orbit import Probe as Craft\n\nfleet = [Craft(), Craft(), Craft()]\n")], "orbit.py", "Probe", 3),
    "py: everything of a module": ([ORBIT, ("mission.py", "from orbit import *\n\n\nclass Lander(Probe):\n    pass\n")], "orbit.py", "Probe", 1),
    "py: everything but what the list leaves out": ([("fuel.py", "__all__ = ['burn']\n\n\ndef burn():\n    pass\n\n\ndef vent():\n    pass\n"), ("mission.py", "from fuel import *\n\nburn()\nvent()\n")], "fuel.py", "vent", 0),
    "py: passed on by a package": ([("crew/__init__.py", "from .pilot import steer\n"), ("crew/pilot.py", "def steer():\n    pass\n"), ("mission.py", "from crew import steer\n\nsteer()\nsteer()\n")], "crew/pilot.py", "steer", 3),
    "py: from a sister module and from the package above": ([("crew/__init__.py", ""), ("crew/pilot.py", "def steer():\n    pass\n"), ("crew/deck/__init__.py", ""), ("crew/deck/helm.py", "from ..pilot import steer\n\nsteer()\n"), ("crew/mate.py", "from .pilot import steer\n\nsteer()\n")], "crew/pilot.py", "steer", 2),
    "py: as a decorator and in annotations": ([ORBIT, ("mission.py", "from orbit import Probe, logged\n\n\n@logged\ndef track(p: Probe) -> Probe:\n    return 'logged'\n")], "orbit.py", "Probe", 2),
    "py: a root that the project declares": ([("lab/pyproject.toml", '[tool.setuptools.packages.find]\nwhere = ["code"]\n'), ("lab/code/optics{k}/lens.py", "def focus():\n    pass\n"), ("bench/run.py", "from optics{k}.lens import focus\n\nfocus()\n")], "lab/code/optics{k}/lens.py", "focus", 1),
    "py: a module that the project includes": ([("lab/pyproject.toml", '[tool.poetry]\npackages = [{ include = "prism", from = "parts" }]\n'), ("lab/parts/prism{k}.py", "def split():\n    pass\n"), ("bench/run.py", "import prism{k}\n\nprism{k}.split()\nprism{k}.split()\n")], "lab/parts/prism{k}.py", "split", 2),
    "go: behind its package": ([GOMOD, BUOY, ("dock/main.go", 'package main\n\nimport "tides.example/harbour/sea"\n\nfunc main() {\n\tb := sea.Moor(sea.Limit)\n\tprintln(b.Depth, sea.Limit)\n}\n')], "sea/buoy.go", "Limit", 2),
    "go: another name for the package": ([GOMOD, BUOY, ("dock/main.go", 'package main\n\nimport water "tides.example/harbour/sea"\n\nfunc main() {\n\t_ = []*water.Buoy{water.Moor(1)}\n}\n')], "sea/buoy.go", "Buoy", 1),
    "go: the package's names as one's own": ([GOMOD, BUOY, ("dock/main.go", 'package main\n\nimport . "tides.example/harbour/sea"\n\nfunc main() {\n\t_ = Moor(2)\n}\n')], "sea/buoy.go", "Moor", 1),
    "go: one of several imports, in a literal": ([GOMOD, BUOY, ("dock/main.go", 'package main\n\nimport (\n\t"fmt"\n\t"tides.example/harbour/sea"\n)\n\nfunc main() {\n\tfmt.Println(sea.Buoy{Depth: 3})\n}\n')], "sea/buoy.go", "Buoy", 1),
    "go: a module that lies where the workspace puts it": ([("go.work", "go 1.22\n\nuse ./dock\n\nreplace (\n\tcharts.example/m{k}/tide v1.2.0 => ./vendored/tide\n)\n"), ("vendored/tide/table.go", "package tide\n\nfunc High() int {\n\treturn 7\n}\n"), ("dock/go.mod", "module dock.example/d{k}\n"), ("dock/main.go", 'package main\n\nimport "charts.example/m{k}/tide"\n\nfunc main() {\n\tprintln(tide.High() + tide.High())\n}\n')], "vendored/tide/table.go", "High", 2),
    "ts: a part that the package exports": ([("dye/package.json", '{"name": "@loft{k}/dye", "exports": {".": "./lib/vat.ts", "./roots": {"types": "./lib/madder.ts"}, "./blue/*": "./lib/blues/*.ts"}}'), ("dye/lib/madder.ts", "export const red = 1;\n"), ("app/run.ts", "import { red } from '@loft{k}/dye/roots';\n\nexport const one = red;\n")], "dye/lib/madder.ts", "red", 1),
    "ts: a part behind a star of the exports": ([("dye/package.json", '{"name": "@loft{k}/dye", "exports": {"./blue/*": "./lib/blues/*.ts"}}'), ("dye/lib/blues/woad.ts", "export function soak() {}\n"), ("app/run.ts", "import { soak } from '@loft{k}/dye/blue/woad';\n\nsoak();\nsoak();\n")], "dye/lib/blues/woad.ts", "soak", 2),
    "go: a file of the same package": ([GOMOD, BUOY, ("sea/chart.go", "package sea\n\nfunc plot(b *Buoy) []Buoy {\n\treturn []Buoy{*Moor(b.Depth)}\n}\n")], "sea/buoy.go", "Buoy", 3),
}


@pytest.fixture(scope="module")
def rows(spark):
    """All programs at once, each in a directory of its own."""
    files = []
    for k, (program, *_) in enumerate(CASES.values()):
        # The module of each Go program lies in its own directory; its import paths stay as they are, so it gets its own name.
        files += [(f"c{k}/{p}".replace("{k}", str(k)), c.replace("tides.example/harbour", f"tides.example/harbour{k}").replace("{k}", str(k))) for p, c in program]
    table = spark.createDataFrame(files, "path string, content string")
    return {(r["target_file"], r["symbol"], r["source_file"], r["line"], r["col"]): r["is_definition"] for r in graph.references(table, facts.extract(table)).collect()}


@pytest.mark.parametrize("k", range(len(CASES)), ids=list(CASES))
def test_references(rows, k):
    _, target, symbol, uses = list(CASES.values())[k]
    hits = {key: d for key, d in rows.items() if key[:2] == (f"c{k}/{target}".replace("{k}", str(k)), symbol)}
    assert (sum(hits.values()), sum(not d for d in hits.values())) == (1, uses), hits


@pytest.mark.parametrize("case", ["rust: passed on twice under a new name", "go: a file of the same package", "py: everything of a module"])
def test_references_to_one_file(spark, case):
    program, target, symbol, uses = CASES[case]
    table = spark.createDataFrame([*program, ("other/x.py", "import nothing\n")], "path string, content string")
    got = graph.references(table, facts.extract(table), target).where(F.col("symbol") == symbol).collect()
    assert sorted(r["is_definition"] for r in got) == [False] * uses + [True] and {r["target_file"] for r in got} == {target}


def test_symbols_of_text():
    get = lambda path, text: {(s[0], s[1], s[2], s[3], s[4], s[5], s[6]) for s in facts.facts_of(path, text, facts.language_of(path)).symbols}
    rust = "/// doc\n#[inline]\npub async fn a() {}\npub trait T {\n    fn b(&self);\n}\nimpl<X> fmt::Display for A<X> {\n    pub(crate) fn c() { fn d() {} }\n}\nmacro_rules! m { () => {}; }\nmod x;\nconst N: [u8; 2] = [1, 2];\nenum E { V }\n"
    assert {("a", None, "fn", "pub async fn", 3, 3, True), ("T", None, "trait", "pub trait", 4, 6, True), ("b", "T", "fn", "fn", 5, 5, True), ("c", "A", "fn", "pub(crate) fn", 8, 8, True), ("m", None, "macro", "macro_rules!", 10, 10, False), ("N", None, "const", "const", 12, 12, False), ("E", None, "enum", "enum", 13, 13, False)} <= get("a.rs", rust)
    ts = "export default class A<T> {\n  private x = 1;\n  static async m(): void {\n    const inner = 1;\n  }\n  get y() { return 1; }\n  constructor() {}\n}\nexport type F = { a: number };\nlet v = () => {\n  const w = 2;\n};\n"
    found = get("a.ts", ts)
    assert {("A", None, "class", "export default class", 1, 8, True), ("m", "A", "fn", "", 3, 5, True), ("y", "A", "getter", "get", 6, 6, True), ("x", "A", "property", "", 2, 2, False), ("constructor", "A", "constructor", "", 7, 7, True), ("v", None, "variable", "let", 10, 12, False)} <= found
    assert not {"inner", "w"} & {s[0] for s in found}
    py = "class A:\n    '''doc\n\ntext\n    '''\n    @property\n    def b(self):\n        return [\n1]\n\n    def __init__(self):\n        pass\n\nasync def _c():\n    pass\nN = (1,\n2)\n"
    assert get("a.py", py) == {("A", None, "class", "class", 1, 12, True), ("b", "A", "getter", "def", 6, 9, True), ("__init__", "A", "constructor", "def", 11, 12, False), ("_c", None, "fn", "async def", 14, 15, False), ("N", None, "variable", "", 16, 17, True)}
    go = "package a\n\ntype (\n\tX struct{}\n\ty interface{}\n)\n\nfunc (r *X[T]) M() int {\n\treturn 1\n}\nvar a, B = 1, 2\n"
    assert {("X", None, "struct", "type struct", 4, 4, True), ("y", None, "interface", "type interface", 5, 5, False), ("M", "X", "fn", "func", 8, 10, True), ("a", None, "variable", "var", 11, 11, False), ("B", None, "variable", "var", 11, 11, True)} <= get("a.go", go)


def test_selectors_and_bodies(spark):
    files = spark.createDataFrame([("a.rs", "// top\nfn x() {}\n\nimpl A {\n    /// doc\n    fn b() {\n    }\n}\n"), ("b.md", "# x"), ("c.py", None), (None, "x")], "path string, content string")
    every = graph.symbols(facts.extract(files))
    assert [r["name"] for r in graph.selected(every, "A::b()").collect()] == ["b"] and graph.selected(every, "x").count() == 1
    assert graph.selected(every, "A.b", dotted=False).count() == 0
    with pytest.raises(ValueError, match="bad selector"):
        graph.selected(every, "A::")
    got = {r["name"]: r["body"] for r in graph.bodies(files, "content", every).collect()}
    assert got == {"x": "// top\nfn x() {}", "b": "/// doc\n    fn b() {\n    }"}
    empty = files.limit(0)
    assert graph.references(empty, facts.extract(empty)).count() == 0


def test_closure(spark):
    files = spark.createDataFrame([("a.py", "x = 1"), ("b.py", "from a import x"), ("c.py", "import b"), ("d.py", "import c"), ("p/__init__.py", "from a import x"), ("e.py", "from p import x"), ("f.py", "import e")], "path string, content string")
    imports = graph.resolve_imports(facts.extract(files), files)
    assert {tuple(r) for r in graph.deps(imports).collect()} == {("b.py", "a.py"), ("c.py", "b.py"), ("d.py", "c.py"), ("p/__init__.py", "a.py"), ("e.py", "p/__init__.py"), ("f.py", "e.py")}
    exports = graph.passed_on(imports, facts.extract(files))
    assert {r["path"] for r in graph.importer_closure(imports, exports, "a.py").collect()} == {"a.py", "b.py", "p/__init__.py", "e.py"}
    assert imports.where(F.col("target").isNull()).count() == 0


def test_long_chains_of_passed_on_names_are_followed_to_the_end(spark):
    n = 53
    exports = spark.createDataFrame([(f"f{i}", "x", f"f{i + 1}", "x") for i in range(n)] + [("loop", "y", "pool", "y"), ("pool", "y", "loop", "y")], "path string, exported string, target string, definition string")
    names = spark.createDataFrame([(f"f{n}", "x")], "path string, name string")
    asked = spark.createDataFrame([("f0", "x"), ("loop", "y")], "target string, definition string")
    assert [tuple(r) for r in graph.follow(asked, names, exports).select("target", "definition", "file", "name").collect()] == [("f0", "x", f"f{n}", "x")]


def test_no_table_is_broadcast_by_its_estimate(spark, monkeypatch, tmp_path):
    """Estimates count compressed files and one element an array, so tables far beyond the driver's memory look small."""
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(graph, "cut", lambda df: cut(seen(df)))
    programs = ["rust: passed on twice under a new name", "ts: a package of the workspace by its name", "go: a file of the same package", "py: everything of a module"]
    # Read from a file, as only then there is an estimate.
    spark.createDataFrame([(f"p{k}/{p}", c) for k, case in enumerate(programs) for p, c in CASES[case][0]], "path string, content string").write.parquet(str(tmp_path / "files"))
    table = spark.read.parquet(str(tmp_path / "files"))
    for target in (None, "p2/sea/buoy.go"):
        rows = seen(graph.references(table, facts.extract(table), target))
        assert rows.where("NOT is_definition").count() > 0
    assert sum("Join" in p for p in plans) > 10 and not [p for p in plans if "Broadcast" in p]


def test_facts_of_many_files_are_put_together_in_small_frames():
    files = [(f"f{i}.py", f"import os\nx{i} = os.sep\n" * 20) for i in range(200)] + [("a.md", "# x"), (None, "x"), ("empty.py", None)]
    frames = list(facts.fact_frames([pd.DataFrame(files, columns=["path", "content"])], characters=2_000))
    assert [p for f in frames for p in f["path"]] == [p for p, _ in files if p and p.endswith(".py")]
    assert max(len(f) for f in frames) <= 5 and list(facts.fact_frames([pd.DataFrame(files[200:202], columns=["path", "content"])])) == []


def test_only_uses_that_may_lead_outside_are_kept():
    def kept(path, text):
        f = facts.facts_of(path, text, language := facts.language_of(path))
        return {u[0] for u in f.uses}, {u[0] for u in facts.outward(f, language)}

    every, outside = kept("a.py", "from b import c\n\ndef own():\n    pass\n\nown(c, other)\n")
    assert {"own", "c", "other"} <= every and outside == {"c"}
    assert kept("a.py", "from b import *\n\ndef own():\n    pass\n\nown(c)\n")[1] == {"c"}
    assert kept("a.go", 'package a\n\nimport "fmt"\n\nfunc own() {\n\tfmt.Println(other)\n\town()\n}\n')[1] == {"fmt", "other"}
    # A name of the file's own that an import binds too.
    assert kept("a.py", "from b import c\n\ndef c():\n    pass\n\nc()\n")[1] == {"c"}
