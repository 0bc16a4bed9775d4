"""Which signs are markup, and what is left of marked texts."""

from __future__ import annotations

import pytest

from tessellar.llm.markup import clean_text, parse, parse_nodes, path_ratios, with_markup

MARKED = [
    "# Title", "## Title ##", "Title\n=====", "- one\n- two", "1. one\n2. two", "- [ ] todo", "> quoted", "```sh\nrun\n```", "~~~\nrun\n~~~", "use `this` now", "a **bold** word",
    "an *emphatic* word", "an _emphatic_ word", "~~gone~~", "[text](a.md)", "![alt](a.png)", "[text][1]", "[1]: a.md", "note[^2]", "<https://a.invalid/x>", "| a | b |\n|---|---|\n| 1 | 2 |",
    "***", "[[page|label]]", "![[page#part]]", "{{name|x=1}}", "== Title ==", "'''b''' and ''i''", "{| class=x\n|-\n| a || b\n|}", ":: deep", "; term : text", "__TOC__", "done --~~~~",
    "[https://a.invalid label]", "{code}x{code}", "{color:red}x{color}", "h2. Title", "<nowiki>x</nowiki>", "<p>text</p>", "<br/>", "text <b>bold</b>", "<TABLE><TR><TD>x</TABLE>", "a &amp; b", "&#8212;",
    "&#x2192;", "<!-- note -->", "<div\n class='a' data-x=\"b > c\">x</div>", "\\section{Title}", "\\textbf{x}", "\\begin{itemize}\n\\item x\n\\end{itemize}", "$x_{1}^2 \\leq 3$", "$$ a = b $$", "\\[ a \\]",
    "where \\(d < 2\\)", "see~\\cite{a}", "at 16\\% load", "``quoted text'' here", 'word href="a.html">label</a> more', "one</li><li>two", "see [label «hit»](a", "a **bold start", "{{name|cut", "<td class=\"x",
]
PLAIN = [
    "a < b and c > 4", "Press <Enter> twice.", "Vec<u8> and Map<u32, T>", "The arrow <- points; => does not.", "R&D wants more", "85 KB & 21 KB", "x <= 1, y != 2", "It stops if a == b or c != d.",
    "costs $5 now and $12 later", "Set $HOME/x and keep ~/y.", "{x} stays", "The regex \\w+\\.md finds 3.", "C:\\work\\item on the box", "src/*.rs and docs/*.md", "2 * 25 * 4 cells", "f(x) = x^2 is a sketch",
    "See issue #97 for it.", "#topic is a channel", "The C# port", "a[0] and b[12]", "See RFC [20] and the memo [sic].", '"a" | "b" when c >= 3', "1) one 2) two 3) stop.", "rename a_id and b_key", "x::y() and z.w()",
    "The range is 5 -- 9.", "Map a -> b -> c.", "about ~30 percent", "word - roughly so", "ops(at)vault", "the «hit» here … ", "", "don't, it's", "a:b:c 12:30",
]


@pytest.mark.parametrize("text", MARKED)
def test_marked(text):
    assert any(n[0] != "text" for n in parse(text)), text


@pytest.mark.parametrize("text", PLAIN)
def test_plain(text):
    assert [n[0] for n in parse(text)] == (["text"] if text else [])


CUT = [
    ("one *emphatic start", "emphasis"), ("one *«emphatic» start … ", "emphasis"), ("one _emphatic start …", "emphasis"), ("… emphatic end* and more", "emphasis"), (" … the «emphatic» end_ and more", "emphasis"),
    ("now ~~gone", "strike"), ("now ~~«gone» for …", "strike"), ("… long gone~~ and more", "strike"), ("gone~~ and more", "strike"),
    ("more&nbs", "entity"), ("more &am …", "entity"), ("more &#82", "entity"), ("nbsp;more", "entity"), ("… bsp; more", "entity"), ("#8212; more", "entity"), ("…amp; more", "entity"),
]
UNCUT = ["copy; then paste", "ash; then dust", "the R&D", "Sizes: 83 KB &", "Q&A …", "call _flush before exit", "passes *args on", "the A* search", "matches foo* and bar", "a trailing_ name", "keeps *.md files", "set *p to 0", "9 * 4 …"]


@pytest.mark.parametrize(("text", "kind"), CUT)
def test_pieces_cut_off_at_an_edge(text, kind):
    nodes = parse(text)
    assert [n[2] for n in nodes if n[0] != "text"][:1] and any(kind in n[0] for n in nodes), nodes
    assert not any(sign in n[3] for n in nodes for sign in ("*", "~~", "&", "_", ";")) or kind == "entity"


@pytest.mark.parametrize("text", UNCUT)
def test_plain_signs_at_an_edge(text):
    assert [n[0] for n in parse(text)] == ["text"]


CLEAN = {
    "<h2>Title</h2>\n<p>One <b>bold</b> &amp; more.</p>": "## Title\n\nOne bold & more.",
    "- a\n- b **c**": "- a\n- b c",
    "```py\nx = 1\n```": "```py\nx = 1\n```",
    "See [the page](a.md) for $x_{1}$.": "See the page for $x_{1}$.",
    "\\section{Part}\nText~\\cite{k}.": "## Part\n\nText.",
    "text <script>var a = 1;</script> more": "text  more",
    "a < b": "a < b",
    "# Plan\n\nFirst *do* this:\n\n1. one\n2. two\n   - deep\n\n```sh\nls\n```\n\nso $$ E = mc^2 $$ holds": "# Plan\n\nFirst do this:\n\n1. one\n2. two\n  - deep\n\n```sh\nls\n```\n\nso\n$$ E = mc^2 $$\n holds",
    "== Part ==\n* ''one''\n* [[page|two]]\n{| class=x\n|-\n| a || b\n|}": "## Part\n\n- one\n- two\n\na | b",
    "<ul><li>one<ul><li>two <code>x</code></li></ul></li></ul><pre>a\n  b</pre>": "- one\n- two x\n\n```\na\n  b\n```",
    "\\begin{itemize}\n\\item x\n\\item \\textbf{y}\n\\end{itemize}\n\\[ a^2 \\]": "- x\n- y\n\n$$ a^2 $$",
    "| a | b |\n|---|---|\n| 1 | 2 |": "a | b\n1 | 2",
}


def test_clean(spark):
    filler = [(100 + i, f"Plain sentence number {i}, nothing else. It goes on; it ends.") for i in range(20)]
    rows = [(i, t) for i, t in enumerate(CLEAN)] + [(50, None), (51, ""), (52, "x " * 30_000 + "<b>y</b>"), (0, next(iter(CLEAN)))] + filler
    out = clean_text(spark.createDataFrame(rows, "id long, body string").selectExpr("*", "1 AS nodes", "2 AS path"), ["id"], "body").collect()
    assert len(out) == len(rows)
    got = {r["id"]: r["clean"] for r in out}
    for i, want in enumerate(CLEAN.values()):
        assert got[i].replace("\n\n\n", "\n\n") == want, (i, got[i])
    assert got[50] is None and got[51] == "" and got[52].endswith("y") and "<b>" not in got[52]


def test_found_and_ratios(spark):
    rows = spark.createDataFrame([(1, "a <b>c</b>"), (1, "a <b>c</b>"), (2, "plain"), (3, None)], "id long, body string")
    assert [r["id"] for r in with_markup(rows, ["id"], "body").collect()] == [1]
    ratios = {r["path"]: r for r in path_ratios(parse_nodes(rows, ["id"], "body")).collect()}
    assert ratios["text"]["content"] and ratios["html/b"]["content"] and ratios["html/b"]["markup"] and not ratios["text"]["markup"]
    empty = spark.createDataFrame([], rows.schema)
    assert with_markup(empty, ["id"], "body").count() == 0 and clean_text(empty, ["id"], "body").count() == 0


def test_paths_are_of_a_fixed_vocabulary():
    deep = parse("<div>" * 300 + "<ul><li>" * 300 + "<p>said" + "{{Infobox|alpha_1=foo|beta_2=bar}}")
    assert {n[0] for n in deep} <= {"html/div", "html/div/ul", "html/div/ul/li", "html/div/li/ul", "html/div/ul/li/p", "html/div/li/ul/p", "html/div/ul/li/p/wiki/template/name", "html/div/ul/li/p/wiki/template/named"} | {n[0] for n in deep if "alpha" not in n[0]}
    assert not any("alpha" in n[0] for n in deep) and all(len(n[0].split("/")) < 12 for n in deep)


def test_boilerplate_is_dropped_by_its_ratios(spark):
    body = "<p>" + "A sentence that says something, and then more of it. " * 6 + "</p>"
    rows = [(i, f"<nav><a href='/'>Home</a></nav><h2>Part</h2>{body}<footer>Up</footer><ul><li>one</li></ul>") for i in range(30)] + [(99, "Plain words. " * 9)]
    got = {r["id"]: r["clean"] for r in clean_text(spark.createDataFrame(rows, "id long, body string"), ["id"], "body").collect()}
    assert "A sentence that says" in got[3] and "## Part" in got[3] and "- one" in got[3] and got[99].startswith("Plain words.")
    assert "Up" not in got[3]
