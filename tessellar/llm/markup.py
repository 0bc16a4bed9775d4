"""Clean text from HTML, Markdown, wiki and LaTeX markup, by tag-path ratios.

A text is parsed into a sequence of leaf nodes, each with its root-to-leaf tag path; plain text has
the path ``text``. Over all texts the length, the punctuation and the signs of markup per path are
aggregated to ratios, smoothed over neighbouring paths, fused and thresholded. Paths that signs of
markup belong to are markup: they tell which texts have any. The length and punctuation of paths
without what only decorates (their blocks) tell which nodes are content. The clean text of a row is
what its content nodes say, with headings, lists, code blocks and formulas marked plainly.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellar.session import cut, sized_broadcast

# Names that tell markup from signs in their plain meaning.
HTML_TAGS = (
    "a abbr address article aside b blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em fieldset figcaption figure font footer"
    " form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav nowiki ol option p pre q ref s samp script section select"
    " small source span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var video"
)
WIKI_MACROS = "code noformat quote panel color info note tip warning toc anchor expand section column"
#: LaTeX commands that stand without an argument.
LATEX_WORDS = (
    "item par newline newpage maketitle tableofcontents hline centering noindent alpha beta gamma delta epsilon theta lambda mu pi rho sigma tau phi omega cdot cdots ldots times"
    " div pm leq geq neq approx equiv sim infty sum prod int log ln exp sin cos tan lim min max to rightarrow leftarrow in notin subset cup cap forall exists partial nabla left"
    " right quad qquad bfseries itshape LaTeX TeX le ge ne"
)
#: Kinds of nodes that carry structure, and tags whose text has it; they stay whatever their ratios.
STRUCTURE = ("heading", "item", "code", "formula", "cell", "quote", "term", "break")
STRUCTURED = frozenset("text heading item code formula cell quote term li td th dd dt pre blockquote h1 h2 h3 h4 h5 h6".split())
#: Names that only decorate the text in them: it has the standing of the text around. So have the names of the languages.
INLINE = frozenset(
    "html markdown wiki latex strong emphasis strike link tag entity autolink escape command quotes word a abbr b cite del dfn em font i ins kbd label mark q s samp small span strike strong sub sup tt u var body br hr img nowiki cut p div section article main".split()
)
#: Share of signs of markup, smoothed and fused, from which a path is one of markup.
MARKED = 0.001

TAGS = "|".join(sorted(HTML_TAGS.split(), key=len, reverse=True))
ATTRIBUTE = r"""[A-Za-z_:@][\w:.-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?"""
VALUED = r"""[A-Za-z_:@][\w:.-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+)"""

#: Where the start of a piece may have been cut off: at the start of a text and after a cut sign.
FRONT = r"(?:\A|(?<=…)|(?<=…[ ]))"
#: Entities that are told by a part of their name, and ends of such names that are words by themselves.
COMMON_ENTITIES = "nbsp amp quot apos lt gt mdash ndash hellip laquo raquo lsquo rsquo ldquo rdquo rarr larr".split()
ENDS_IN_WORDS = ("ash", "dash", "lip", "quo", "arr", "squo", "dquo", "sh", "ip", "uo", "rr", "ot", "os")
# One alternative for each piece of markup, block forms first; (?m): ^ and $ are those of lines.
PIECES = [
    # Code that hides all other markup in it.
    ("fence", r"^[ \t]{0,3}(?P<fence_mark>`{3,}|~{3,})(?P<fence_info>[^`\n]*)(?:\n(?P<fence_body>(?:(?!^[ \t]{0,3}(?P=fence_mark))[^\n]*\n?)*)(?:^[ \t]{0,3}(?P=fence_mark)[`~]*[ \t]*$|\Z))?"),
    ("inline_fence", r"```+(?:\w+\b)?(?P<inline_fence_body>[^`\n]*)(?:```+)?"),
    ("verbatim", r"\\begin\{(?P<verbatim_name>verbatim|lstlisting|minted)\}(?:\[[^\]\n]*\])?\n?(?P<verbatim_body>(?:(?!\\end\{)[\s\S])*)(?:\\end\{(?P=verbatim_name)\}|\Z)"),
    ("macro_code", r"\{(?P<macro_name>code|noformat)(?::[^{}\n]*)?\}\n?(?P<macro_body>(?:(?!\{(?P=macro_name)\})[\s\S])*)\{(?P=macro_name)\}"),
    ("pre", r"(?i:<pre\b[^<>]*>)(?P<pre_body>[\s\S]*?)(?i:</pre\s*>|\Z)"),
    ("nowiki", r"(?i:<nowiki>)(?P<nowiki_body>[\s\S]*?)(?i:</nowiki>|\Z)"),
    # What a reader never sees.
    ("comment", r"<!--[\s\S]*?(?:-->|\Z)|(?<=\s)-->"),
    ("script", r"(?i:<(?P<script_name>script|style)\b[^<>]*>)[\s\S]*?(?i:</(?P=script_name)\s*>|\Z)"),
    ("doctype", r"<!(?i:doctype)\b[^<>]*>"),
    # Formulas.
    ("display", r"\$\$(?P<display_dollar>[\s\S]+?)\$\$|\\\[(?P<display_bracket>[\s\S]+?)(?:\\\]|\Z)|\\begin\{(?P<display_name>equation|align|gather|math|displaymath|eqnarray)\*?\}(?P<display_body>[\s\S]*?)(?:\\end\{(?P=display_name)\*?\}|\Z)"),
    ("math", r"\\\((?P<math_paren>[^\n]+?)(?:\\\)|\Z)|(?<![\w\\$])\$(?=[^\s$])(?P<math_dollar>(?:[^$\n]*?(?:\\[A-Za-z]|[_^]|[A-Za-z]\(|=)[^$\n]*?|[A-Za-z]))(?<=\S)\$(?![\w$])|(?<![\w\\$])\$(?P<math_cut>[A-Za-z]_\{[^$\n]*)\Z"),
    # Lines.
    ("table_rule", r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$\n?|^[ \t]*\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$\n?|\|(?:[ \t]*:?-{3,}:?[ \t]*\|)+"),
    ("rule", r"^[ \t]{0,3}(?:-[ \t]*){3,}$|^[ \t]{0,3}(?:\*[ \t]*){3,}$|^[ \t]{0,3}(?:_[ \t]*){3,}$"),
    ("atx", r"^[ \t]{0,3}(?P<atx_level>#{1,6})[ \t]+(?P<atx_title>[^\n]*?)(?:[ \t]+#+)?[ \t]*$|(?<!\S)#{2,6}(?=[ \t]+\S)|(?<!\S)#(?=[ \t]+[A-Z«])"),
    ("wiki_heading", r"^[ \t]*(?P<wiki_level>={1,6})[ \t]*(?P<wiki_title>[^\s=](?:[^\n]*?[^\s=])?)[ \t]*(?P=wiki_level)[ \t]*$|(?<!\S)(?P<flat_level>={2,6})[ \t]+(?P<flat_title>«?\w(?:[^=.…!?\n]{0,60}?\S)?)[ \t]+(?P=flat_level)(?!\S)"),
    ("jira_heading", r"(?:^[ \t]*|(?<!\S))h(?P<jira_level>[1-6])\.[ \t]+(?=[«A-Z])"),
    ("wiki_table", r"\{\|[^\n]*|^[ \t]*\|[-}][^\n]*|\|\}(?!\})"),
    ("wiki_header", r"^[ \t]*!(?=[ \t]*\S[^\n]*!!)(?P<wiki_header_cells>[^\n]*)$"),
    ("table_row", r"^[ \t]*\|(?P<row_cells>[^\n]*\|[^\n]*|[ \t]+[^\n|]+)$|(?<![\w\"'][ \t])\|(?P<flat_cells>[ \t]*«?\w[\w «»-]*»?[ \t]*\|)"),
    ("todo_item", r"(?P<todo_indent>^[ \t]*|(?<!\S))[-*+][ \t]+\[(?P<todo_done>[ xX])\](?=[ \t])"),
    ("item", r"^(?P<item_indent>[ \t]*)(?P<item_mark>[*#]{2,6}|[-*+•]|\d{1,9}\.)[ \t]+(?=\S)|^(?P<paren_indent>[ \t]*)\d{1,9}\)[ \t]+(?=[^\n]*\n[ \t]*\d{1,9}\)[ \t])|(?<=\n)[ \t]*\d{1,9}\)[ \t]+(?=\S)"),
    ("quote", r"^[ \t]{0,3}>(?:[ \t]*>)*[ \t]?(?=\S)"),
    ("definition", r"^[ \t]*(?P<term_mark>;+)[ \t]+(?P<term>[^\n:]*?)[ \t]+:[ \t]+|^[ \t]*(?P<indent_mark>:+)[ \t]+(?=\S)"),
    ("reference_definition", r"^[ \t]{0,3}\[(?P<reference_name>[^\]\n]+)\]:[ \t]*(?P<reference_rest>[^\n]*)$"),
    # Links and templates.
    ("wiki_link", r"!?\[\[(?P<wiki_link_body>[^\[\]\n]*)(?:\]\]|\Z)|(?<!\w)\[\[(?=[\w«])|(?<=[\w»])\]\](?!\])"),
    ("template", r"\{\{(?P<template_body>[^{}\n]*)(?:\}\}|\Z)|\{\{(?=[\w«])|(?<=[\w»])\}\}"),
    ("image", r"!\[(?P<image_alt>[^\]\n]*)\]\([^()\n]*(?:\)|\Z)"),
    ("link", r"(?<!\w)\[(?P<link_text>[^\[\]\n]*)\](?:\([^()\n]*(?:\)|\Z)|\[[^\[\]\n]*\])|\]\([^()\s]+(?:[ \t]+\"[^\"\n]*\")?\)?"),
    ("footnote", r"\[\^[^\]\s]+\]"),
    ("external", r"\[(?:https?|ftp|mailto):[^\s\]]+(?:[ \t]+(?P<external_text>[^\]\n]*))?\]"),
    ("open_link", r"(?<!\S)\[[\w«][^\[\]\n]*\Z"),
    ("autolink", r"<(?P<autolink_url>(?:https?|ftp)://[^\s<>]+|[\w.+-]+@[\w-]+\.[\w.-]+)>"),
    ("macro", rf"\{{(?:{'|'.join(WIKI_MACROS.split())})(?::[^{{}}\n]*)?\}}"),
    ("magic", r"(?<!\w)__[A-Z]{3,}__(?!\w)|(?:--)?~{3,5}(?=\s|\Z)"),
    # HTML.
    ("tag", rf"(?i:<(?P<close>/?)(?P<tag_name>{TAGS})(?P<attributes>(?:\s+{ATTRIBUTE})*)\s*/?>|<(?P<cut_close>/)(?:{TAGS})\Z|<(?:{TAGS})\s+[a-z-]+=[^<>]*\Z|</(?:{TAGS})(?=[^\w>]))"),
    # The end of a tag whose start a snippet cuts, from its first = on.
    ("cut_tag", rf"(?<=[\w:.-])=\s*(?:\"[^\"<>]*\"|'[^'<>]*')(?:\s+{VALUED})*\s*/?>"),
    ("entity", r"&(?:\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6}|(?P<entity_name>[A-Za-z][A-Za-z0-9]{1,31}));|&(?:\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6}|(?P<entity_start>[a-z]{2,7}))(?=[ ]?…|\s*\Z)|" + FRONT + r"(?:\#(?:\d{1,7}|[xX][0-9A-Fa-f]{1,6})|(?P<entity_end>[a-z]{2,7}));"),
    # LaTeX.
    ("command", r"(?<![A-Za-z0-9:\\])(?:~)?\\(?P<command_name>[A-Za-z]{2,}\*?)(?:\[[^\]\n]*\])?\{(?P<command_body>(?:[^{}]|\{[^{}]*\})*)(?:\}|\Z)|(?<=[\w.,;:])(?:~)?\\(?P<glued_name>(?:cite|ref|footnote|label|eqref|textbf|emph|texttt|url|href|pageref|index)\*?)(?:\[[^\]\n]*\])?\{(?P<glued_body>(?:[^{}]|\{[^{}]*\})*)(?:\}|\Z)"),
    ("latex_item", r"(?<![\w:\\])\\item\b[ \t]*(?:\[[^\]\n]*\])?[ \t]*"),
    ("latex_word", rf"(?<![\w:\\])\\(?:{'|'.join(LATEX_WORDS.split())})(?![A-Za-z\\])"),
    ("latex_break", r"(?<=\s)\\\\(?=\s|\Z)|(?<=[\w}])\\[%_&#](?=[\w\s]|\Z)|(?<=\w)_\{[^{}\n]*\}|(?<=\w)\^\{[^{}\n]*\}"),
    ("quotes", r"``(?P<quotes_body>[^`'\n]+)''"),
    # Emphasis.
    ("inline_code", r"(?<!`)(?P<ticks>`{1,2})(?!`)(?P<inline_code_body>[^\n]+?)(?<!`)(?P=ticks)(?!`)|(?<![\w`])`(?=[\w«])(?P<code_cut>[^`\n]*)\Z|(?<=[\w»])`(?!\w)"),
    ("strong", r"(?<![\w*])(?P<stars>\*{2,3})(?=[^\s*])(?P<strong_body>[^*\n]+?)(?<=\S)(?P=stars)(?![\w*])|(?<![\w_])__(?=[^\s_])(?P<under_body>[^\n]+?)(?<=[^\s_])__(?![\w_])|(?<!\S)\*{2,3}(?=[\w«])(?P<strong_cut>[^*\n]*)\Z|(?<=[\w»])\*{2,3}(?=[\s.,;:!?]|\Z)"),
    ("emphasis", r"(?<![\w*/\\])\*(?=[\w«\"'(])(?P<star_body>[^*\n]+?)(?<=[\w».!?,)\"'])\*(?![\w*/])|(?<!\S)\*(?=[\w«])(?!(?:args|kwargs|self|ptr|p)\b|\w*[._/()=\[\]]\w)(?P<star_cut>[^*\n…]*?)(?=[ ]?…|\s*\Z)|(?P<star_end>(?<=[\w»][\w»][\w»])\*)(?=[\s.,;:!?…]|\Z)|(?<![\w_\\])_(?=[^\s_])(?P<under_one>[^_\n]+?)(?<=[^\s_])_(?![\w_])|(?<!\S)_(?=[\w«])(?P<under_cut>[^_\n…]*?)(?=[ ]?…)|(?P<under_end>(?<=[\w»][\w»][\w»])_)(?=[\s.,;:!?…]|\Z)|'{2,5}(?=[\w«\[])|(?<=[\w»\].!?])'{2,5}(?!\w)"),
    ("strike", r"~~(?=\S)(?P<strike_body>[^~\n]+?)(?<=\S)~~|(?<!\S)~~(?=[\w«])(?P<strike_cut>[^~\n…]*?)(?=[ ]?…|\s*\Z)|(?P<strike_end>(?<=[\w».!?])~~)(?=[\s.,;:!?…]|\Z)"),
]
#: What any piece begins with: a sign, or blank space and a sign at the start of a line. Tested first, as most places are plain.
BEGINNING = r"(?=" + FRONT + r"[a-z]{2,7};|[<&#*_`~\[\]{}|\\$=!'+>:;•^-]|(?<![^\n])[ \t]*(?:[-*+#|!>=;:•~`$\\]|\d+[.)]|h[1-6]\.)|h[1-6]\.)"
PATTERN = re.compile(BEGINNING + "(?:" + "|".join(f"(?P<{name}>{piece})" for name, piece in PIECES) + ")", re.MULTILINE)
#: A heading by the line under it; it is read as one by signs before it.
SETEXT = re.compile(r"^([^\s#>|=*+\-][^\n]*)\n[ \t]{0,3}(={3,}|-{3,})[ \t]*$", re.MULTILINE)
ATTRIBUTE_NAME = re.compile(r"[A-Za-z_:@][\w:.-]*$")
#: Nothing is parsed in texts without any of these.
SIGNS = re.compile(FRONT + r"[a-z]{2,7};|[<>&#*_`~\[\]{}|\\$=+!•]|''|^[ \t]*(?:[-:;]+|\d+[.)])[ \t]|(?<!\S)h[1-6]\. |^-{3,}", re.MULTILINE)
MARKS = str.maketrans("", "", "«»")
PUNCTUATION = re.compile(r"[.,;:!?…]")

NODE = "path string, block string, kind string, text string, letters int, signs int, marks int"
NODES = f"array<struct<{NODE}>>"


def is_tag(m: re.Match) -> bool:
    """Whether a match of the tag alternative is a tag: one-letter names need a sign that they are none of a generic type."""
    name = m["tag_name"]
    if name is None or len(name) > 1 or m["close"]:
        return True
    attributes, text, start = m["attributes"] or "", m.string, m.start()
    if attributes.strip():
        return "=" in attributes
    return start == 0 or not (text[start - 1].isalnum() or text[start - 1] in "_:") or f"</{name.lower()}" in text[m.end() :].lower()


def is_piece(m: re.Match) -> bool:
    """Whether a match is markup, beyond what its pattern says."""
    kind = m.lastgroup
    if kind == "tag":
        return is_tag(m)
    if kind == "entity":
        if m["entity_start"] or m["entity_end"]:
            return any(e.startswith(m["entity_start"]) if m["entity_start"] else e.endswith(m["entity_end"]) for e in COMMON_ENTITIES) and m["entity_end"] not in ENDS_IN_WORDS
        return m["entity_name"] is None or m["entity_name"] + ";" in html5
    if kind in ("emphasis", "strike"):
        # An end without its start counts where the start may have been cut off: no such sign stands before it.
        sign = next((s for s, name in (("*", "star_end"), ("_", "under_end"), ("~~", "strike_end")) if m[name]), None)
        if sign:
            before = m.string[: m.start()]
            shown = "…" in before
            before = before.rpartition("…")[2]
            # A bare name_ or call* in an uncut text is a name or a pattern.
            return sign not in before and "\n" not in before and (shown or sign == "~~")
    if kind == "wiki_heading" and m["flat_level"] and not m["wiki_level"]:
        # A comparison (if a == b) that occurs twice is no heading.
        return not re.search(r"\b(?:if|when|while|or)\s+\w+\s$", m.string[: m.start()]) and " if " not in m["flat_title"]
    if kind == "comment" and m[0] == "-->":
        # The end of a comment that a snippet cuts; no tag may begin before it.
        return "<" not in m.string[: m.start()]
    if kind == "cut_tag":
        return ATTRIBUTE_NAME.search(m.string[: m.start()]) is not None
    return True


class Parser:
    """Leaf nodes of one text in order."""

    def __init__(self, text: str):
        self.nodes: list[list] = []
        #: HTML elements that are open, outermost first.
        self.open: list[str] = []
        if "\n=" in text or "\n-" in text or "\n " in text:
            text = SETEXT.sub(lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], text)
        self.walk(text, ())

    def leaf(self, path: tuple[str, ...], kind: str, text: str, said: str | None = None) -> None:
        """Adds a node: ``text`` is what it gives to the clean text, ``said`` what its ratios are taken of."""
        said = text if said is None else said
        full = ("html", *self.open, *(path[1:] if path[:1] == ("html",) else path)) if self.open else path
        # A name that comes again counts where it stands deepest, so paths end in their leaf and are no longer than there are names.
        names = list(dict.fromkeys(reversed(full)))[::-1]
        block = "/".join(n for n in names if n not in INLINE) or "text"
        self.nodes.append(["/".join(names) or "text", block, kind, text, len(said.strip()), len(PUNCTUATION.findall(said)), 0])

    def plain(self, text: str, path: tuple[str, ...]) -> None:
        if text:
            self.leaf(path, "text" if not path else path[-1], text)

    def walk(self, text: str, path: tuple[str, ...]) -> None:
        if not SIGNS.search(text):
            self.plain(text, path)
            return
        at, pos = 0, 0
        while (m := PATTERN.search(text, pos)) is not None:
            if m.end() == m.start() or not is_piece(m):
                pos = max(m.start() + 1, pos + 1)
                continue
            before = text[at : m.start()]
            self.plain(ATTRIBUTE_NAME.sub("", before) if m.lastgroup == "cut_tag" else before, path)
            first = len(self.nodes)
            getattr(self, "on_" + m.lastgroup)(m, path)
            # What the piece takes up beyond what its nodes say are signs of markup.
            self.nodes[first][6] += max(1, len(m[0]) - sum(n[4] + n[6] for n in self.nodes[first:]))
            at = pos = m.end()
        self.plain(text[at:], path)

    def inner(self, body: str | None, path: tuple[str, ...], *names: str) -> None:
        if body:
            self.walk(body, (*path, *names))
        else:
            self.leaf((*path, *names), names[-1], "", "")

    def code(self, body: str, path: tuple[str, ...], source: str, info: str = "") -> None:
        body = body.strip("\n")
        self.leaf((*path, source, "code"), "code", f"\n```{info.strip()}\n{body}\n```\n", body)

    def heading(self, level: int, title: str | None, path: tuple[str, ...], source: str) -> None:
        self.leaf((*path, source, f"h{level}"), "heading", "\n" + "#" * level + " ", "")
        if title:
            self.walk(title.strip(), (*path, source, f"h{level}", "heading"))
            self.leaf((*path, source, f"h{level}"), "break", "\n", "")

    def formula(self, body: str, path: tuple[str, ...], display: bool) -> None:
        body = re.sub(r"\\label\{[^{}]*\}", "", body).strip()
        self.leaf((*path, "latex", "formula"), "formula", f"\n$$ {body} $$\n" if display else f"${body}$", body)

    def on_fence(self, m, path):
        self.code(m["fence_body"] or "", path, "markdown", m["fence_info"])

    def on_inline_fence(self, m, path):
        self.code(m["inline_fence_body"].strip(), path, "markdown")

    def on_verbatim(self, m, path):
        self.code(m["verbatim_body"], path, "latex")

    def on_macro_code(self, m, path):
        self.code(m["macro_body"], path, "wiki")

    def on_pre(self, m, path):
        self.code(html.unescape(re.sub(r"</?[A-Za-z][^<>]*>", "", m["pre_body"])), path, "html")

    def on_nowiki(self, m, path):
        self.leaf((*path, "wiki", "nowiki"), "text", m["nowiki_body"])

    def on_comment(self, m, path):
        self.leaf((*path, "html", "comment"), "comment", "", m[0].strip("<>!- \n"))

    def on_script(self, m, path):
        self.leaf((*path, "html", m["script_name"].lower()), "script", "", re.sub(r"<[^<>]*>", "", m[0]))

    def on_doctype(self, m, path):
        self.leaf((*path, "html", "doctype"), "comment", "", "")

    def on_display(self, m, path):
        self.formula(m["display_dollar"] or m["display_bracket"] or m["display_body"] or "", path, True)

    def on_math(self, m, path):
        self.formula(m["math_paren"] or m["math_dollar"] or m["math_cut"] or "", path, False)

    def on_table_rule(self, m, path):
        self.leaf((*path, "markdown", "table", "rule"), "table", "", "")

    def on_rule(self, m, path):
        self.leaf((*path, "markdown", "rule"), "break", "\n", "")

    def on_atx(self, m, path):
        self.heading(len(m["atx_level"] or m[0]), m["atx_title"], path, "markdown")

    def on_wiki_heading(self, m, path):
        self.heading(len(m["wiki_level"] or m["flat_level"]), m["wiki_title"] or m["flat_title"], path, "wiki")

    def on_jira_heading(self, m, path):
        self.heading(int(m["jira_level"]), None, path, "wiki")

    def on_wiki_table(self, m, path):
        self.leaf((*path, "wiki", "table"), "table", "", "")

    def cells(self, cells: list[str], path: tuple[str, ...], source: str) -> None:
        for k, cell in enumerate(c.strip() for c in cells):
            if k:
                self.leaf((*path, source, "table", "cell"), "cell", " | ", "")
            if cell:
                self.walk(cell, (*path, source, "table", "cell"))

    def on_wiki_header(self, m, path):
        self.cells(m["wiki_header_cells"].split("!!"), path, "wiki")

    def on_table_row(self, m, path):
        row = m["row_cells"] or m["flat_cells"]
        self.cells(row.split("||") if "||" in row else row.strip().strip("|").split("|"), path, "wiki" if "||" in row else "markdown")

    def on_todo_item(self, m, path):
        self.leaf((*path, "markdown", "item"), "item", f"{m['todo_indent']}- [{m['todo_done']}]", "")

    def on_item(self, m, path):
        mark = m["item_mark"] or m[0].strip()
        depth = len(m["item_indent"] or m["paren_indent"] or "") // 2 + (len(mark) - 1 if mark[0] in "*#" else 0)
        self.leaf((*path, "markdown", "item"), "item", "  " * depth + ("- " if not mark[0].isdigit() else mark + " "), "")

    def on_quote(self, m, path):
        self.leaf((*path, "markdown", "quote"), "quote", "", "")

    def on_definition(self, m, path):
        if m["term_mark"]:
            self.inner(m["term"], path, "wiki", "term")
            self.leaf((*path, "wiki", "term"), "term", ": ", "")
        else:
            self.leaf((*path, "wiki", "indent"), "quote", "  " * len(m["indent_mark"]), "")

    def on_reference_definition(self, m, path):
        name, rest = m["reference_name"], m["reference_rest"]
        if name.startswith("^"):
            self.inner(rest, path, "markdown", "footnote")
        else:
            self.leaf((*path, "markdown", "reference"), "reference", "", rest)

    def on_wiki_link(self, m, path):
        body = m["wiki_link_body"]
        if not body:
            self.leaf((*path, "wiki", "link"), "link", "", "")
            return
        target, _, label = body.rpartition("|")
        name = (target or body).partition(":")
        if name[1] and name[0].strip().lower() in ("category", "file", "image"):
            self.inner(label if target and name[0].strip().lower() != "category" else "", path, "wiki", name[0].strip().lower())
        else:
            self.inner(label if target else body, path, "wiki", "link")

    def on_template(self, m, path):
        body = m["template_body"]
        for k, argument in enumerate((body or "").split("|")):
            name, eq, value = argument.partition("=")
            self.leaf((*path, "wiki", "template", "name" if not k else "named" if eq else "argument"), "template", value if eq else argument, value if eq else argument)

    def on_image(self, m, path):
        self.inner(m["image_alt"], path, "markdown", "image")

    def on_link(self, m, path):
        self.inner(m["link_text"], path, "markdown", "link")

    def on_footnote(self, m, path):
        self.leaf((*path, "markdown", "footnote", "mark"), "reference", "", "")

    def on_external(self, m, path):
        self.inner(m["external_text"], path, "wiki", "link")

    def on_open_link(self, m, path):
        self.leaf((*path, "markdown", "link"), "link", m[0][1:])

    def on_autolink(self, m, path):
        self.leaf((*path, "markdown", "autolink"), "autolink", m["autolink_url"])

    def on_macro(self, m, path):
        self.leaf((*path, "wiki", "macro"), "macro", "", "")

    def on_magic(self, m, path):
        self.leaf((*path, "wiki", "magic"), "macro", "", "")

    #: What a tag gives to the clean text at its start.
    STARTS = {"li": "\n- ", "br": "\n", "hr": "\n", "p": "\n", "tr": "\n", "td": " | ", "th": " | ", "div": "\n", "dt": "\n", "dd": "\n  ", "summary": "\n", "blockquote": "\n"} | {f"h{n}": "\n" + "#" * n + " " for n in range(1, 7)}
    ENDS = {"p", "ul", "ol", "table", "div", "details", "summary", "blockquote", *(f"h{n}" for n in range(1, 7))}
    VOID = {"br", "hr", "img", "input", "meta", "link", "col", "source"}

    def on_tag(self, m, path):
        name = (m["tag_name"] or "").lower()
        if not name:
            self.leaf((*path, "html", "cut"), "tag", "", "")
        elif m["close"]:
            # An end tag closes up to its start tag; headings close one another, and a stray end tag closes nothing.
            same = [i for i, x in enumerate(self.open) if x == name or name[0] == x[0] == "h" and len(name) == len(x) == 2]
            if same:
                del self.open[same[-1] :]
            self.leaf((*path, "html", name), "break" if name in self.ENDS else "tag", "\n" if name in self.ENDS else "", "")
        else:
            kind = "heading" if re.fullmatch("h[1-6]", name) else "item" if name == "li" else "cell" if name in ("td", "th") else "tag"
            start = self.STARTS.get(name, "")
            if name in ("td", "th") and self.open and self.open[-1] == "tr":
                start = ""
            if name == "img":
                alt = re.search(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))""", m["attributes"] or "", re.IGNORECASE)
                self.leaf((*path, "html", "img"), "image", next((x for x in alt.groups() if x), "") if alt else "")
                return
            self.leaf((*path, "html", name), kind, start, "")
            if name not in self.VOID and not m[0].endswith("/>"):
                if name in ("li", "td", "th", "tr", "p") and name in self.open:
                    # Without its end tag an element ends where the next of its kind starts in the same list or table.
                    last = len(self.open) - 1 - self.open[::-1].index(name)
                    if not {"ul", "ol", "table"} & set(self.open[last:]):
                        del self.open[last:]
                self.open.append(name)

    def on_cut_tag(self, m, path):
        self.leaf((*path, "html", "cut"), "tag", "", "")

    def on_entity(self, m, path):
        self.leaf((*path, "html", "entity"), "entity", html.unescape(m[0]).replace("\xa0", " "))

    #: Commands whose argument names something instead of saying it, and heading levels of sectioning ones.
    NAMING = {"cite", "ref", "label", "eqref", "pageref", "input", "include", "includegraphics", "begin", "end", "documentclass", "usepackage", "bibliography", "index", "vspace", "hspace"}
    SECTIONS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}

    def on_command(self, m, path):
        name, body = (m["command_name"] or m["glued_name"]).rstrip("*"), m["command_body"] if m["command_name"] else m["glued_body"]
        if name in self.SECTIONS:
            self.heading(self.SECTIONS[name], body, path, "latex")
        elif name in self.NAMING:
            self.leaf((*path, "latex", name), "reference", "", body or "")
        else:
            self.inner(body, path, "latex", "command" if name not in ("footnote",) else "footnote")

    def on_latex_item(self, m, path):
        self.leaf((*path, "latex", "item"), "item", "- ", "")

    def on_latex_word(self, m, path):
        self.leaf((*path, "latex", "word"), "formula", m[0], "")

    def on_latex_break(self, m, path):
        self.leaf((*path, "latex", "escape"), "escape", "\n" if m[0] == "\\\\" else m[0].lstrip("\\"))

    def on_quotes(self, m, path):
        self.leaf((*path, "latex", "quotes"), "quotes", "“", "")
        self.walk(m["quotes_body"], (*path, "latex", "quotes"))
        self.leaf((*path, "latex", "quotes"), "quotes", "”", "")

    def on_inline_code(self, m, path):
        body = m["inline_code_body"] or m["code_cut"] or ""
        self.leaf((*path, "markdown", "code"), "code", body)

    def on_strong(self, m, path):
        self.inner(m["strong_body"] or m["under_body"] or m["strong_cut"], path, "markdown", "strong")

    def on_emphasis(self, m, path):
        body = m["star_body"] or m["under_one"] or m["star_cut"] or m["under_cut"]
        self.inner(body, path, "wiki" if m[0][0] == "'" else "markdown", "emphasis")

    def on_strike(self, m, path):
        self.inner(m["strike_body"] or m["strike_cut"], path, "markdown", "strike")


def parse(text: str | None) -> list[list]:
    """[path, block, kind, text, letters, signs, marks] of the leaf nodes; none for null or empty text."""
    return Parser(text).nodes if text else []


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parsed = [parse(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield _with_lists(batch, parsed, NODE_FIELDS, "nodes")


#: Names and types of a node's parts, and of those of a path of a row.
NODE_FIELDS = [("path", pa.string()), ("block", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("letters", pa.int32()), ("signs", pa.int32()), ("marks", pa.int32())]
PATH_FIELDS = [("path", pa.string()), ("block", pa.string()), ("nodes", pa.int32()), ("letters", pa.int32()), ("signs", pa.int32()), ("marks", pa.int32())]
PATHS = "array<struct<path string, block string, nodes int, letters int, signs int, marks int>>"


def _with_lists(batch: pa.RecordBatch, rows: list[list], fields: list, name: str) -> pa.RecordBatch:
    """The columns of a batch but the last, and a list of structs for each row."""
    flat = [x for r in rows for x in r]
    parts = [pa.array(c, t) for c, (_, t) in zip(zip(*flat), fields)] if flat else [pa.array([], t) for _, t in fields]
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=[n for n, _ in fields]))
    return pa.record_batch([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], name])


def _path_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column(batch.num_columns - 1).to_pylist():
            found: dict[tuple[str, str], list[int]] = {}
            for path, block, _, _, letters, signs, marks in parse(text):
                sums = found.setdefault((path, block), [0, 0, 0, 0])
                sums[0] += 1
                sums[1] += letters
                sums[2] += signs
                sums[3] += marks
            rows.append([[*k, *v] for k, v in found.items()])
        yield _with_lists(batch, rows, PATH_FIELDS, "paths")


def parse_nodes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``nodes`` of every row, one for one."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return rows.select(*keys, text).mapInArrow(_parse_batches, f"{schema}, nodes {NODES}")


def parse_paths(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``paths`` of every row, one for one: its tag paths with what their nodes sum to."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return rows.select(*keys, text).mapInArrow(_path_batches, f"{schema}, paths {PATHS}")


def with_markup(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The distinct ``keys`` of the rows whose text has a node on a path of markup, by the ratios of all rows."""
    parsed = cut(parse_paths(rows, keys, text))
    marked = sized_broadcast(path_ratios(parsed).where("markup").select(F.col("path").alias("__path")))
    return parsed.select(*keys, F.explode("paths.path").alias("__path")).join(marked, "__path").select(*keys).distinct()


def path_ratios(parsed: DataFrame) -> DataFrame:
    """(path, block, nodes, letters, signs, marks, share, markup, score, content) of every tag path over all rows of ``parse_paths`` or ``parse_nodes``.

    ``share``: the signs of markup of all a path takes up, geometric mean of its own and the one
    smoothed over its siblings; a path is markup from MARKED on. ``score``, of the path's block:
    letters a node and punctuation a hundred letters, put to logarithms, smoothed over the siblings
    and multiplied; a block is content if it carries structure or its score reaches the mean less
    half a standard deviation of the scores. Siblings are the paths with the same parent; of each
    side the next two count, with Gaussian weights.
    """
    lists = "paths" if "paths" in parsed.columns else "nodes"
    each = parsed.select(F.explode(lists).alias("n"))
    count = F.sum("n.nodes") if lists == "paths" else F.count(F.lit(1))
    paths = each.groupBy(F.col("n.path").alias("path"), F.col("n.block").alias("block")).agg(count.alias("nodes"), F.sum("n.letters").alias("letters"), F.sum("n.signs").alias("signs"), F.sum("n.marks").alias("marks"))
    paths = cut(paths)
    blocks = paths.groupBy("block").agg(F.sum("nodes").alias("nodes"), F.sum("letters").alias("letters"), F.sum("signs").alias("signs"))
    blocks = blocks.withColumns({"density": F.log1p(F.col("letters") / F.col("nodes")), "pointing": F.log1p(100 * F.col("signs") / F.greatest("letters", F.lit(1)))})
    scored = blocks.withColumn("score", _smooth("density", "block") * (1 + _smooth("pointing", "block"))).select("block", "score")
    limit = scored.agg((F.avg("score") - F.coalesce(F.stddev_pop("score"), F.lit(0.0)) / 2).alias("limit"))
    structured = F.arrays_overlap(F.split("block", "/"), F.array(*[F.lit(x) for x in sorted(STRUCTURED)]))
    content = scored.join(F.broadcast(limit)).select("block", "score", (structured | (F.col("score") >= F.col("limit"))).alias("content"))
    own = F.col("marks") / F.greatest(F.col("marks") + F.col("letters"), F.lit(1))
    shares = paths.withColumn("own", own).withColumn("share", F.sqrt(F.col("own") * _smooth("own", "path")))
    return shares.join(content, "block").select("path", "block", "nodes", "letters", "signs", "marks", F.round("share", 6).alias("share"), (F.col("share") >= MARKED).alias("markup"), F.round("score", 6).alias("score"), "content")


def _smooth(name: str, path: str) -> Column:
    """A ratio smoothed over the siblings of a path; their number is bounded by the names there are."""
    order = Window.partitionBy(F.regexp_extract(path, "^(.*)/[^/]*$", 1)).orderBy(path)
    weights = {-2: 0.054, -1: 0.244, 0: 0.403, 1: 0.244, 2: 0.054}
    return sum((F.coalesce(F.lag(name, k).over(order), F.col(name)) * w for k, w in weights.items()), F.lit(0.0))


def clean_text(rows: DataFrame, keys: list[str], text: str, out: str = "clean") -> DataFrame:
    """``keys`` and ``out``: every row's text without markup, one for one.

    Headings come out as # lines, list items with - or their number, code blocks fenced, formulas
    between dollar signs, table cells between bars; link targets, attributes, comments, scripts and
    what else the ratios show to be no content are gone. Null stays null, empty stays empty, text
    without markup stays as it is but for blank space at line ends. Repeated rows are kept; columns
    besides ``keys`` and ``text`` are not read.
    """
    parsed = cut(parse_nodes(rows.withColumns({"__null": F.col(text).isNull(), "__row": F.monotonically_increasing_id()}), [*keys, "__null", "__row"], text))
    # Of the blocks that are no content, and of the rows that have one, there are few; both are broadcast only if that is so.
    low = sized_broadcast(path_ratios(parsed).where("NOT content").select("block").distinct())
    blocks = parsed.select("__row", F.explode(F.array_distinct("nodes.block")).alias("block"))
    dropped = sized_broadcast(blocks.join(low, "block").groupBy("__row").agg(F.collect_set("block").alias("__dropped")))
    kept = F.filter("nodes", lambda n: n["kind"].isin(*STRUCTURE) | F.col("__dropped").isNull() | ~F.array_contains("__dropped", n["block"]))
    said = F.array_join(F.transform(kept, lambda n: n["text"]), "")
    tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(said, r"[ \t]+(?=\n|$)", ""), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    return parsed.join(dropped, "__row", "left").select(*keys, F.when(~F.col("__null"), tidy).alias(out))
