"""Functions paired with their documentation, by recursive patterns.

One recursive pattern per language family captures the comment and attribute lines above a declaration
and its signature. The recursion over the body's brackets goes on a stack of its own, at every size:
the library's takes kilobytes a level, and time that grows with the square of the brackets. Strings,
templates, regular expressions and comments are matched as wholes, so brackets in them never count.
What the comments (in Python also the docstring) say is then stripped of everything that states
nothing, and only pairs that still say something stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Symbol kinds that are functions.
FUNCTION_KINDS = ("fn", "getter", "setter")

# Extensions of each family of languages.
FAMILIES = {"rs": "rust", "go": "go", "js": "script", "jsx": "script", "mjs": "script", "cjs": "script", "ts": "script", "tsx": "script", "mts": "script", "cts": "script", "py": "python", "pyi": "python"}

# Parts of the patterns, possessive throughout. They are matched once, at the start of a body, where no bracket is tried
# twice: one that does not close is found by reaching the end, and then ends the brackets around it as well.
STRING = r"""(?P<dq>"(?:[^"\\]|\\[\s\S])*+")"""
LINE_STRING = r"""(?P<dq>"(?:[^"\\\n]|\\[\s\S])*+")|(?P<sq>'(?:[^'\\\n]|\\[\s\S])*+')"""
C_COMMENT = r"(?P<lc>//[^\n]*+)|(?P<bc>/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))"
REGEX_START = r"""(?=/)(?<=[=(,:;!&|?\[{}>+\-*%~^]\s*+|\breturn\s++)/(?![/*])"""
REGEX_LITERAL = REGEX_START + r"""(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*+"""
# In JSX text brackets and quotes need not balance, so a body may hold what is left between tags near by.
JSX_TEXT = r"""['"()\[\]](?=[^<>{};=\n]{0,120}(?:\{[^{}\n]{0,60}\}[^<>{};=\n]{0,60}){0,3}</?[A-Za-z])(?<=(?:\}|(?<!=)>)[^<>{};=\n]{0,120})"""

DEFINITIONS = {
    "rust": r"""(?(DEFINE)
        (?P<bc>/\*(?:[^*/]|\*(?!/)|/(?!\*)|(?&bc))*+(?:\*/|\Z))
        (?P<skip>//[^\n]*+|(?&bc)|b?r\#\#"(?:[^"]|"(?!\#\#))*+"\#\#|b?r\#"(?:[^"]|"(?!\#))*+"\#|b?r"[^"]*+"|b?"(?:[^"\\]|\\[\s\S])*+"|b?'(?:[^'\\\n]|\\[^\n]{1,10}?)'|'\w++)
        (?P<round>\((?:[^()\[\]{}"'/rb]++|(?&skip)|(?&round)|(?&square)|(?&body)|[/rb'"])*+\))
        (?P<square>\[(?:[^()\[\]{}"'/rb]++|(?&skip)|(?&round)|(?&square)|(?&body)|[/rb'"])*+\])
        (?P<body>\{(?:[^()\[\]{}"'/rb]++|(?&skip)|(?&round)|(?&square)|(?&body)|[/rb'"])*+\})
    )""",
    "go": r"""(?(DEFINE)
        (?P<bc>/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))
        (?P<skip>//[^\n]*+|(?&bc)|`[^`]*+`|"(?:[^"\\\n]|\\[^\n])*+"|'(?:[^'\\\n]|\\[^\n]{1,10}?)')
        (?P<round>\((?:[^()\[\]{}"'/`]++|(?&skip)|(?&round)|(?&square)|(?&body)|[/'"])*+\))
        (?P<square>\[(?:[^()\[\]{}"'/`]++|(?&skip)|(?&round)|(?&square)|(?&body)|[/'"])*+\])
        (?P<body>\{(?:[^()\[\]{}"'/`]++|(?&skip)|(?&round)|(?&square)|(?&body)|[/'"])*+\})
    )""",
    "script": r"""(?(DEFINE)
        (?P<bc>/\*(?:[^*]|\*(?!/))*+(?:\*/|\Z))
        (?P<tpl>`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$(?&body))*+`)
        (?P<skip>//[^\n]*+|(?&bc)|(?&tpl)|"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+'|""" + REGEX_LITERAL + r"""|(?&jsx))
        (?P<jsx>""" + JSX_TEXT + r""")
        (?P<round>\((?:[^()\[\]{}"'/`]++|(?&jsx)|(?&skip)|(?&round)|(?&square)|(?&body)|[/'"])*+\))
        (?P<square>\[(?:[^()\[\]{}"'/`]++|(?&jsx)|(?&skip)|(?&round)|(?&square)|(?&body)|[/'"])*+\])
        (?P<body>\{(?:[^()\[\]{}"'/`]++|(?&jsx)|(?&skip)|(?&round)|(?&square)|(?&body)|[/'"])*+\})
    )""",
    "python": r"""(?(DEFINE)
        (?P<triple>"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3})
        (?P<skip>\#[^\n]*+|(?&triple)|"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+')
        (?P<round>\((?:[^()\[\]{}"'\#]++|(?&skip)|(?&round)|(?&square)|(?&body))*+\))
        (?P<square>\[(?:[^()\[\]{}"'\#]++|(?&skip)|(?&round)|(?&square)|(?&body))*+\])
        (?P<body>\{(?:[^()\[\]{}"'\#]++|(?&skip)|(?&round)|(?&square)|(?&body))*+\})
    )""",
}
# Of a script's signature: what its type may hold besides objects in brackets, and the first character of the code. Behind a
# round bracket an arrow is one of a type, and a value is read as if it went on with the type, up to what no type holds.
TYPE = r"(?:[^;{}=>()]++|(?&square)|(?&round)|(?<=\)\s*+)=>|>)*+"
CODE = r"[{;]|(?<==>\s*)(?P<value>[^\n])|$"
VALUE = r"(?<==>[^;{}]*)(?P<value>[^\n])"
MODIFIERS = r"(?:(?:export|default|declare|async|static|public|private|protected|readonly|abstract|override|get|set|function\b\s*\*?|function)\b\s*|\*\s*)*+"
FUNCTIONS = {
    "rust": r"""(?P<doc>(?:[ \t]*+(?://[^\n]*+|(?&bc)|\#!?(?&square))\s*+)*+)
        (?P<signature>(?:pub(?:\s*(?&round))?\s+)?(?:(?:default|const|async|unsafe|extern(?:\s*"[^"]*")?)\s+)*+fn\s+(?:r\#)?(?P<name>\w++)(?:[^(){};"'/\[]++|(?&round)|(?&square)|'\w++|(?&skip))*+)
        (?P<code>[{;(\[]|\Z)""",
    "go": r"""(?P<doc>(?:[ \t]*+(?://[^\n]*+|(?&bc))\s*+)*+)
        (?P<signature>func\s*+(?&round)?\s*+(?P<name>\w++)(?&square)?\s*+(?&round)(?:[ \t]*+(?:(?&round)|(?&square)|interface\s*(?&body)|struct\s*(?&body)|(?&bc)|[\w.*<-]++))*+)[ \t]*+
        (?P<code>[{(\[]|)""",
    "script": rf"""(?P<doc>(?:[ \t]*+(?://[^\n]*+|(?&bc)|@[\w.]++(?&round)?)\s*+)*+)
        (?P<signature>{MODIFIERS}(?:(?:const|let|var)\s+)?(?P<name>\#?[\w$]++)\s*+(?:\??\s*:\s*[^=;{{}}]*?)?(?:=\s*(?:async\s*)?(?:function\b\s*\*?\s*[\w$]*+)?)?\s*+(?:<[^()]*?>)?\s*+(?:(?&round)|[\w$]++\s*+(?==>))(?:\s++|//[^\n]*+|(?&bc))*+(?P<type>:\s*{TYPE})?(?:=>\s*)?)
        (?P<code>{CODE}|(?(type)(?:[(\[]|{VALUE})|(?!)))""",
    "python": r"""(?P<doc>(?:[ \t]*+(?:\#[^\n]*+|@[\w.]++(?&round)?[^\n]*+)\s*+)*+)
        (?P<signature>[ \t]*+(?:async\s+)?def\s+(?P<name>\w++)\s*+(?&square)?\s*+(?&round)\s*+(?:->\s*+(?:[^:\[\](){}"'\#]++|(?&square)|(?&round)|(?&skip))*+)?:)
        (?P<code>(?:\s*+\#[^\n]*+)*+\s*+(?P<docstring>[rRuU]?(?:(?&triple)|"(?:[^"\\\n]|\\[\s\S])*+"|'(?:[^'\\\n]|\\[\s\S])*+')(?=[ \t]*+(?:[;\#\n]|$)))?[\s\S]*+)""",
}


@lru_cache(maxsize=8)
def pattern(family: str) -> regex.Pattern:
    """The pattern of a family. But in Python ``code`` is only the first character of the code, where ``code_end`` goes on; it is
    a round or square bracket if one of the signature does not close."""
    return regex.compile(FUNCTIONS[family] + DEFINITIONS[family], regex.VERBOSE | regex.MULTILINE)


#: Behind an object in brackets where a script's signature has its type: the type goes on, so that was not the body.
TYPE_GOES_ON = regex.compile(rf"(?=\s*+(?:[\[{{|&>]|=>)){TYPE}(?:=>\s*)?(?P<code>{CODE}|[(\[]|{VALUE})" + DEFINITIONS["script"], regex.VERBOSE | regex.MULTILINE)

# What lies between two brackets of a body, literals as wholes. One over several lines that does not close takes the rest; any
# other is its first character. Templates and Rust's comments nest, so their marks are brackets too.
BETWEEN = {
    "rust": r"""[^()\[\]{}"'/#]++|//[^\n]*+|/(?!\*)|(?<=\b[bc]?r)(?P<hashes>#*+)"[\s\S]*?(?:"(?P=hashes)|\Z)|"(?:[^"\\]++|\\[\s\S])*+(?:"|\Z)|'(?:[^'\\\n]|\\[^\n]{1,10}?)'|'\w++|['#]""",
    "go": r"""[^()\[\]{}"'/`]++|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)|`[^`]*+(?:`|\Z)|"(?:[^"\\\n]++|\\[^\n])*+"|'(?:[^'\\\n]|\\[^\n]{1,10}?)'|[/'"]""",
    "script": r"""[^()\[\]{}"'/`\n]++|""" + JSX_TEXT + r"""|//[^\n]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\Z)|"(?:[^"\\\n]++|\\[\s\S])*+"|'(?:[^'\\\n]++|\\[\s\S])*+'|['"]""",
}
_BRACKETS = r"[()\[\]{}`"
_REGEX = rf"{REGEX_LITERAL}|(?!{REGEX_START})/"
#: To the next bracket; in scripts also to a regular expression that does not close on its line, behind which the line has no other.
STEPS = {
    "rust": regex.compile(rf"\G(?:{BETWEEN['rust']})*+(?P<mark>{_BRACKETS}]|/\*)"),
    "go": regex.compile(rf"\G(?:{BETWEEN['go']})*+(?P<mark>{_BRACKETS}])"),
    "script": regex.compile(rf"\G(?:{BETWEEN['script']}|{_REGEX}|\n++)*+(?P<mark>{_BRACKETS}/])"),
}
#: To the next bracket or line of a script, with and without regular expressions.
LINE_STEP = regex.compile(rf"\G(?:{BETWEEN['script']}|{_REGEX})*+(?P<mark>{_BRACKETS}/\n])")
PLAIN_STEP = regex.compile(rf"\G(?:{BETWEEN['script']}|/)*+(?P<mark>{_BRACKETS}\n])")
#: To the next mark in a template or a comment that nests.
INSIDE = {"`": regex.compile(r"\G(?:[^`\\$]++|\\[\s\S]|\$(?!\{))*+(?P<mark>`|\$\{)"), "/*": regex.compile(r"\G(?:[^*/]++|\*(?!/)|/(?!\*))*+(?P<mark>/\*|\*/)")}
CLOSING = {"(": ")", "[": "]", "{": "}", "${": "}", "`": "`", "/*": "*/"}
#: The line after one of an arrow's value: its indentation, and whether it begins with what goes on with the value.
NEXT_LINE = regex.compile(r"(?:[ \t]*+\n)*+(?P<indent>[ \t]*+)(?P<on>[.?:]|&&|\|\||</|/?>|=>)?(?=\S)")


def body_end(text: str, start: int, family: str, indent: int | None = None) -> int:
    """Where the bracket at ``start`` closes, or the end of the text if it, or one in it, does not.

    With an ``indent``, where the value of an arrow that begins at ``start`` ends: with its line, brackets and literals as
    wholes, or with the last of the lines after it that are further in than ``indent`` or begin with an operator; behind a
    semicolon at a line's end it does not go on.
    """
    inside: list[str] = []
    usual = STEPS[family]
    at, plain_to = start, 0
    while True:
        if inside and inside[-1] in INSIDE:
            step = INSIDE[inside[-1]]
        elif at < plain_to:
            step = PLAIN_STEP
        else:
            step = usual if inside or indent is None else LINE_STEP
        for m in step.finditer(text, at):
            mark = m["mark"]
            if inside and mark == CLOSING[inside[-1]]:
                inside.pop()
                if not inside and indent is None:
                    return m.end()
            elif mark in CLOSING:
                inside.append(mark)
            elif mark == "/":
                line = text.find("\n", m.end())
                plain_to = line if line >= 0 else len(text)
            elif mark == "\n":
                if not inside and indent is not None:
                    following = NEXT_LINE.match(text, m.end())
                    if following is None or text[m.start() : m.end()].rstrip().endswith(";") or not (following["on"] or len(following["indent"]) > indent):
                        return m.end() - 1
                    at = following.end("indent")
                    break
            elif inside:
                return len(text)
            if step is not usual or not inside or inside[-1] in INSIDE or mark == "/":
                at = m.end()
                break
        else:
            return len(text)


def code_end(m: regex.Match, text: str, family: str) -> int:
    """Where the code of a match of the family's pattern ends; code that does not balance goes to the end of the text."""
    if family == "python":
        return m.end("code")
    typed = m.start("type") if family == "script" and m["type"] is not None else None
    line = text.rfind("\n", 0, m.start("signature")) + 1
    indent = len(regex.match(r"[ \t]*+", text, pos=line)[0])
    while m["code"] == "{":
        start = m.start("code")
        end = body_end(text, start, family)
        if typed is None:
            return end
        if not (goes_on := TYPE_GOES_ON.match(text, end)):
            # An object in the value of an arrow whose type was given.
            before = text[typed:start].rstrip()
            return body_end(text, start, family, indent) if "=>" in before and before[-1] in "?:&|" else end
        m = goes_on
    if family == "script" and m["value"]:
        return body_end(text, m.start("code"), family, indent)
    return len(text) if m["code"] in ("(", "[") else m.end("code")


# Words that state nothing by themselves.
FILLERS = frozenset(
    "a an the this that these those it its is are be been was were will would shall can could may might must to of for in on with by and or as at from into which what when then than so"
    " function functions func method methods helper helpers getter setter gets get getting sets set setting return returns returned returning does do doing done implement implements implementation"
    " perform performs handle handles given value values parameter parameters param params argument arguments args arg result results description describe described documentation docs doc document"
    " documented undocumented placeholder stub stubs auto autogenerated generated automatically automatic missing no none null nothing empty yet here see above below itself self explanatory obvious"
    " etc simply just some used use uses call calls called main code todo fixme xxx tbd wip na later misc various new our my your one".split()
)
# The same in other languages, as folded words: function, value, gives back, sets, gets, articles, prepositions, pronouns.
FOREIGN = {
    "de": "gibt geben zurück zurueck liefert liefern holt holen setzt setzen wert werte werts funktion funktionen methode methoden hilfsfunktion der die das den dem des ein eine einen einem einer eines und oder von für fuer mit zu zum zur im in ist wird werden hier siehe oben unten ergebnis parameter argument beschreibung aus auf bei führt fuehrt",
    "fr": "renvoie renvoyer retourne retourner rend donne définit definit obtient obtenir récupère recupere valeur valeurs fonction fonctions méthode methode le la les un une des du de et ou pour avec dans sur est sont ce cette ici voir résultat resultat paramètre argument description au aux en à se",
    "es": "devuelve devolver retorna retornar obtiene obtener establece asigna fija valor valores función funcion funciones método metodo el la los las un una unos unas del de y o para con en es son este esta aquí aqui ver resultado parámetro parametro argumento descripción descripcion al lo se da",
    "it": "restituisce ritorna ottiene imposta valore valori funzione metodo il lo la gli le un uno una del della dei e o per con di da in è sono questo questa qui vedi risultato parametro descrizione",
    "pt": "retorna devolve obtém obtem define valor valores função funcao método metodo o a os as um uma do da de e ou para com em é são este esta aqui ver resultado parâmetro parametro descrição",
    "ru": "возвращает вернуть возвращаемое получает получить устанавливает установить задаёт задает значение значения функция функции метод методы и или для с в на из по это этот эта здесь см результат параметр аргумент описание",
    "el": "επιστρέφει επιστροφή παίρνει ορίζει τιμή τιμές συνάρτηση μέθοδος ο η το οι τα του της των τον την ένα μια και ή για με σε από είναι αυτό εδώ αποτέλεσμα παράμετρος περιγραφή",
}
FILLERS |= frozenset(w for words in FOREIGN.values() for w in words.split())
#: Where words are not spaced apart, the parts that fillers are made of; a word of nothing else states nothing.
UNSPACED = regex.compile(r"(?:返回|取得|获取|獲取|设置|設置|設定|值|関数|函数|函式|方法|参数|引数|结果|結果|説明|说明|戻り値|値|返す|返します|する|します|を|の|は|が|に|で|と|です|ます|的|了|和|与|这个|此|该|一个|メソッド|ヘルパー)+")
#: Starts of lines that speak to tools: each with the syntax the tool itself asks for, as many of the names are words too.
DIRECTIVES = regex.compile(
    r"^(?:eslint(?:-(?:disable|enable|env|ignore)|\s+[\w@/-]+\s*:)|tslint:|js[hl]int(?::|\s+[-+]?\w+\s*(?:[:,]|$))|jscs:|standard:|prettier-ignore|biome-ignore|@?deno-(?:lint|fmt|coverage|types)|istanbul\s+ignore\b|"
    r"[cv]8\s+ignore\b|@ts-|@flow\b|flow(?:lint\b|-(?:disable|enable|ignore|include|suppress))|@jsx|@vitest|@jest|(?-i:webpack[A-Z]\w*)\s*:|nolint\b|noqa\b|(?:pylint|mypy|pyright|ruff|isort|yapf):|flake8[:-]|"
    r"black:\s*(?:on|off|skip)\b|nosec\b|nosonar\b|(?-i:type):\s*(?:ignore\b|[\w.]+(?:\[.*\])?$|\(.*\)\s*->)|#pragma\b|pragma(?::|\s+(?:once|mark|omp)\b)|fmt:\s*(?:on|off|skip)\b|rustfmt(?:::?|-)\s*\w|clippy:|"
    r"cargo::?\w|go:\w|\+build\b|#cgo\b|cgo:|line\s+\S+:\d+(?::\d+)?$|lint:|lint-(?:disable|enable|ignore)|coverage:\s*(?:ignore|exclude|skip|on|off|no)\b|cspell:|spell-?checker:|codespell:|#(?:end)?region\b|"
    r"(?:[#@]\s*)?sourcemappingurl=|@generated\b|"
    r"@(?:inline|internal|private|public|protected|override|hidden|ignore|async|static|readonly|constructor|class|function|abstract|final|virtual|api|beta|alpha|experimental|inheritdoc)\b\s*$|"
    r"-\*-|vim?:|!/|swiftlint:|ktlint-(?:disable|enable)|checkstyle[:.]|sonar(?:lint)?[:.-]|suppress(?:warnings|lint)?[(:])",
    regex.IGNORECASE,
)
#: Notes of work to do: the first four are no words of a sentence in any case of letters, the others only in capitals or with a sign after them.
NOTES = regex.compile(
    r"^\W*(?:(?:FIXME|XXX|TBD|REVIEWME)\b|(?-i:TODO|HACK|WIP|BUG|OPTIMIZE|UNDONE|TBA|N/?A)\b(?!-\w)|(?:TODO|HACK|WIP|BUG|OPTIMIZE|UNDONE|TBA|N/?A)\s*(?:[:(]|[.!…-]*$))", regex.IGNORECASE
)
FOLD = regex.compile(r"#(?:end)?region\b")
RULER = regex.compile(r"^(?:[-=*#~_+.<>/\\|:]{2,}.*[-=*#~_+.<>/\\|:]{2,}|\W*)$")
#: A line of code that was switched off.
DISABLED = regex.compile(
    r"^(?:(?:let|const|var|mut|return|if|for|while|else|elif|import|from|use|fn|func|def|class|struct|print|println!|await|async|yield|raise|throw|try|except|catch|switch|case|match|pub|static|type|package)\b.*(?:[;{}:,]|\)|=.*)\s*$"
    r"|[\w.\[\]$]+\s*(?::=|[-+*/%|&^]?=(?!=)|\+\+|--)\s*\S*.*|[\w.$:]+!?\(.*\)\s*[;,{]?\s*$|[{}()\[\];,]+|(?:return|break|continue|pass)\s*[\w.]*;?|.*[;{]\s*$|.*\)\s*=>\s*.*)"
)
TAG = regex.compile(
    r"^(?:[@\\](?P<tag>\w+)\s*(?P<type>\{[^{}]*\})?\s*(?P<rest>.*)|:(?P<role>\w+)(?:\s+[^:]*)?:\s*(?P<role_rest>.*)|[-*+]?\s*`(?P<tick>[^`]+)`\s*(?:\([^()]*\))?\s*[-–—:]?\s*(?P<tick_rest>.*))$"
)
#: Tags whose first word names something.
NAMED_TAGS = frozenset("param arg argument prop property template typeparam tparam throws exception raises see link type typedef callback memberof name namespace module since version author default yields".split())
SECTION = regex.compile(r"^(?:#{1,6}\s*)?(?:args|arguments|parameters|params|returns?|raises|yields|throws|errors|panics|safety|examples?|notes?|see also|attributes|type parameters|keyword args|keyword arguments)\s*:?\s*$", regex.IGNORECASE)
SECTION_ENTRY = regex.compile(r"^\*{0,2}[\w$.]+(?:\s*\([^()]*\))?\s*:\s*(?P<rest>.*)$")
WORD = regex.compile(r"\p{L}[\p{L}\p{M}'’]*|\d+")
NAME_WORD = regex.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\p{L}+|\d+")
SUFFIXES = ("", "s", "es", "ed", "d", "ing", "er", "ers", "ings")


def comment_lines(doc: str, family: str) -> list[str]:
    """The lines of comments without their marks; attributes and decorators are left out."""
    out: list[str] = []
    if family == "python":
        # The # of a fold mark (#region) is its own.
        lines = [line.strip() for line in doc.splitlines() if line.strip().startswith("#")]
        return [line if FOLD.match(line) else line[1:].strip().lstrip("#!:").strip() for line in lines]
    for m in regex.finditer(r"//[^\n]*|/\*(?:[\s\S]*?)\*/", doc):
        if doc.rfind("\n", 0, m.start()) < (k := max(doc.rfind("#[", 0, m.start()), doc.rfind("#![", 0, m.start()))) and "]" not in doc[k : m.start()]:
            continue  # inside an attribute
        text = m[0]
        if text.startswith("//"):
            out.append(regex.sub(r"^/{2,}!?", "", text).strip())
        else:
            out += [regex.sub(r"^\s*\*+(?!\*)\s?", "", line).strip() for line in regex.sub(r"^/\*+!?|\*+/$", "", text).splitlines()]
    return out


def docstring_lines(literal: str | None) -> list[str]:
    if not literal:
        return []
    body = literal.lstrip("rRuU")
    quote = body[:3] if body[:3] in ('"' * 3, "'" * 3) and len(body) >= 6 else body[:1]
    return [line.strip() for line in body[len(quote) : len(body) - len(quote)].splitlines()]


def stating_lines(lines: list[str]) -> list[str]:
    """What lines of documentation say besides rulers, directives, notes of work to do, disabled code and bare tags."""
    out: list[str] = []
    section = False
    for line in lines:
        text = line.strip().strip("*").strip() if regex.fullmatch(r"\*+.*\*+", line.strip()) else line.strip()
        if not text or RULER.match(text):
            section = section and bool(text)
            continue
        if DIRECTIVES.match(text) or NOTES.match(text):
            continue
        if SECTION.match(text):
            section = True
            continue
        m = TAG.match(text)
        if m:
            if m["tag"]:
                rest = m["rest"]
                if m["tag"].lower() in NAMED_TAGS:
                    rest = regex.sub(r"^\[?[\w$.]+(?:=[^\]]*)?\]?\s*[-–—:]?\s*", "", rest)
                text = rest
            elif m["role"]:
                text = "" if m["role"] in ("type", "rtype") else m["role_rest"]
            else:
                text = m["tick_rest"] if regex.match(r"^[-*+]?\s*`", text) and not regex.search(r"\w\s+`", text) else text
        elif section and (m := SECTION_ENTRY.match(text)):
            text = m["rest"]
        elif DISABLED.match(text) and not regex.match(r"^\p{L}[\p{L}\s,'’-]*\p{L}[.!?]?$", text):
            continue
        if text:
            out.append(text)
    return out


def stems(word: str) -> set[str]:
    """Forms a name word may take in a sentence."""
    w = word.lower()
    base = {w + s for s in SUFFIXES}
    if w.endswith("e"):
        base |= {w[:-1] + s for s in ("ing", "ed", "er", "ers", "ion")}
    if w.endswith("y"):
        base |= {w[:-1] + s for s in ("ies", "ied", "ier")}
    if len(w) > 2:
        base |= {w + w[-1] + s for s in ("ing", "ed", "er")}
    for s in ("s", "es", "ed", "ing", "d"):
        if w.endswith(s) and len(w) > len(s) + 2:
            base.add(w[: -len(s)])
    return base


def description_of(lines: list[str], name: str) -> str | None:
    """The description, or None if its words are all of the name or fillers."""
    # "export Name" over a function of that name is a directive of cgo.
    said = stating_lines([line for line in lines if not (name and line.strip() == f"export {name}")])
    known = set().union(*(stems(w) for w in NAME_WORD.findall(name or ""))) if name else set()
    known.add((name or "").lower())
    for word in WORD.findall(" ".join(said)):
        w = word.lower()
        if len(w) > 1 and not w.isdigit() and w not in FILLERS and w not in known and not UNSPACED.fullmatch(w):
            return "\n".join(said)
    return None


def documented(rows: DataFrame, key: str = "sym_id") -> DataFrame:
    """(key, name, kind, description, code) of the function rows whose body documents them.

    ``rows``: key, file, kind, name, body (as in ``symbol_rows``). The language follows the
    extension of ``file``; rows of other kinds or languages, without a body, or whose body holds no
    function are no pairs. The function a body begins with counts, and only under the row's own name; a
    body that does not balance (cut off, say) goes to its end. A null name is taken from the
    signature. Rows that come again count once; other columns are not read. One pass over each body.
    """
    return documented_rows(rows, key).distinct()


def documented_rows(rows: DataFrame, key: str = "sym_id") -> DataFrame:
    """As ``documented``, with rows that come again as often as they come; nothing is shuffled."""
    wanted = rows.where(F.col("kind").isin(*FUNCTION_KINDS) & F.col("body").isNotNull() & F.col(key).isNotNull())
    wanted = wanted.select(key, "name", "kind", F.lower(F.regexp_extract("file", r"\.([A-Za-z]+)$", 1)).alias("ext"), "body")
    schema = f"{key} {dict(rows.dtypes)[key]}, name string, kind string, description string, code string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                family = FAMILIES.get(row.ext)
                if family:
                    name = row.name if isinstance(row.name, str) and row.name else None
                    found = first_pair(row.body.replace("\r\n", "\n"), family, name)
                    if found:
                        out.append((row[0], found[0], row.kind, found[1], found[2]))
            yield pd.DataFrame(out, columns=[key, "name", "kind", "description", "code"])

    return wanted.mapInPandas(run, schema)


def first_pair(body: str, family: str, name: str | None) -> tuple[str, str, str] | None:
    """The pair of the function that a body begins with, if it has the name given and is documented."""
    m = pattern(family).match(body, len(body) - len(body.lstrip("\n")))
    if m is None or name and m["name"].lstrip("#") != name.lstrip("#").removeprefix("r#"):
        return None
    return _pair(m, body[m.start("code") : code_end(m, body, family)], family, name)


def pairs(text: str, family: str) -> Iterator[tuple[str, str, str]]:
    """(name, description, code) of every documented function in the text of a file; one that does not close takes the rest."""
    at = 0
    while m := pattern(family).search(text, at):
        at = code_end(m, text, family)
        if pair := _pair(m, text[m.start("code") : at], family, None):
            yield pair


def _pair(m: regex.Match, code: str, family: str, name: str | None) -> tuple[str, str, str] | None:
    lines = comment_lines(m["doc"], family) + (docstring_lines(m["docstring"]) if family == "python" else [])
    description = description_of(lines, name or m["name"])
    return None if description is None else (name or m["name"], description, (m["signature"] + code).strip())
