"""Link texts taken apart: targets of markdown links, wikilinks and embeds, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme of targets that start at the root of the workspace; every function here takes another one.
ROOT_SCHEME = "root://"
#: Links to elsewhere, besides those of any scheme.
EXTERNAL = r"^(?:mailto:|tel:|data:)"
# Fixed patterns of procedures: an id at the start of a heading, and the two statements.
PROCEDURE_ID = r"SOP-(?:[A-Z]+-?)?\d+"
PROCEDURE_HEADING = rf"^({PROCEDURE_ID})\s*::"
USE = rf"^\s*use\s+({PROCEDURE_ID})\s+from\s+(\S+)(?:\s+as\s+(\S+))?\s*$"
RUN = rf"^\s*run\s+({PROCEDURE_ID})\b"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def unwrap(destination: Column | str) -> Column:
    """A destination without the angle brackets around it."""
    return F.regexp_replace(F.trim(_c(destination)), r"^<(.*)>$", "$1")


def is_external(destination: Column | str, scheme: str = ROOT_SCHEME) -> Column:
    c = _c(destination)
    return c.rlike(EXTERNAL) | (c.contains("://") & ~c.startswith(scheme))


def _none(c: Column) -> Column:
    return F.when(c != "", c)


def markdown_target(destination: Column | str, scheme: str = ROOT_SCHEME) -> Column:
    """(file, anchor, root_relative) of a markdown link's destination; null if it is empty, external or no .md file."""
    c = unwrap(destination)
    rooted = c.startswith(scheme)
    rest = F.when(rooted, F.substring(c, len(scheme) + 1, 1_000_000)).otherwise(c)
    file = F.substring_index(rest, "#", 1)
    anchor = F.when(rest.contains("#"), _none(F.regexp_replace(rest, r"^[^#]*#", "")))
    target = F.struct(_none(file).alias("file"), anchor.alias("anchor"), rooted.alias("root_relative"))
    bad = (c == "") | is_external(c, scheme) | ((file != "") & ~file.endswith(".md")) | ((file == "") & (anchor.isNull() | rooted))
    return F.when(~bad, target)


def wikilink_target(body: Column | str, scheme: str = ROOT_SCHEME) -> Column:
    """(file, anchor, root_relative) of what stands in [[ ]]; the label after a bar does not count; null if nothing is left."""
    c = F.trim(F.substring_index(_c(body), "|", 1))
    rooted = c.startswith(scheme)
    rest = F.when(rooted, F.substring(c, len(scheme) + 1, 1_000_000)).otherwise(c)
    file = _none(F.trim(F.substring_index(rest, "#", 1)))
    anchor = F.when(rest.contains("#"), _none(F.trim(F.regexp_replace(rest, r"^[^#]*#", ""))))
    return F.when(file.isNotNull() | anchor.isNotNull(), F.struct(file.alias("file"), anchor.alias("anchor"), rooted.alias("root_relative")))


def embed_target(body: Column | str, scheme: str = ROOT_SCHEME) -> Column:
    """As ``wikilink_target``, but an anchor alone names no file and gives null."""
    t = wikilink_target(body, scheme)
    return F.when(t["file"].isNotNull(), t)


def heading_text(raw: Column | str) -> Column:
    """The words of a heading: links by their text, wikilinks by label or target, no backticks, one kind of apostrophe."""
    c = F.regexp_replace(_c(raw), r"!?\[\[[^\]|]*\|([^\]]*)\]\]", "$1")
    c = F.regexp_replace(c, r"!?\[\[([^\]]*)\]\]", "$1")
    c = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(F.regexp_replace(c, "`", ""), "'", "’")
    return F.trim(F.regexp_replace(c, r"\s+", " "))
