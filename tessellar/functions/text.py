"""Words, ids and short texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of symbols whose display ends in brackets, and words that stand before a name.
CALLABLE = ("fn", "method", "constructor", "getter", "setter", "macro")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def terms(text: Column | str) -> Column:
    """Lower-case runs of letters and digits in order; empty for null text."""
    return F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def truncate_chars(text: Column | str, size: int) -> Column:
    """The first ``size`` characters with ``...`` behind, if there are more."""
    c = _c(text)
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def external_id(alias: Column | str, seq: Column | str, suffix: Column | str | None = None) -> Column:
    """``ALIAS-0007`` with the dotted places of sub-items behind; four digits at least."""
    base = F.concat(_c(alias), F.lit("-"), F.format_string("%04d", _c(seq)))
    return base if suffix is None else F.concat(base, F.coalesce(_c(suffix), F.lit("")))


def parse_external_id(text: Column | str) -> Column:
    """(alias, seq, children) of an external id, split at the last dash; null if it is none."""
    c = F.trim(_c(text))
    pattern = r"^(.+)-(\d+)((?:\.\d+)*)$"
    children = F.transform(F.filter(F.split(F.regexp_extract(c, pattern, 3), r"\."), lambda x: x != ""), lambda x: x.cast("long"))
    value = F.struct(F.upper(F.regexp_extract(c, pattern, 1)).alias("alias"), F.regexp_extract(c, pattern, 2).cast("long").alias("seq"), children.alias("children"))
    return F.when(c.rlike(pattern) & ~F.exists(children, lambda x: x < 1), value)


def default_order(number: Column | str) -> Column:
    """The order key of an item that was never moved: its number in twelve digits, so text order is number order; null without one."""
    return F.when(_c(number).isNotNull(), F.format_string("%012d", _c(number)))


def symbol_display(name: Column | str, display_kind: Column | str, kind: Column | str, parent: Column | str) -> Column:
    """How an outline shows a symbol: members indented, the kind in front, brackets behind what can be called."""
    k = _c(display_kind)
    front = F.when(F.length(F.trim(k)) > 0, F.concat(k, F.lit(" "))).otherwise("")
    brackets = F.when(_c(kind).isin(*CALLABLE), "()").otherwise("")
    indent = F.when(_c(parent).isNotNull(), "  ").otherwise("")
    return F.concat(indent, front, _c(name), brackets)


def alias_ok(alias: Column | str) -> Column:
    """Upper case, two to six characters, a letter and then a letter or digit in front."""
    c = _c(alias)
    return (c == F.upper(c)) & F.length(c).between(2, 6) & c.rlike("^[A-Z][A-Z0-9].*$")
