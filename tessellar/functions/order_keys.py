"""Keys between two keys, in base 36, for items that are moved by hand."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
MIDDLE = "i"


def _between_digits(low: str, high: str | None) -> str:
    """A key above ``low`` and below ``high`` (open where None), read as fractions; the shortest that a midpoint gives."""
    out = ""
    i = 0
    while True:
        if high is not None and i >= len(high):
            raise ValueError(f"no key between {low!r} and {high!r}")
        a = DIGITS.index(low[i]) if i < len(low) else 0
        b = DIGITS.index(high[i]) if high is not None else 36
        if a == b:
            out += DIGITS[a]
            i += 1
            continue
        middle = (a + b) // 2
        if middle > a:
            return out + DIGITS[middle]
        out += DIGITS[a]
        i += 1
        high = None


def key_between(before: str | None, after: str | None) -> str:
    """A key that sorts between two keys (bytewise); raises ValueError where there is none.

    Without keys it is the middle digit. A key of zeros only has nothing before it.
    """
    low, high = before or "", after
    if high is not None and (low >= high or not high.strip("0")):
        raise ValueError(f"no key between {before!r} and {after!r}")
    if not low and high is None:
        return MIDDLE
    return _between_digits(low, high)


@F.pandas_udf(StringType())
def order_between(before: pd.Series, after: pd.Series) -> pd.Series:
    """``key_between`` as a column function; null where there is no key."""

    def one(a, b):
        try:
            return key_between(a if isinstance(a, str) else None, b if isinstance(b, str) else None)
        except ValueError:
            return None

    return pd.Series([one(a, b) for a, b in zip(before, after)], dtype=object)
