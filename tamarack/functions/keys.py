"""Canonical forms of keys that sources write differently."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries that stand for "no value".
NOT_KNOWN = ("", "-", "--", "?", "unknown", "not known", "nan", "none", "null", "nil", "n/a", "na", "not available", "not available (nan)", "not recorded", "unavailable")

#: White space of any kind, zero-width characters and quotes.
_EDGE = r"[\s\x{00a0}\x{200b}-\x{200d}\x{feff}\"'`]+"
EDGE_SPACE = f"^{_EDGE}|{_EDGE}$"


#: Numbers as they should be, and texts too long to be a word of NOT_KNOWN: most keys need nothing else done.
PLAIN_NUMBER = r"^[1-9][0-9]{0,17}$"
PLAIN_TEXT = r"^[0-9A-Za-z]{12,}$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACE, "")


def stripped(c: Column) -> Column:
    """A text without white space, zero-width characters and quotes at its ends; clean texts are only tested."""
    return F.when(c.rlike(r"^[0-9A-Za-z](?:.*[0-9A-Za-z])?$"), c).otherwise(_strip(c))


def is_known(c: Column) -> Column:
    """True where a text names something: not null, not blank and not a word for an unknown value."""
    return c.isNotNull() & (c.rlike(PLAIN_NUMBER) | c.rlike(PLAIN_TEXT) | ~F.lower(_strip(c)).isin(*NOT_KNOWN))


def entity_number(c: Column, prefixes: str = "pt|patient|lab|laboratory|hero|c") -> Column:
    """The number in an id such as "PT-0012", "pt 12", "12.0" or " 12", without leading zeros; null for any other text."""
    digits = F.regexp_extract(_strip(c), rf"(?i)^(?:(?:{prefixes})?[\s\-_#:.]*)0*([0-9]{{1,18}})(?:\.0+)?$", 1)
    return F.when(c.rlike(PLAIN_NUMBER), c).otherwise(F.when(digits != "", digits))
