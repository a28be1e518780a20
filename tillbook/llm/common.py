"""Column helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of the words ``[^\x20\x09-\x0D]+`` (fixed by the contracts).
SPACE_RE = r"[\x20\x09-\x0D]+"
#: Separators of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a lower-cased text, for a text not lower-cased yet.
LETTER_RE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows below this number may be broadcast: the tables meant here have under 200 bytes a row, so 40 MB at most.
BROADCAST_ROWS = 200_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: the expression stays linear in size."""
    return F.transform(F.array(value), body)[0]


def split_words(text: Column, separators: str) -> Column:
    """The words of a text; the first and last entry may be empty. A null text gives an array with one empty entry."""
    return F.split(F.coalesce(text, F.lit("")), separators, -1)


def count_words(text: Column, separators: str) -> Column:
    """Number of words of a text, 0 for a null text."""
    return let(split_words(text, separators), lambda w: (
        F.size(w) - (w[0] == "").cast("int")
        - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")).cast("long"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character left as it is."""
    return F.translate(text, UPPER, LOWER)


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) that depends on nothing but the columns."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def free_name(base: str, taken) -> str:
    """``base``, with underscores until no column in ``taken`` has that name in any letter case."""
    taken = {c.lower() for c in taken}
    while base.lower() in taken:
        base += "_"
    return base


def small_or_joined(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if ``rows``, counted by the caller, is within the bound; else the table as it is."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
