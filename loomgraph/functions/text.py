"""Text as columns: values masked, query texts without their literals, calendar ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is masked, in this order: (pattern, mask).
MASKS = (
    (r"'[^'\n]*'|\"[^\"\n]*\"", "<text>"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "<email>"),
    (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", "<uuid>"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "<date>"),
    (r"[0-9]{3,}", "<number>"),
)


def masked(text: Column) -> Column:
    """text with its values replaced; null stays null."""
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def fingerprint(query: Column) -> Column:
    """The SHA-256 of a query without comments, literals, letter case and spacing: equal shapes, equal fingerprints.

    A null query has none. Comments go before literals, so a comment sign inside a literal is taken for a comment.
    """
    for pattern, mask in ((r"--[^\n]*", " "), (r"(?s)/\*.*?\*/", " "), (r"'(?:[^']|'')*'", "?"), (r"\b[0-9]+(?:\.[0-9]+)?\b", "?"), (r"[\x20\x09-\x0D]+", " "), (r" ?([(),=<>+*/;-]) ?", "$1")):
        query = F.regexp_replace(query, pattern, mask)
    return F.sha2(F.lower(F.trim(F.regexp_replace(query, ";+$", ""))), 256)


def element_id(kind: Column, name: Column) -> Column:
    """A kind and the first twelve hexadecimal digits of a name's SHA-1."""
    return F.concat_ws(":", kind, F.substring(F.sha1(name.cast("binary")), 1, 12))


def window_start(day: Column, quarters: int) -> Column:
    """The first day of the quarter so many quarters before a day's own."""
    return F.to_date(F.add_months(F.trunc(day, "quarter"), -3 * quarters))


def last_range(day: Column, grain: str) -> tuple[Column, Column]:
    """The first and the last day of the month, quarter or year before a day's own."""
    months = {"month": 1, "quarter": 3, "year": 12}[grain]
    start = F.trunc(day, grain)
    return F.to_date(F.add_months(start, -months)), F.date_sub(start, 1)
