"""Use as it arrives: the same operators on a stream and on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, ts: str, kind: str, value: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, kind, n, total): events and the sum of their values by window and kind. On a stream a window ends `late` after its last event; what comes later than that is left out. Null times are left out."""
    kept = events.filter(F.col(ts).isNotNull())
    kept = kept.withWatermark(ts, late) if events.isStreaming else kept
    out = kept.groupBy(F.window(ts, size).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, ts: str, who: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(who, start, end, n): a person's events without a pause of `gap`; end is a pause after the last of them."""
    kept = events.filter(F.col(ts).isNotNull() & F.col(who).isNotNull())
    kept = kept.withWatermark(ts, late) if events.isStreaming else kept
    out = kept.groupBy(F.session_window(ts, gap).alias("w"), who).agg(F.count("*").alias("n"))
    return out.select(who, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
