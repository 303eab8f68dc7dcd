"""Operators over logs, turns, contexts and scores, each a declarative DataFrame plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def log_groups(log: DataFrame, keys: list[str], ts: str, value: str, error: Column) -> DataFrame:
    """One row for each key combination and Monday week: counts, errors, sums, first and last time, distinct days."""
    week = F.to_date(F.date_trunc("week", F.col(ts))).alias("week")
    return log.groupBy(*keys, week).agg(
        F.count("*").alias("jobs"), F.count_if(error).alias("errors"), F.sum(value).alias("total"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count_distinct(F.to_date(ts)).alias("n_days")
    )


def principal_profiles(log: DataFrame, principal: str, ts: str, least: float = 0.5) -> DataFrame:
    """Per principal: jobs, active days, weekend and business-hour jobs, recurring (hour, minute) slots, daily variation."""
    day = F.to_date(ts)
    base = log.groupBy(principal).agg(
        F.count("*").alias("jobs"), F.count_distinct(day).alias("active_days"),
        F.count_if(F.dayofweek(ts).isin(1, 7)).alias("weekend_jobs"), F.count_if(F.hour(ts).between(9, 17) & ~F.dayofweek(ts).isin(1, 7)).alias("business_jobs"),
    )
    slots = log.groupBy(principal, F.hour(ts).alias("h"), F.minute(ts).alias("m")).agg(F.count_distinct(day).alias("slot_days"))
    kept = slots.join(base.select(principal, "active_days"), principal).groupBy(principal).agg(F.count_if(F.col("slot_days") >= least * F.col("active_days")).alias("recurring_slots"))
    daily = log.groupBy(principal, day.alias("d")).agg(F.count("*").alias("n")).groupBy(principal).agg(F.try_divide(F.stddev_samp("n"), F.avg("n")).alias("daily_cv"))
    return base.join(kept, principal).join(daily, principal)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def transitions(turns: DataFrame, conversation: str, seq: list[str], element: str) -> DataFrame:
    """(src, dst, num, count, probability): consecutive elements of a conversation, against how often src occurs."""
    w = W.partitionBy(conversation).orderBy(*seq)
    step = turns.select(F.col(element).alias("src"), F.lead(element).over(w).alias("dst"))
    counts = step.groupBy("src").agg(F.count("*").alias("count"))
    pairs = step.filter("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("num"))
    return pairs.join(counts, "src").select("src", "dst", "num", "count", F.round(F.col("num") / F.col("count"), 6).alias("probability"))


def smoothed_odds(touched: DataFrame, element: str, good: str, prior: float, floor: int) -> DataFrame:
    """Per element: conversations, good ones, and the good share pulled to the base rate by `prior` pseudo-conversations."""
    base = touched.agg(F.avg(F.col(good).cast("double")).alias("base"))
    per = touched.groupBy(element).agg(F.count("*").alias("n"), F.sum(F.col(good).cast("long")).alias("n_good"))
    return per.crossJoin(F.broadcast(base)).filter(F.col("n") >= floor).select(element, "n", "n_good", ((F.col("n_good") + prior * F.col("base")) / (F.col("n") + prior)).alias("odds"))


def capped_context(anchors: DataFrame, rows: DataFrame, key: str, fk: str, date: str, since: str, until: str, order: list[Column], cap: int) -> DataFrame:
    """For every anchor the latest `cap` of its rows inside the window, and whether there were more."""
    w = W.partitionBy(fk)
    inside = rows.filter((F.to_date(date) >= F.lit(since).cast("date")) & (F.to_date(date) <= F.lit(until).cast("date"))).join(anchors.select(F.col(key).alias("__a")), F.col(fk) == F.col("__a"), "left_semi")
    ranked = inside.withColumn("rank", F.row_number().over(w.orderBy(*order))).filter(F.col("rank") <= cap + 1)
    return ranked.withColumn("capped", F.max("rank").over(w) > cap).filter(F.col("rank") <= cap)


def cadence_days(writes: DataFrame, key: str, ts: str) -> DataFrame:
    """Per key the median gap, in days, between distinct days of writing."""
    days = writes.select(key, F.to_date(ts).alias("d")).distinct()
    gap = F.datediff("d", F.lag("d").over(W.partitionBy(key).orderBy("d")))
    return days.withColumn("gap", gap).filter("gap is not null").groupBy(key).agg(F.percentile("gap", 0.5).alias("cadence"))


def superseded(facts: DataFrame, subject: list[str], at: str) -> DataFrame:
    """Facts with the time at which a later one of the same subject replaces them; the current one has none."""
    return facts.withColumn("valid_until", F.lead(at).over(W.partitionBy(*subject).orderBy(at)))


def v_measure(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(homogeneity, completeness, v) of clustering b against classes a, from their contingency table."""
    cell = pairs.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    rows = cell.groupBy(a).agg(F.sum("n").alias("n"))
    cols = cell.groupBy(b).agg(F.sum("n").alias("n"))
    ent = lambda d, name: d.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s")).select((F.log("t") - F.col("s") / F.col("t")).alias(name))
    h = ent(rows, "ha").crossJoin(ent(cols, "hb")).crossJoin(ent(cell, "hab"))
    hom = F.when(F.col("ha") == 0, 1.0).otherwise(1 - (F.col("hab") - F.col("hb")) / F.col("ha"))
    com = F.when(F.col("hb") == 0, 1.0).otherwise(1 - (F.col("hab") - F.col("ha")) / F.col("hb"))
    return h.select(hom.alias("homogeneity"), com.alias("completeness")).withColumn("v", 2 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness")))
