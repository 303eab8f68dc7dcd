"""Running totals and ranks without one task for all rows, and the scores that need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Value ranges that running totals are cut into; their borders are all that reaches the driver.
RANGES = 64


def running(df: DataFrame, by: str, amount: str, group: list[str] | None = None) -> DataFrame:
    """df with `below`: the sum of amount over the rows of the same group with a smaller `by` (numeric, distinct there).

    Values fall into ranges between approximate quantiles; totals of ranges are summed up to RANGES rows a group,
    running sums inside a range are windows of their own. A null `by` comes before all others.
    """
    group = group or []
    borders = df.approxQuantile(by, [i / RANGES for i in range(1, RANGES)], 0.005)
    at = F.size(F.filter(F.array(*[F.lit(float(b)) for b in sorted(set(borders))]).cast("array<double>"), lambda b: b <= F.col(by))) if borders else F.lit(0)
    cut = df.withColumn("__range", F.when(F.col(by).isNull(), F.lit(-1)).otherwise(at))
    totals = cut.groupBy(*group, "__range").agg(F.sum(amount).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy(*group, F.lit(0)).orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__range").alias("__r"), before.alias("__before"))
    match = F.col("__range") == F.col("__r")
    for g in group:
        match = match & F.col(g).eqNullSafe(F.col(f"__{g}"))
    inside = F.coalesce(F.sum(amount).over(W.partitionBy(*group, "__range").orderBy(by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return cut.withColumn("__inside", inside).join(offsets, match).withColumn("below", F.col("__before") + F.col("__inside")).select(*df.columns, "below")


def mean_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """(value, name): the rank of every distinct value, from 1; equal values share their mean rank."""
    n = df.groupBy(value).agg(F.count("*").alias("__n"))
    return running(n, value, "__n").select(value, (F.col("below") + (F.col("__n") + 1) / 2).alias(name))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """(pearson, spearman) of two numeric columns; rows with a null in either are left out."""
    held = df.select(a, b).dropna()
    ranked = held.join(mean_ranks(held, a, "__a"), a).join(mean_ranks(held, b, "__b"), b)
    return ranked.agg(F.corr(a, b).alias("pearson"), F.corr("__a", "__b").alias("spearman"))


def auc(scores: DataFrame, score: str, good: str) -> DataFrame:
    """The rank-sum AUC; equal scores share their mean rank. Ranks come from counts of each score."""
    by = scores.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(good).cast("long")).alias("g"))
    ranked = running(by, score, "n")
    t = ranked.agg(F.sum(F.col("g") * (F.col("below") + (F.col("n") + 1) / 2)).alias("r"), F.sum("g").cast("double").alias("p"), F.sum(F.col("n") - F.col("g")).cast("double").alias("q"))
    return t.select(((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def nearest_rank(df: DataFrame, group: list[str], value: str, percent: float) -> DataFrame:
    """Per group the value at the rank round(percent / 100 * n + 0.5), half to even, kept inside 1 to n."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    ends = running(counts, value, "__n", group)
    size = counts.groupBy(*group).agg(F.sum("__n").alias("__all"))
    rank = F.least(F.greatest(F.bround(F.col("__all") * percent / 100 + 0.5), F.lit(1)), F.col("__all"))
    return ends.join(size, group).filter((F.col("below") < rank) & (rank <= F.col("below") + F.col("__n"))).select(*group, value)


def contingency(pairs: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts n of each pair of labels, of each a and of each b."""
    cell = pairs.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    return cell, cell.groupBy(a).agg(F.sum("n").alias("n")), cell.groupBy(b).agg(F.sum("n").alias("n"))


def agreement(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(nmi, ari) of two labellings: mutual information over the mean entropy, and the adjusted Rand index."""
    two = lambda c: F.sum(c * (c - 1) / 2)

    def sums(d: DataFrame, s: str) -> DataFrame:
        return d.agg(F.sum("n").alias(f"t{s}"), F.sum(F.col("n") * F.log("n")).alias(f"l{s}"), two(F.col("n")).alias(f"c{s}"))

    cell, rows, cols = contingency(pairs, a, b)
    one = sums(cell, "x").crossJoin(sums(rows, "a")).crossJoin(sums(cols, "b"))  # one row each
    entropy = lambda s: F.log("tx") - F.col(f"l{s}") / F.col("tx")
    h = one.select("*", entropy("a").alias("ha"), entropy("b").alias("hb"), entropy("x").alias("hab"))
    expected = F.col("ca") * F.col("cb") / (F.col("tx") * (F.col("tx") - 1) / 2)
    most = (F.col("ca") + F.col("cb")) / 2
    nmi = F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * (F.col("ha") + F.col("hb") - F.col("hab")) / (F.col("ha") + F.col("hb")))
    return h.select(nmi.alias("nmi"), F.when(most == expected, 1.0).otherwise((F.col("cx") - expected) / (most - expected)).alias("ari"))


def calibration(df: DataFrame, predicted: str, good: str, bins: int) -> DataFrame:
    """Per bin of equal width: rows, mean prediction, share of good ones, sum of squared errors."""
    p, g = F.col(predicted), F.col(good).cast("double")
    at = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_predicted"), F.avg(g).alias("share_good"), F.sum((p - g) * (p - g)).alias("squares"))


def wilson(df: DataFrame, group: list[str], good: str, z: float = 1.96) -> DataFrame:
    """Per group: rows, good ones, and the Wilson interval of the share."""
    per = df.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(good).alias("n_good"))
    n, p = F.col("n"), F.col("n_good") / F.col("n")
    centre, spread = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return per.select("*", (centre - spread).alias("low"), (centre + spread).alias("high"))


def edges_prf(found: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(found, truth, both, precision, recall, f1) of two sets of rows."""
    side = lambda d, f, t: d.select(*keys, F.lit(f).alias("f"), F.lit(t).alias("t"))
    each = side(found, 1, 0).union(side(truth, 0, 1)).groupBy(*keys).agg(F.max("f").alias("f"), F.max("t").alias("t"))
    n = each.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("found"), F.coalesce(F.sum("t"), F.lit(0)).alias("truth"), F.coalesce(F.sum(F.col("f") * F.col("t")), F.lit(0)).alias("both"))
    return n.select("*", F.try_divide("both", "found").alias("precision"), F.try_divide("both", "truth").alias("recall"), F.try_divide(2 * F.col("both"), F.col("found") + F.col("truth")).alias("f1"))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))
