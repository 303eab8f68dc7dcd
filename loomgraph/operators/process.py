"""Process graphs of conversations: states and actions, how they follow each other and how conversations end."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.sources.shared import stored


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, kind, digest, element): users' turns are states, assistants' are actions, others are left out.

    An element is its kind and the first hexadecimal digit of the text's SHA-1; a null text is empty.
    """
    kind = F.when(F.col("role") == "user", "state").when(F.col("role") == "assistant", "action")
    digest = F.sha1(F.coalesce("text", F.lit("")).cast("binary"))
    return conversations.select("conv_id", "turn", kind.alias("kind"), digest.alias("digest")).filter("kind is not null").withColumn("element", F.concat_ws(":", "kind", F.substring("digest", 1, 1)))


ORDER = ("turn", "kind", "digest")


def lift(steps: DataFrame) -> DataFrame:
    """(src, dst, num, count, ends, probability): a step counts when the next turn is of the other kind, else src ends."""
    w = W.partitionBy("conv_id").orderBy(*ORDER)
    near = steps.select("element", "kind", F.lead("element").over(w).alias("next"), F.lead("kind").over(w).alias("next_kind"))
    step = near.select(F.col("element").alias("src"), F.when(F.col("kind") != F.col("next_kind"), F.col("next")).alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("num"))
    whole = step.groupBy("src").agg(F.sum("num").alias("count"), F.coalesce(F.sum(F.when(F.col("dst").isNull(), F.col("num"))), F.lit(0)).alias("ends"))
    return step.filter("dst is not null").join(whole, "src").select("src", "dst", "num", "count", "ends", F.round(F.col("num") / F.col("count"), 6).alias("probability"))


def outcomes(steps: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_elements, last, good): the last turn decides; good when its digest's second digit is below 8."""
    last = F.max_by(F.struct("element", "digest"), F.struct(*ORDER))
    per = steps.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_distinct("element").alias("n_elements"), last.alias("l"))
    return per.select("conv_id", "n_turns", "n_elements", F.col("l.element").alias("last"), (F.substring("l.digest", 2, 1) < "8").alias("good"))


def touched(steps: DataFrame, ended: DataFrame) -> DataFrame:
    """(conv_id, element, good): each element of each conversation once."""
    return steps.select("conv_id", "element").distinct().join(ended.select("conv_id", "good"), "conv_id")


def empirical(steps: DataFrame, prior: float, floor: int) -> DataFrame:
    """(element, n, n_good, odds) over conversations through an element; odds are null below the floor."""
    ended = outcomes(steps)
    base = ended.agg(F.avg(F.col("good").cast("double")).alias("base"))
    per = touched(steps, ended).groupBy("element").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"))
    odds = (F.col("n_good") + prior * F.col("base")) / (F.col("n") + prior)
    return per.crossJoin(F.broadcast(base)).select("element", "n", "n_good", F.when(F.col("n") >= floor, odds).alias("odds"))  # base is one row


def leave_one_out(steps: DataFrame, prior: float, floor: int) -> DataFrame:
    """(n, covered, brier): every conversation's end foretold from its last element, from the others' counts alone.

    Counts without a conversation are totals less its own; below the floor of what remains nothing is foretold.
    """
    ended = outcomes(steps)
    total = ended.agg(F.count("*").alias("all"), F.count_if("good").alias("all_good"))
    per = touched(steps, ended).groupBy("element").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"))
    own = F.col("good").cast("long")
    base = F.try_divide(F.col("all_good") - own, F.col("all") - 1)
    odds = (F.col("n_good") - own + prior * base) / (F.col("n") - 1 + prior)
    told = ended.join(per, ended["last"] == per["element"]).crossJoin(F.broadcast(total)).select("good", F.when(F.col("n") - 1 >= floor, odds).alias("odds"))
    error = F.col("odds") - F.col("good").cast("double")
    return told.agg(F.count("*").alias("n"), F.count("odds").alias("covered"), F.avg(error * error).alias("brier"))


#: Elements whose chain is solved on the driver; the counts between more of them are joined in rounds instead.
SMALL = 5_000


def chain_counts(steps: DataFrame) -> DataFrame:
    """(element, next, num): how often the turn after one of an element is of the other kind, by that turn's element."""
    w = W.partitionBy("conv_id").orderBy(*ORDER)
    near = steps.select("element", "kind", F.lead("element").over(w).alias("next"), F.lead("kind").over(w).alias("next_kind"))
    return near.filter("kind <> next_kind").groupBy("element", "next").agg(F.count("*").alias("num"))


def absorbing_chain(steps: DataFrame, prior: float = 5.0, tolerance: float = 1e-9, rounds: int = 100_000, small: int = SMALL) -> DataFrame:
    """(element, chance): the chance that a conversation at an element ends well, by the chain of its next elements."""
    ended = outcomes(steps).select("conv_id", "last", F.lit("good").alias("outcome"), F.col("good").cast("long").alias("hit"))
    return absorbed(steps, ended, prior, tolerance, rounds, small).select("element", "chance")


def chain_kinds(steps: DataFrame, ended: DataFrame, prior: float = 5.0, tolerance: float = 1e-9, rounds: int = 100_000, small: int = SMALL) -> DataFrame:
    """(outcome, element, chance): for each kind of outcome of ended (conv_id, last, outcome) the chance that a case at an element ends so."""
    kinds = ended.select("outcome").distinct().withColumnRenamed("outcome", "k")
    each = ended.crossJoin(F.broadcast(kinds))  # kinds are few by definition; a row a case and kind
    return absorbed(steps, each.select("conv_id", "last", F.col("k").alias("outcome"), (F.col("outcome") == F.col("k")).cast("long").alias("hit")), prior, tolerance, rounds, small)


def likely(chances: DataFrame, shown: int) -> DataFrame:
    """(element, outcome, chance, rank): an element's likeliest outcomes; equal ones by name."""
    spot = F.row_number().over(W.partitionBy("element").orderBy(F.desc("chance"), "outcome"))
    return chances.select("element", "outcome", "chance", spot.alias("rank")).filter(F.col("rank") <= shown)


def absorbed(steps: DataFrame, ended: DataFrame, prior: float, tolerance: float, rounds: int, small: int) -> DataFrame:
    """(outcome, element, chance) of ended (conv_id, last, outcome, hit): hit is 1 where the case ended so, else 0.

    chance(e) = (sum of num(e, y) * chance(y) + fin(e) * smoothed(e)) / (sum of num + fin(e)), where fin(e) cases ended
    at e, and smoothed pulls their share toward the base rate by `prior` cases. An element that nothing leaves and where
    nothing ended has the base rate. Counts are folded first; up to `small` elements are solved on the driver, more of
    them by joins, eight rounds to a job. It is an error if chances still move by the tolerance after all rounds.
    """
    pairs = stored(chain_counts(steps), "steps")
    fin = ended.groupBy("outcome", F.col("last").alias("element")).agg(F.count("*").alias("fin"), F.sum("hit").alias("hits"))
    base = ended.groupBy("outcome").agg(F.avg(F.col("hit").cast("double")).alias("base"))
    out = pairs.groupBy("element").agg(F.sum("num").alias("out"))
    every = steps.select("element").distinct().crossJoin(F.broadcast(base))  # a row an outcome
    each = every.join(fin, ["outcome", "element"], "left").join(out, "element", "left").na.fill(0, ["fin", "hits", "out"])
    ending = F.col("fin") * (F.col("hits") + prior * F.col("base")) / (F.col("fin") + prior)
    each = stored(each.select("outcome", "element", "base", F.when(F.col("fin") > 0, ending).otherwise(F.lit(0.0)).alias("ending"), (F.col("fin") + F.col("out")).alias("leaving")), "elements")
    if steps.select("element").distinct().limit(small + 1).count() <= small:
        return solved(pairs, each, tolerance, rounds)
    chance = each.select("outcome", "element", F.col("base").alias("chance"))

    def turn(now: DataFrame, _: int) -> DataFrame:
        came = pairs.join(now.select("outcome", F.col("element").alias("next"), "chance"), "next").groupBy("outcome", "element").agg(F.sum(F.col("num") * F.col("chance")).alias("came"))
        new = (F.coalesce("came", F.lit(0.0)) + F.col("ending")) / F.col("leaving")
        return each.join(came, ["outcome", "element"], "left").select("outcome", "element", F.when(F.col("leaving") > 0, new).otherwise(F.col("base")).alias("chance"))

    for _ in range(-(-rounds // 8)):
        near = stored(reduce(turn, range(7), chance), "chance")
        chance = stored(turn(near, 0), "chance")
        moved = chance.join(near.withColumnRenamed("chance", "was"), ["outcome", "element"]).agg(F.max(F.abs(F.col("chance") - F.col("was")))).first()[0]
        if moved is None or moved < tolerance:
            return chance
    raise ValueError(f"the chain has not settled to {tolerance} in {rounds} rounds")


def solved(pairs: DataFrame, each: DataFrame, tolerance: float, rounds: int) -> DataFrame:
    """The same chances from counts on the driver, of a checked number of elements."""
    rows = each.collect()
    at = {e: i for i, e in enumerate(sorted({r["element"] for r in rows}))}
    found = [(at[r["element"]], at[r["next"]], r["num"]) for r in pairs.collect()]
    src, dst, num = (np.array([f[c] for f in found], np.int64) for c in range(3))
    out = []
    for kind in sorted({r["outcome"] for r in rows}):
        own = [r for r in rows if r["outcome"] == kind]
        base, ending, leaving = (np.zeros(len(at)) for _ in range(3))
        for r in own:
            i = at[r["element"]]
            base[i], ending[i], leaving[i] = r["base"], r["ending"], r["leaving"]
        h, open_ = base.copy(), leaving > 0
        for _ in range(rounds):
            came = np.bincount(src, num * h[dst], len(at)) + ending
            new = np.where(open_, came / np.where(open_, leaving, 1), base)
            moved = np.abs(new - h).max(initial=0.0)
            h = new
            if moved < tolerance:
                break
        else:
            raise ValueError(f"the chain has not settled to {tolerance} in {rounds} rounds")
        out += [(kind, r["element"], float(h[at[r["element"]]])) for r in own]
    return pairs.sparkSession.createDataFrame(out, "outcome string, element string, chance double")
