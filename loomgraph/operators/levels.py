"""Levels of a process graph: likeness by transitions, parents and their centres, folding, outcomes by kind, outlooks.

Elements are few beside turns: turns are folded to counts before anything is compared.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.operators import process as P
from loomgraph.operators.graph import units
from loomgraph.sources.shared import stored


def transition_vectors(steps: DataFrame) -> DataFrame:
    """(element, side, other, x): whom an element leads to (out) and follows (in), as counts scaled to length 1."""
    pairs = P.chain_counts(steps)
    out = pairs.select("element", F.lit("out").alias("side"), F.col("next").alias("other"), "num")
    both = out.unionByName(pairs.select(F.col("next").alias("element"), F.lit("in").alias("side"), F.col("element").alias("other"), "num"))
    counts = both.groupBy("element", "side", "other").agg(F.sum("num").cast("double").alias("num"))
    length = counts.groupBy("element").agg(F.sqrt(F.sum(F.col("num") * F.col("num"))).alias("length"))
    return counts.join(length, "element").select("element", "side", "other", (F.col("num") / F.col("length")).alias("x"))


def alike(vectors: DataFrame) -> DataFrame:
    """(a, b, cosine), a < b: elements whose vectors (element, side, other, x) have a place in common."""
    right = vectors.select(F.col("element").alias("b"), "side", "other", F.col("x").alias("y"))
    met = vectors.withColumnRenamed("element", "a").join(right, ["side", "other"]).filter("a < b")
    return met.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))


def blended(links: DataFrame, cosines: DataFrame, share: float) -> DataFrame:
    """links (a, b, w) with `share` of the weight from how alike the transitions are; lone nodes stay lone."""
    w = (1 - share) * F.col("w") + share * F.coalesce("cosine", F.lit(0.0))
    return links.join(cosines, ["a", "b"], "left").select("a", "b", F.when(F.col("b").isNotNull(), F.greatest(w, F.lit(1e-6))).alias("w"))


def parent_id(kind: Column, level: Column, children: Column) -> Column:
    """The id of a parent of these children, whatever their order and the parent's name."""
    return F.concat(kind, F.lit(":L"), level.cast("string"), F.lit(":"), F.substring(F.sha1(F.array_join(F.array_sort(children), "|").cast("binary")), 1, 12))


def parents(members: DataFrame, kind: str, level: int, group: str, child: str) -> DataFrame:
    """(kind, parent, child) for groups of two or more children; children of a group are gathered, as its id asks."""
    held = members.groupBy(kind, group).agg(F.collect_set(F.col(child).cast("string")).alias("c")).filter(F.size("c") > 1)
    return held.select(kind, parent_id(F.col(kind).cast("string"), F.lit(level), F.col("c")).alias("parent"), F.explode("c").alias("child"))


def centroids(rows: DataFrame, group: str, weight: str, vector: str) -> DataFrame:
    """(group, i, x): the mean of a group's vectors, weighted, scaled to length 1, one coordinate a row."""
    each = rows.select(group, F.col(weight).cast("double").alias("w"), F.posexplode(vector).alias("i", "x"))
    mean = each.groupBy(group, "i").agg((F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    length = mean.groupBy(group).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    return mean.join(length, group).select(group, "i", F.try_divide("x", "length").alias("x"))


def fold(groups: DataFrame, kind: str, key: str, size: str, vector: str, cut: float) -> DataFrame:
    """(kind, key, kept): which kept element each joins: the first, by size and then by key, that is as near as `cut`.

    An element joins only what was kept before it, never what joined something, so nothing chains. What comes first
    decides, so a kind is one task; elements of a kind are named groups, not turns.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([size, key], ascending=[False, True]).reset_index(drop=True)
        m, kept, home = units(pd_array(rows[vector])), [], []
        for i in range(len(rows)):
            near = m[kept] @ m[i] >= cut if kept else np.zeros(0, bool)
            j = kept[int(near.argmax())] if near.any() else i
            if j == i:
                kept.append(i)
            home.append(rows[key][j])
        return pd.DataFrame({kind: rows[kind], key: rows[key], "kept": home})

    types = {f.name: f.dataType.simpleString() for f in groups.schema}
    return groups.select(kind, key, size, vector).groupBy(kind).applyInPandas(one, f"{kind} {types[kind]}, {key} {types[key]}, kept {types[key]}")


def pd_array(column: pd.Series):
    import pyarrow as pa

    return pa.array([[float(x) for x in v] for v in column])


def small_to_nearest(rows: DataFrame, group: str, key: str, vector: str, least: int) -> DataFrame:
    """(key, group): members of groups below `least` go to the group of `least` or more with the nearest centre.

    Without such a group all stay; of equally near ones the first by name. Groups are few: centres are compared by join.
    """
    size = rows.groupBy(group).agg(F.count("*").alias("n"))
    n_big = size.filter(F.col("n") >= least).limit(1).count()
    if not n_big:
        return rows.select(key, group)
    weighted = rows.withColumn("__w", F.lit(1.0))
    centre = stored(centroids(weighted, group, "__w", vector).join(size, group), "centres")
    big = centre.filter(F.col("n") >= least).select(F.col(group).alias("to"), "i", F.col("x").alias("y"))
    near = centre.filter(F.col("n") < least).join(big, "i").groupBy(group, "to").agg(F.round(F.sum(F.col("x") * F.col("y")), 9).alias("cosine"))
    to = near.groupBy(group).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "to"))["to"].alias("to"))
    return rows.select(key, group).join(to, group, "left").select(key, F.coalesce("to", F.col(group)).alias(group))


def ancestors(elements: DataFrame, parent_of: DataFrame, level: int, hops: int) -> DataFrame:
    """(element, ancestor): the highest ancestor of each no higher than `level`; parent_of is (child, parent, level of the parent)."""
    up = parent_of.filter(F.col("level") <= level).select(F.col("child").alias("c"), F.col("parent").alias("p"))
    out = elements.select("element", F.col("element").alias("ancestor"))
    for _ in range(hops):
        out = out.join(up, F.col("ancestor") == F.col("c"), "left").select("element", F.coalesce("p", "ancestor").alias("ancestor"))
    return out


def last_states(steps: DataFrame, upto: Column | None = None) -> DataFrame:
    """(conv_id, turn, element): a conversation's latest turn of a state, up to a turn if given; conversations without one are left out."""
    shown = steps.filter("kind = 'state'")
    shown = shown if upto is None else shown.filter(F.col("turn") <= upto)
    last = F.max_by(F.struct("turn", "element"), F.struct(*P.ORDER)).alias("l")
    return shown.groupBy("conv_id").agg(last).select("conv_id", "l.turn", "l.element")


def outlook(located: DataFrame, states: DataFrame, nexts: DataFrame, actions: DataFrame, base: float, states_used: int, temperature: float, floor: float, prior: float, pull: float) -> tuple[DataFrame, DataFrame]:
    """What located states foretell: (query, support, end_well), and (query, action, probability, support, end_well_after, common, recommended).

    located (query, state, cosine); states (state, n, good); nexts (state, action, n, good); actions (action, n, good).
    The states_used nearest states count, by exp((cosine - best) / temperature), or the best alone at 0. Shares are
    pulled to the base rate by `prior` cases, an action's to its own rate by `pull`; below `floor` support nothing is
    said. Ranks are null below the floor too; equal ones go by the action's name.
    """
    spot = F.row_number().over(W.partitionBy("query").orderBy(F.desc("cosine"), "state"))
    near = located.withColumn("r", spot).filter(F.col("r") <= states_used)
    best = F.max("cosine").over(W.partitionBy("query"))
    weight = F.exp((F.col("cosine") - best) / temperature) if temperature > 0 else F.when(F.col("cosine") == best, 1.0).otherwise(0.0)
    near = near.select("query", "state", weight.alias("w"))
    smooth = lambda k, n, to, by: (k + by * to) / (n + by)
    mass = near.join(states, "state").groupBy("query").agg(F.sum(F.col("w") * F.col("n")).alias("support"), F.sum(F.col("w") * F.col("good")).alias("hits"))
    told = mass.select("query", "support", F.when(F.col("support") >= floor, smooth(F.col("hits"), F.col("support"), F.lit(base), prior)).alias("end_well"))
    each = near.join(nexts, "state").groupBy("query", "action").agg(F.sum(F.col("w") * F.col("n")).alias("support"), F.sum(F.col("w") * F.col("good")).alias("hits"))
    own = actions.select("action", smooth(F.col("good"), F.col("n"), F.lit(base), prior).alias("own"))
    whole = F.sum("support").over(W.partitionBy("query"))
    each = each.join(own, "action", "left").select("query", "action", (F.col("support") / whole).alias("probability"), "support", smooth(F.col("hits"), F.col("support"), F.coalesce("own", F.lit(base)), pull).alias("end_well_after"))
    common, good = W.partitionBy("query", F.col("support") >= floor).orderBy(F.desc("support"), "action"), W.partitionBy("query", F.col("support") >= floor).orderBy(F.desc("end_well_after"), F.desc("probability"), F.desc("action"))
    ranked = lambda w: F.when(F.col("support") >= floor, F.row_number().over(w))
    return told, each.select("*", ranked(common).alias("common"), ranked(good).alias("recommended"))


#: Numbers as a person says them.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def spoken(n: int) -> str:
    """0 to 999 in words, without hyphens."""
    if n >= 100:
        return f"{ONES[n // 100]} hundred" + (f" {spoken(n % 100)}" if n % 100 else "")
    if n >= 20:
        return TENS[n // 10 - 2] + (f" {ONES[n % 10]}" if n % 10 else "")
    return ONES[n]


def amount_forms(amount: float) -> list[str]:
    """The ways an amount of money is written or said, in lower case with blanks for hyphens; from 1000 on only in digits."""
    dollars, cents = divmod(math.floor(amount * 100 + 0.5), 100)
    out = [f"${dollars}.{cents:02d}", f"{dollars}.{cents:02d}"]
    if dollars >= 1000:
        return out
    whole = [spoken(dollars)] + ([f"a hundred {spoken(dollars % 100) if dollars % 100 else ''}".strip()] if 100 <= dollars < 200 else [])
    for said in whole:
        if not cents:
            out += [f"${dollars}", f"{said} dollars", f"{said} dollars and no cents"]
        else:
            tail = f"oh {spoken(cents)}" if cents < 10 else spoken(cents)
            out += [f"{said} dollars and {spoken(cents)} cent{'' if cents == 1 else 's'}", f"{said} {tail}", f"{said} dollars {tail}"]
    return out


def climb(nodes: DataFrame, kind: str, key: str, vector: str, weight: str, k: int, cut: float, most: int, least_nodes: int, shrink: float, gamma: float = 1.0) -> list[DataFrame]:
    """The levels above nodes (kind, key, vector, weight), each (kind, parent, child): communities of near ones, and of those again.

    A level ends the climb when it leaves more than `shrink` of the nodes below it, there are `least_nodes` or fewer, or
    `most` levels are made. A parent's vector is its children's weighted centre; nodes without a parent stay for the next
    level. Coarser levels use a smaller gamma, so groups grow.
    """
    from loomgraph.operators.communities import communities
    from loomgraph.operators.graph import near_links

    below = nodes.select(F.col(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(weight).cast("double").alias("w"))
    out: list[DataFrame] = []
    for level in range(2, most + 2):
        below = stored(below, "nodes")
        n = below.count()
        if n <= least_nodes:
            break
        links = near_links(below, k, cut, "id", "v", "kind").filter("b is not null")
        groups = communities(links, "a", "b", "w", gamma / max(1, level - 1))
        made = stored(parents(below.join(groups.withColumnRenamed("node", "id"), "id"), "kind", level, "community", "id"), "parents")
        sizes = made.agg(F.count("*").alias("children"), F.count_distinct("parent").alias("parents")).first()
        if not sizes["children"] or n - sizes["children"] + sizes["parents"] > shrink * n:
            break
        out.append(made)
        of = below.join(made.select("parent", F.col("child").alias("id")), "id")
        centre = centroids(of, "parent", "w", "v").groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
        new = of.groupBy("kind", "parent").agg(F.sum("w").alias("w")).join(centre, "parent").select("kind", F.col("parent").alias("id"), "v", "w")
        below = below.join(made.select(F.col("child").alias("id")), "id", "left_anti").select("kind", "id", "v", "w").unionByName(new)
    return out


def group_sizes(places: DataFrame, node: str, group: str, least: int = 2) -> DataFrame:
    """(group, n, bucket) of groups of `least` members or more; buckets by size: 2-5, 6-20, 21-100, over 100."""
    n = places.groupBy(group).agg(F.count(node).alias("n")).filter(F.col("n") >= least)
    return n.withColumn("bucket", F.when(F.col("n") <= 5, "2-5").when(F.col("n") <= 20, "6-20").when(F.col("n") <= 100, "21-100").otherwise("over 100"))
