"""Operators over edges and vectors: components, bounded reach, use in common, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.sources.shared import stored

#: Query vectors that one pass holds against all rows, on the driver and in each task; more of them take more passes.
BLOCK = 2_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of an edge with the smallest node that edges connect it to.

    The least label of the neighbours spreads, and labels jump to their own label, so a chain of n takes about log n
    rounds. Each round is written to the shared folder.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    both = stored(both.union(both.select("y", "x")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy("x").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["x"]).select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        new = stored(step.join(jump, "to").select("node", F.least("to", "beyond").alias("label"), "was"), "labels")
        if new.filter("label <> was").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


def reach(edges: DataFrame, starts: DataFrame, hops: int, a: str = "a", b: str = "b") -> DataFrame:
    """(start, node, hops): what each of starts (start) reaches within `hops` edges, by the fewest of them; itself at 0."""
    out = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hops")).distinct()
    step = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).distinct()
    front = out
    for n in range(1, hops + 1):
        met = front.join(step, F.col("node") == F.col("x")).select("start", F.col("y").alias("node")).distinct()
        front = met.join(out.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(n))
        out = out.union(front)
    return out


def coread(reads: DataFrame, statement: str, unit: str) -> DataFrame:
    """(a, b, n), a < b: how many statements read both units. A statement's own units bound the pairs it gives."""
    held = reads.select(statement, unit).dropna().groupBy(statement).agg(F.array_sort(F.collect_set(unit)).alias("u"))
    one = held.select("u", F.posexplode("u").alias("i", "a"))
    return one.select("a", F.explode(F.slice("u", F.col("i") + 2, F.size("u"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))


def usage_cosine(pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs (a, b, n): n over the root of both sides' sums."""
    side = pairs.select(F.explode(F.array("a", "b")).alias("unit"), "n").groupBy("unit").agg(F.sum("n").alias("e"))
    x, y = side.select(F.col("unit").alias("a"), F.col("e").alias("ea")), side.select(F.col("unit").alias("b"), F.col("e").alias("eb"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", (F.col("n") / F.sqrt(F.col("ea").cast("double") * F.col("eb"))).alias("cosine"))


def is_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """(n, n_distinct, unique): whether keys name every row of a table that has rows."""
    n = df.groupBy(*keys).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("n_distinct"))
    return n.select("n", "n_distinct", ((F.col("n") > 0) & (F.col("n") == F.col("n_distinct"))).alias("unique"))


def elect_key(joins: DataFrame, least: int) -> DataFrame:
    """(table, column, degree): of joins (table, column, other) the column with the most others, if one has `least` or more and no equal."""
    degree = joins.groupBy("table", "column").agg(F.count_distinct("other").alias("degree"))
    top = degree.groupBy("table").agg(F.max_by("column", "degree").alias("column"), F.max("degree").alias("most"))
    tied = degree.join(top.select(F.col("table").alias("t"), "most"), (F.col("table") == F.col("t")) & (F.col("degree") == F.col("most"))).groupBy("table").agg(F.count("*").alias("k"))
    return top.join(tied.filter("k = 1"), "table").filter(F.col("most") >= least).select("table", "column", F.col("most").alias("degree"))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda q, z: q + z)


def units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a matrix, each scaled to length 1; a vector of zeros stays one."""
    m = np.asarray(column.to_pylist(), float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), np.finfo(float).tiny)


def nearest(rows: DataFrame, asked: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", floor: float | None = None, kind: str | None = None) -> DataFrame:
    """(query, near, score, rank): the k rows of highest cosine for each asked one, itself aside; equal scores by key.

    BLOCK asked vectors at once go to all tasks; a task multiplies them with its rows, a batch at a time, and keeps its
    own best k, so a pass moves k rows a task and query. With a kind, only rows of the query's kind count. Null vectors
    and keys are left out; vectors have one length.
    """
    held = lambda d: d.select(F.col(key).alias("k"), F.col(vector).alias("v"), (F.col(kind) if kind else F.lit(0)).cast("string").alias("g")).dropna()
    every, wanted = held(rows), held(asked)
    type_ = rows.schema[key].dataType.simpleString()
    parts = max(1, -(-wanted.count() // BLOCK))
    out = None
    for i in range(parts):
        block = wanted.filter(F.pmod(F.xxhash64("k"), F.lit(parts)) == i).toArrow()
        if not block.num_rows:
            continue
        shared = rows.sparkSession.sparkContext.broadcast((block.column("k").to_pylist(), units(block.column("v")), np.asarray(block.column("g").to_pylist())))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, of = shared.value
            best = pd.DataFrame({"query": [], "near": [], "score": []})
            who = pd.Series(ids)
            for b in batches:
                if not b.num_rows:
                    continue
                near = pd.Series(b.column(0).to_pylist())
                score = np.round(units(b.column(1)) @ q.T, 6)
                score[np.asarray(b.column(2).to_pylist())[:, None] != of[None, :]] = -np.inf
                same = pd.Index(near).get_indexer_for(who)
                score[same[same >= 0], np.flatnonzero(same >= 0)] = -np.inf
                least = np.partition(score, -min(k, len(near)), axis=0)[-min(k, len(near))]
                at, which = np.nonzero((score >= least) & (score > -np.inf) & (score >= (-np.inf if floor is None else floor)))
                new = pd.DataFrame({"query": who.to_numpy()[which], "near": near.to_numpy()[at], "score": score[at, which]})
                best = new if best.empty else pd.concat([best, new])
                best = best.sort_values(["query", "score", "near"], ascending=[True, False, True]).groupby("query").head(k)
            if not best.empty:
                yield pa.RecordBatch.from_pandas(best, schema=pa.schema([("query", kinds), ("near", kinds), ("score", pa.float64())]), preserve_index=False)

        kinds = block.column("k").type
        found = every.mapInArrow(run, f"query {type_}, near {type_}, score double")
        out = found if out is None else out.union(found)
    if out is None:
        out = every.sparkSession.createDataFrame([], f"query {type_}, near {type_}, score double")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "near"))).filter(F.col("rank") <= k)


def near_links(rows: DataFrame, k: int, cut: float, key: str = "vec_id", vector: str = "embedding", kind: str | None = None) -> DataFrame:
    """(a, b, w), a < b: links to the k nearest of one kind with a cosine above `cut`, scaled to 0 to 1; either way's greater one.

    A row without such a link is (key, null, null).
    """
    met = nearest(rows, rows, k, key, vector, cut, kind).filter(F.col("score") > cut)
    w = F.greatest((F.col("score") - cut) / (1 - cut), F.lit(1e-6))
    links = met.select(F.least("query", "near").alias("a"), F.greatest("query", "near").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.max("w").alias("w"))
    links = stored(links, "links")
    linked = links.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    alone = rows.filter(F.col(key).isNotNull()).select(key).distinct().join(linked, key, "left_anti")
    return links.unionByName(alone.select(F.col(key).alias("a")), allowMissingColumns=True)


def centres(rows: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """(group, i, x): the mean of each group's vectors, scaled to length 1, one coordinate a row."""
    mean = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    length = mean.groupBy(group).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    return mean.join(length, group).select(group, "i", F.try_divide("x", "length").alias("x"))


def closest(rows: DataFrame, group: str, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(group, key, score, rank): the k members of a group nearest to its centre; equal scores by key."""
    centre = centres(rows, group, vector).groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))
    scored = rows.join(centre, group).select(group, key, F.round(dot(vector, "centre") / F.sqrt(dot(vector, vector)), 5).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), key))).filter(F.col("rank") <= k)
