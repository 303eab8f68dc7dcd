"""Choosing and judging: tables for a question, definitions, designed terms against use, repeated work, answers compared."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.operators.graph import components, nearest
from loomgraph.sources.shared import stored

# ---------------------------------------------------------------- which tables


def descend(picked: DataFrame, part_of: DataFrame, depth: int) -> DataFrame:
    """(top, node, hops): what lies below each picked node (node) over part_of (child, parent), by the fewest steps; itself at 0."""
    down = part_of.select(F.col("parent").alias("p"), F.col("child").alias("c")).dropna().distinct()
    out = picked.select(F.col("node").alias("top"), "node", F.lit(0).alias("hops")).dropna(subset=["node"]).distinct()
    front = out
    for n in range(1, depth + 1):
        front = front.join(down, F.col("node") == F.col("p")).select("top", F.col("c").alias("node")).distinct()
        front = front.join(out.select("top", "node"), ["top", "node"], "left_anti").withColumn("hops", F.lit(n))
        out = out.union(front)
    return out


def used(run: DataFrame, read: DataFrame, columns: DataFrame) -> DataFrame:
    """(table, n): how many principals ran something that reads the chosen columns (table, col) of a table."""
    met = read.select("shape_id", "col").join(columns, "col").join(run.select("principal", "shape_id"), "shape_id")
    return met.groupBy("table").agg(F.count_distinct("principal").alias("n"))


def round_robin(groups: list[str], tables: dict[str, dict], k: int) -> list[str]:
    """k tables: each group in turn gives its most used that isn't taken, live ones first; frozen ones when no group has a live one.

    tables: {name: {groups, used, frozen, cols}}; equal ones by the number of columns, then in the order they are given.
    """
    rank = lambda t: (-tables[t]["used"], -len(tables[t]["cols"]))
    own = {g: sorted((t for t in tables if g in tables[t]["groups"]), key=rank) for g in groups}
    turns = [[t for t in own[g] if not tables[t]["frozen"]] for g in groups]
    out: list[str] = []
    for live in (turns, [sorted((t for t in itertools.chain(*own.values()) if tables[t]["frozen"]), key=lambda t: 0)]):
        while len(out) < k and any(t not in out for q in live for t in q):
            for q in live:
                if len(out) < k and (t := next((t for t in q if t not in out), None)):
                    out.append(t)
    return out


def cohort(members: DataFrame, usage: DataFrame, frozen: DataFrame, groups: list[str], k: int, by_usage: bool = False) -> list[str]:
    """The k tables for a question: of members (group, table, col) of its groups, closest first; tables of the groups are named, so few.

    usage (table, n), frozen (table). by_usage: the most used, whatever their group.
    """
    held = members.filter(F.col("group").isin(groups)).groupBy("table").agg(F.array_sort(F.collect_set("group")).alias("groups"), F.array_sort(F.collect_set("col")).alias("cols"))
    out = held.join(usage, "table", "left").join(frozen.select("table").distinct().withColumn("frozen", F.lit(True)), "table", "left")
    tables = {r["table"]: {"groups": r["groups"], "cols": r["cols"], "used": r["n"] or 0, "frozen": bool(r["frozen"])} for r in out.orderBy("table").collect()}
    if by_usage:
        return sorted(tables, key=lambda t: (tables[t]["frozen"], -tables[t]["used"], -len(tables[t]["cols"]), t))[:k]
    return round_robin(groups, tables, k)


def similar(shapes: DataFrame, asked: DataFrame, distrusted: DataFrame, k: int, key: str = "shape_id", vector: str = "embedding") -> DataFrame:
    """(query, near, score, rank): the k nearest texts (key, vector, tables) that read no distrusted table (table)."""
    bad = shapes.select(key, F.explode("tables").alias("table")).join(distrusted.select("table").distinct(), "table", "left_semi").select(key).distinct()
    return nearest(shapes.join(bad, key, "left_anti"), asked, k, key, vector)


def definitions(computations: DataFrame, asked: DataFrame, k: int, floor: float, key: str = "id", vector: str = "embedding") -> DataFrame:
    """(query, near, score, rank): the k nearest computations at `floor` or above; health checks and those that stand for another are left out."""
    good = computations.filter(~F.coalesce("health_check", F.lit(False)) & F.col("same_as").isNull())
    return nearest(good, asked, k, key, vector, floor)


def trusted_joins(keys: DataFrame) -> DataFrame:
    """Join keys that say something of identity and aren't suspect."""
    return keys.filter(F.col("identity") & F.col("confidence").isin("production", "corroborated"))


def first_that_stands(routes: list[tuple[str, Callable[[], object]]]) -> tuple[str | None, object, list[str]]:
    """(route, answer, why the ones before it don't): routes are tried in order, each only if it is reached; None or an error doesn't stand."""
    failed = []
    for name, run in routes:
        try:
            got = run()
        except Exception as e:  # a route that fails is passed over, and says why
            failed.append(f"{name}: {e}")
            continue
        if got is not None:
            return name, got, failed
        failed.append(f"{name}: nothing")
    return None, None, failed


# ---------------------------------------------------------------- computations


def flagged(computations: DataFrame, by: DataFrame, distrusted: DataFrame) -> DataFrame:
    """(id, trusted, production, health_check) of computations (id, tables) by their shapes (id, service, aggregate_only, grouped)."""
    bad = computations.select("id", F.explode("tables").alias("table")).join(distrusted.select("table").distinct(), "table", "left_semi").select("id").distinct().withColumn("bad", F.lit(True))
    check = F.coalesce("aggregate_only", F.lit(False)) & ~F.coalesce("grouped", F.lit(False))
    of = by.groupBy("id").agg(F.bool_or("service").alias("production"), F.bool_and(check).alias("health_check"))
    out = computations.select("id").distinct().join(of, "id", "left").join(bad, "id", "left")
    return out.select("id", F.col("bad").isNull().alias("trusted"), F.coalesce("production", F.lit(False)).alias("production"), F.coalesce("health_check", F.lit(True)).alias("health_check"))


def near_alike(computations: DataFrame, least: float, k: int, key: str = "id", vector: str = "embedding", block: str = "block") -> DataFrame:
    """(node, component): computations of one block (their kind and tables) that nearness of `least` or more connects."""
    pairs = nearest(computations, computations, k, key, vector, least, block)
    return components(pairs.select(F.least("query", "near").alias("a"), F.greatest("query", "near").alias("b")))


def merged(groups: DataFrame, jobs: DataFrame, same: Column | None = None) -> DataFrame:
    """(id, same_as): each group's (node, component) most-run member stands for the others; `same` confirms a pair, by default all."""
    of = groups.join(jobs.select(F.col("id").alias("node"), "jobs"), "node")
    top = of.groupBy("component").agg(F.max_by("node", F.struct("jobs", "node")).alias("same_as"))
    out = of.join(top, "component").filter("node <> same_as")
    return (out if same is None else out.filter(same)).select(F.col("node").alias("id"), "same_as")


def runnable(c: dict) -> str:
    """A computation over one table as a query."""
    table = c["tables"][0]
    what = "COUNT(*)" if c["kind"] == "population" else c["expression"]
    where = {"measure": c["filters"], "population": [c["expression"]]}.get(c["kind"], [])
    grain = {"measure": c["grain"], "dimension": [c["expression"]]}.get(c["kind"], [])
    lines = [f"SELECT {', '.join([*grain, what])}", f"FROM `{table}` AS {table.rsplit('.', 1)[-1]}"]
    lines += ["WHERE " + " AND ".join(where)] if where else []
    lines += ["GROUP BY " + ", ".join(str(i + 1) for i in range(len(grain)))] if grain else []
    return "\n".join(lines)


def lifecycle(trusted: Column, production: Column) -> Column:
    return F.when(~trusted, "deprecated").when(production, "stable").otherwise("draft")


def provenance(by: DataFrame, n: int) -> DataFrame:
    """(id, shape_id, jobs, rank): the n most-run shapes (id, shape_id, jobs) of each computation; equal ones by name."""
    each = by.groupBy("id", "shape_id").agg(F.sum("jobs").alias("jobs"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("jobs"), "shape_id"))).filter(F.col("rank") <= n)


def area_votes(reads: DataFrame, member_of: DataFrame, hops: int) -> DataFrame:
    """(id, area, n): the topmost group above most of a computation's columns (id, col); equal ones by name. member_of is (child, parent)."""
    up = member_of.select(F.col("child").alias("c"), F.col("parent").alias("p"))
    at = reads.select("id", "col", F.col("col").alias("node"))
    for _ in range(hops):
        at = at.join(up, F.col("node") == F.col("c"), "left").select("id", "col", F.coalesce("p", "node").alias("node"))
    n = at.filter("node <> col").groupBy("id", "node").agg(F.count("*").alias("n"))
    return n.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "node")).alias("t")).select("id", F.col("t.node").alias("area"), (-F.col("t.m")).alias("n"))


def prefixes(sets: DataFrame, key: str, item: str, keep: Callable[[Column], Column], kept: bool = False) -> tuple[DataFrame, DataFrame]:
    """(items (key, items, n), first (key, item)): each key's items, the rarest of all first, and the first keep(n) of them.

    Two keys that share enough meet in what is rare, so common items need not be joined. The items are stored if `kept`.
    """
    one = sets.select(F.col(key).alias("key"), F.col(item).alias("item")).dropna().distinct()
    freq = one.groupBy("item").agg(F.count("*").alias("f"))
    held = one.join(freq, "item").groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "item"))), lambda s: s["item"]).alias("items"))
    held = held.withColumn("n", F.size("items"))
    held = stored(held, "sets") if kept else held
    return held, held.select("key", "n", F.explode(F.slice("items", F.lit(1), F.greatest(F.lit(0), keep(F.col("n"))).cast("int"))).alias("item"))


#: Sets of one block, and items of all of them; a task compares two blocks.
SETS, ITEMS = 4_096, 1_000_000


def met_in_blocks(held: DataFrame, least: float, blocks: int) -> DataFrame:
    """(a, b, jaccard) of sets held (key, items) as jaccard_pairs(); every two blocks of them meet in one task, and only what is alike leaves it."""
    codes = stored(held.select(F.explode("items").alias("item")).distinct().withColumn("code", F.monotonically_increasing_id()), "codes")
    coded = held.select("key", F.explode("items").alias("item")).join(codes, "item").groupBy("key").agg(F.collect_list("code").alias("codes"))
    coded = coded.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"), "key", "codes")
    cell = coded.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    cell = cell.select(F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "key", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches)).combine_chunks()
        keys, lists = (t.column(c).combine_chunks() for c in ("key", "codes"))
        low, high, block = (t.column(c).to_numpy() for c in ("low", "high", "block"))
        n = np.asarray(lists.value_lengths()).astype(np.int64)
        start = np.cumsum(n) - n
        names, flat = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        mine, others = np.flatnonzero(block == low), np.flatnonzero(block == high)
        place = np.full(len(n), -1)
        place[others] = np.arange(len(others))
        owner = np.repeat(place, n)
        there, order = flat[owner >= 0], np.argsort(flat[owner >= 0], kind="stable")
        post = owner[owner >= 0][order]
        end = np.cumsum(np.bincount(there, minlength=len(names)))
        begin = np.r_[0, end[:-1]]
        m, same = n[others], low[0] == high[0]
        found, rows = [], 0
        for at, i in enumerate(mine):
            its = flat[start[i] : start[i] + n[i]]
            c = np.bincount(np.concatenate([post[begin[v] : end[v]] for v in its]), minlength=len(others))
            score = c / (n[i] + m - c)
            hit = np.flatnonzero(score >= least)
            hit = hit[hit > at] if same else hit
            found.append((np.full(len(hit), i), others[hit], score[hit]))
            rows += len(hit)
            if rows >= 200_000 or at == len(mine) - 1:
                x, y, z = (np.concatenate(v) for v in zip(*found, strict=True))
                found, rows = [], 0
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(x)), keys.take(pa.array(y)), pa.array(z)], names=["x", "y", "jaccard"])

    kind = held.schema["key"].dataType.simpleString()
    met = cell.groupBy("low", "high").applyInArrow(run, f"x {kind}, y {kind}, jaccard double")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def jaccard_pairs(sets: DataFrame, key: str, item: str, least: float) -> DataFrame:
    """(a, b, jaccard), a < b: keys whose sets of items have that likeness or more; least above 0.

    Sets that share `least` of their union meet among the first n - ceil(least * n) + 1 items of each, rarest first, and
    differ in size by that factor at most. Where a hundredth of all pairs or more would meet so, no item is rare, and
    blocks of sets are compared instead, so that pairs that are not alike are never rows.
    """
    held, first = prefixes(sets, key, item, lambda n: n - F.ceil(n * least - 1e-9) + 1, kept=True)
    right = first.select(F.col("key").alias("b"), F.col("n").alias("m"), "item")
    f = F.col("f").cast("double")
    joined = first.groupBy("item").agg(F.count("*").alias("f")).agg(F.sum(f * (f - 1) / 2)).first()[0]
    n, items = held.agg(F.count("*"), F.sum("n")).first()
    if joined and joined >= n * (n - 1) / 200:
        return met_in_blocks(held, least, max(-(-n // SETS), -(-items // ITEMS), min(8, -(-n // 256))))
    met = first.withColumnRenamed("key", "a").join(right, "item").filter((F.col("a") < F.col("b")) & (F.col("n") >= least * F.col("m")) & (F.col("m") >= least * F.col("n"))).select("a", "b").distinct()
    side = lambda name, as_: held.select(F.col("key").alias(name), F.col("items").alias(as_))
    both = met.join(side("a", "x"), "a").join(side("b", "y"), "b")
    c = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (c / (F.size("x") + F.size("y") - c)).alias("jaccard")).filter(F.col("jaccard") >= least)


def sharing(links: DataFrame, key: str, over: str, asked: Column, least: int) -> DataFrame:
    """(a, b, shared): keys b that share `least` or more of `over` with an asked key a; they meet among each one's first n - least + 1, rarest first."""
    held, first = prefixes(links, key, over, lambda n: n - least + 1)
    mine = first.join(links.filter(asked).select(F.col(key).alias("key")).distinct(), "key", "left_semi")
    met = mine.select(F.col("key").alias("a"), "item").join(first.select(F.col("key").alias("b"), "item"), "item").filter("a <> b").select("a", "b").distinct()
    side = lambda name, as_: held.select(F.col("key").alias(name), F.col("items").alias(as_))
    both = met.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared")).filter(F.col("shared") >= least)


def successions(shapes: DataFrame, days: int, least: float) -> tuple[DataFrame, DataFrame]:
    """(succeeds (a, b, gap, jaccard), variants (a, b)) of shapes (id, first_seen, last_seen, principals, reads, tables, computes).

    b succeeds a: a person of both, first seen 1 to `days` days after a was last, alike reads, other tables. Variants,
    a < b, share a table and a computation. Shapes meet where they read the same rare columns, or compute the same.
    """
    read = shapes.select("id", F.explode("reads").alias("item"))
    alike = jaccard_pairs(read, "id", "item", least)
    pairs = alike.select("a", "b", "jaccard").union(alike.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard"))
    side = lambda p: shapes.select(F.col("id").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("first_seen", "last_seen", "principals", "tables")])
    gap = F.datediff("b_first_seen", "a_last_seen")
    same = F.size(F.array_except("a_tables", "b_tables")) + F.size(F.array_except("b_tables", "a_tables")) == 0
    met = pairs.join(side("a"), "a").join(side("b"), "b").filter((F.col("b_first_seen") > F.col("a_last_seen")) & (gap <= days) & F.arrays_overlap("a_principals", "b_principals") & ~same)
    both = shapes.select("id", F.explode("tables").alias("t"), "computes").select("id", "t", F.explode("computes").alias("c")).distinct()
    variants = both.withColumnRenamed("id", "a").join(both.withColumnRenamed("id", "b"), ["t", "c"]).filter("a < b").select("a", "b").distinct()
    return met.select("a", "b", gap.alias("gap"), "jaccard"), variants


# ---------------------------------------------------------------- designed against used


def best(rows: DataFrame, terms: DataFrame, floor: float, key: str, vector: str) -> DataFrame:
    """(query, term, score): each row's nearest term, if it is as near as `floor`; equal ones by name."""
    return nearest(terms, rows, 1, key, vector, floor).select("query", F.col("near").alias("term"), "score")


def findings(bound: DataFrame, columns: DataFrame, reads: DataFrame, suspects: DataFrame, tables: DataFrame, run: DataFrame, near: DataFrame, groups: DataFrame, classes: DataFrame) -> DataFrame:
    """(finding, what, other): where a catalog's design and use agree, differ, or leave gaps.

    bound (col, term): a null col is a term bound to nothing; columns (col, unit, table); reads (col); suspects (a, b)
    units that a distrusted join equates; tables (table, certified, described); run (principal, table); near (unit,
    term): the term use is nearest to; groups (group, unit, stable); classes (class, matched).
    """
    b = bound.dropna().distinct().join(columns.select("col", "unit"), "col", "left").withColumn("unit", F.coalesce("unit", "col"))
    say = lambda df, name, what, other=None: df.select(F.lit(name).alias("finding"), F.col(what).cast("string").alias("what"), (F.col(other).cast("string") if other else F.lit(None).cast("string")).alias("other")).distinct()
    units = b.select("unit", "term").distinct()
    agree = say(near.join(units, ["unit", "term"], "left_semi"), "agree", "unit", "term")
    several = b.groupBy("col").agg(F.count_distinct("term").alias("n"), F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms")).filter("n > 1")
    split = units.groupBy("unit").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("term")), ",").alias("terms")).filter("n > 1")
    two = units.select("term", F.col("unit").alias("a")).join(suspects, "a").join(units.select(F.col("term").alias("t"), F.col("unit").alias("b")), "b").filter("term = t")
    apart = say(two.withColumn("pair", F.concat_ws("=", "a", "b")), "kept_apart", "term", "pair")
    orphan = say(bound.select("term").distinct().join(b.select("term"), "term", "left_anti"), "orphan", "term")
    live = b.join(reads.select("col").distinct(), "col", "left_semi").select("term").distinct()
    unread = say(b.select("term").distinct().join(live, "term", "left_anti"), "unread", "term")
    asked = run.select("table", "principal").distinct()
    unqueried = say(tables.filter("certified").join(asked, "table", "left_anti"), "certified_unqueried", "table")
    people = asked.groupBy("table").agg(F.count("*").alias("n")).filter("n >= 3")
    undescribed = say(tables.filter("not described").join(people, "table"), "undescribed_tables", "table", "n")
    new = say(groups.filter("stable").select("group").distinct().join(groups.join(units, "unit", "left_semi").select("group").distinct(), "group", "left_anti"), "undesigned_groups", "group")
    unmatched = say(classes.filter("not matched"), "unmatched_classes", "class")
    parts = [agree, say(several, "several_terms", "col", "terms"), say(split, "split", "unit", "terms"), apart, orphan, unread, unqueried, undescribed, new, unmatched]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- repeated work


def request_shape(x):
    """A request (JSON) without its values: lists and names stay, bounds and limits go; a date is a ?."""
    if isinstance(x, dict):
        kept = {k: request_shape(v) for k, v in sorted(x.items()) if k not in ("value", "values", "alias", "reason", "fits", "limit")}
        return {k: v for k, v in kept.items() if v not in ("", [], None, {})}
    if isinstance(x, list):
        return [request_shape(v) for v in x]
    return "?" if isinstance(x, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", x) else x


def asked_id(question: str, day: str, writer: str, grants: list) -> str:
    """The identity of a question: its words, the day, who writes its query and what the reader may see."""
    return hashlib.sha256(json.dumps([question.strip(), day, writer, grants]).encode()).hexdigest()


def remembered(asks: DataFrame, now: Column) -> DataFrame:
    """(ident, answer, at): the latest answer of each question that still holds and wasn't rejected; asks (ident, answer, at, until, rejected)."""
    good = asks.filter(~F.coalesce("rejected", F.lit(False)) & (F.col("at") <= now) & (F.col("until").isNull() | (F.col("until") >= now)))
    return good.groupBy("ident").agg(F.max_by("answer", F.struct("at", "answer")).alias("answer"), F.max("at").alias("at"))


def skills(tasks: DataFrame, steps: DataFrame, clusters: DataFrame, least_support: int, least_rate: float) -> DataFrame:
    """(cluster, n, rate, path, key): what the good tasks of a cluster do, by their most frequent path; equal ones by name.

    tasks (task, good); steps (task, seq, step); clusters (task, cluster). Clusters with too few tasks or too few good
    ones give nothing.
    """
    path = steps.groupBy("task").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "step"))), lambda s: s["step"]), " > ").alias("path"))
    each = clusters.join(tasks, "task").join(path, "task", "left").na.fill("", ["path"])
    n = each.groupBy("cluster").agg(F.count("*").alias("n"), F.avg(F.col("good").cast("double")).alias("rate")).filter((F.col("n") >= least_support) & (F.col("rate") >= least_rate))
    paths = each.filter("good").groupBy("cluster", "path").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.min(F.struct((-F.col("c")).alias("c"), "path"))["path"].alias("path"))
    return n.join(paths, "cluster").withColumn("key", F.substring(F.sha2("path", 256), 1, 16))


def measured(offers: DataFrame, least: int, rate: float) -> DataFrame:
    """(skill, offered, followed, good, retired): offers (skill, followed, good) of each; one that was followed `least` times and went
    well at less than `rate` retires."""
    n = offers.groupBy("skill").agg(F.count("*").alias("offered"), F.count_if("followed").alias("followed"), F.count_if(F.col("followed") & F.col("good")).alias("good"))
    return n.withColumn("retired", (F.col("followed") >= least) & (F.col("good") < rate * F.col("followed")))


# ---------------------------------------------------------------- who may see what


def computation_ok(computations: DataFrame, readable: DataFrame, hidden: str) -> DataFrame:
    """(id): computations (id, tables, columns, text) whose tables and columns (name) are all readable and whose text names nothing hidden."""
    parts = computations.select("id", F.explode(F.concat("tables", "columns")).alias("name")).distinct()
    lost = parts.join(readable.select("name").distinct(), "name", "left_anti").select("id").distinct()
    some = computations.filter((F.size("tables") > 0) & ~F.coalesce(F.col("text").rlike(hidden), F.lit(False)))
    return some.select("id").distinct().join(lost, "id", "left_anti")


def allowlist(grants: DataFrame, policies: DataFrame, tags: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tables (principal, table, policied), columns hidden (principal, col), groups (principal, group, access)).

    grants (principal, table); policies (table): read row by row; tags (col, table, principal): a tagged column is hidden
    from all but those principals; parts (group, col, table).
    """
    rows = policies.select("table").distinct().withColumn("policied", F.lit(True))
    tables = grants.select("principal", "table").dropna().distinct().join(rows, "table", "left").select("principal", "table", F.coalesce("policied", F.lit(False)).alias("policied"))
    tagged = tags.select("col", "table").distinct()
    hidden = tables.select("principal", "table").join(tagged, "table").select("principal", "col").join(tags.select("principal", "col").dropna().distinct(), ["principal", "col"], "left_anti")
    whole = parts.groupBy("group").agg(F.count_distinct("col").alias("n"))
    seen = parts.join(tables.select("principal", "table"), "table").join(hidden, ["principal", "col"], "left_anti").groupBy("principal", "group").agg(F.count_distinct("col").alias("k"))
    every = grants.select("principal").dropna().distinct().crossJoin(F.broadcast(whole))  # groups are named ones, few
    access = every.join(seen, ["principal", "group"], "left").select("principal", "group", F.when(F.col("k") == F.col("n"), "all").when(F.col("k") > 0, "some").otherwise("none").alias("access"))
    return tables, hidden, access


# ---------------------------------------------------------------- scores


def same_value(a, b) -> bool:
    """Whether two cells say the same: numbers within 0.1 % or 0.01, texts without case and outer blanks."""
    if a is None or b is None:
        return a is b
    try:
        x, y = float(a), float(b)
        return math.isclose(x, y, rel_tol=1e-3, abs_tol=0.01)
    except (TypeError, ValueError):
        return str(a).strip().lower() == str(b).strip().lower()


def same_answer(ours: list[tuple], theirs: list[tuple]) -> str | None:
    """How two tables say the same, whatever their columns are called and however rows are ordered; None if they don't.

    "equal", "scaled" (columns of numbers a hundredfold), or "melted" (one has a row where the other has a column).
    """
    if matched(ours, theirs, (1.0,)):
        return "equal"
    if matched(ours, theirs, (1.0, 100.0, 0.01)):
        return "scaled"
    melt = lambda rows: [(r[0], v) for r in rows for v in r[1:]]
    for a, b in ((ours, theirs), (theirs, ours)):
        if a and b and len(a[0]) > 2 and len(b[0]) == 3 and matched(melt(a), [(r[0], r[2]) for r in b], (1.0,)):
            return "melted"
    return None


def matched(ours: list[tuple], theirs: list[tuple], scales: tuple[float, ...]) -> bool:
    """Whether some order of our columns, each by a scale, gives their rows."""
    if len(ours) != len(theirs) or (ours and len(ours[0]) < len(theirs[0])):
        return False
    if not ours:
        return True
    width = len(theirs[0])
    scaled = lambda v, s: v if s == 1.0 or not isinstance(v, (int, float)) or isinstance(v, bool) else v * s
    order = lambda rows: sorted(rows, key=lambda r: [str(round(float(v), 1)) if isinstance(v, (int, float)) else str(v).strip().lower() for v in r])
    fits = [[(c, s) for c in range(len(ours[0])) for s in scales if all(same_value(x, y) for x, y in zip(sorted((scaled(r[c], s) for r in ours), key=rank), sorted((r[j] for r in theirs), key=rank)))] for j in range(width)]
    for pick in itertools.product(*fits):
        if len({c for c, _ in pick}) == width and all(all(map(same_value, x, y)) for x, y in zip(order([tuple(scaled(r[c], s) for c, s in pick) for r in ours]), order(theirs), strict=True)):
            return True
    return False


def rank(v) -> tuple:
    try:
        return (0, float(v), "")
    except (TypeError, ValueError):
        return (1, 0.0, str(v).strip().lower())


def fidelity(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(n, mean_difference, correlation) of the probabilities of transitions (src, dst, probability); one that a side lacks is 0 there."""
    both = ours.select("src", "dst", F.col("probability").alias("p")).join(theirs.select("src", "dst", F.col("probability").alias("q")), ["src", "dst"], "full").na.fill(0.0, ["p", "q"])
    return both.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("p") - F.col("q"))).alias("mean_difference"), F.corr("p", "q").alias("correlation"))


def paired(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(n, difference, half_width): the mean of a - b over rows that have both, and half of its 95 % interval."""
    d = F.col(a) - F.col(b)
    return rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count("*").alias("n"), F.avg(d).alias("difference"), (1.96 * F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("half_width"))


def folds(rows: DataFrame, key: str, k: int) -> DataFrame:
    """rows with fold, 0 to k - 1: by hash of the key, so a row is in one fold on every run."""
    return rows.withColumn("fold", F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(k)).cast("int"))


def coverage(told: DataFrame, support: str, good: str, score: str, floors: list[int]) -> DataFrame:
    """(floor, share, brier): how much is foretold at each floor of support, and how well."""
    each = told.select(F.explode(F.array(*map(F.lit, floors))).alias("floor"), support, score, F.col(good).cast("double").alias("y"))
    hit = F.col(support) >= F.col("floor")
    error = (F.col(score) - F.col("y")) * (F.col(score) - F.col("y"))
    return each.groupBy("floor").agg(F.avg(hit.cast("double")).alias("share"), F.avg(F.when(hit, error)).alias("brier"))


def summary(rows: DataFrame, by: list[str], value: str, targets: dict[str, float]) -> DataFrame:
    """(by, n, p50, p95, share): nearest-rank percentiles of a measure, and the share of values within its target (by the first of `by`); null without one."""
    limit = F.create_map(*[F.lit(x) for k, v in sorted(targets.items()) for x in (k, float(v))])
    n, spot = F.count("*").over(W.partitionBy(*by)), F.row_number().over(W.partitionBy(*by).orderBy(value))
    held = rows.filter(F.col(value).isNotNull()).withColumn("__n", n).withColumn("__r", spot)
    at = lambda p: F.max(F.when(F.col("__r") == F.greatest(F.lit(1), F.ceil(F.col("__n") * p)), F.col(value)))
    inside = (F.col(value) <= F.try_element_at(limit, F.col(by[0]).cast("string"))).cast("double")
    return held.groupBy(*by).agg(F.count("*").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.avg(inside).alias("share"))


def modal(values: list[str]) -> str | None:
    """The most frequent, of equal ones the first by name."""
    return min(Counter(values).items(), key=lambda x: (-x[1], x[0]))[0] if values else None
