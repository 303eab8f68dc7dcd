"""Evidence from use: who reads and writes what, which joins and computations hold, what may be seen.

Every operator groups before it moves rows; nulls in a key make no evidence unless said.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.sources.shared import stored


def home_vote(refs: DataFrame, unit: str, home: str) -> DataFrame:
    """(unit, home, votes): the home that most references of a unit name; of equal ones the first by name."""
    n = refs.select(unit, home).dropna().groupBy(unit, home).agg(F.count("*").alias("votes"))
    top = F.min(F.struct((-F.col("votes")).alias("v"), F.col(home).alias("h"))).alias("t")
    return n.groupBy(unit).agg(top).select(unit, F.col("t.h").alias(home), (-F.col("t.v")).alias("votes"))


def hash_sample(rows: DataFrame, text: str, share: float) -> DataFrame:
    """The rows whose text's SHA-1 falls below a share of all hashes: equal texts go together, on every run; null texts go."""
    return rows.filter(F.conv(F.substring(F.sha1(F.col(text).cast("binary")), 1, 8), 16, 10).cast("double") / 2**32 < share)


def notes(lines: DataFrame, conversation: str, order: str, text: str, wanted: Column) -> DataFrame:
    """(conversation, notes): the wanted lines' texts in order, one a line; null texts are left out."""
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(text).alias("t"))))
    return lines.filter(wanted & F.col(text).isNotNull()).groupBy(conversation).agg(F.array_join(F.transform(held, lambda s: s["t"]), "\n").alias("notes"))


def source_problems(lines: DataFrame, key: str, needed: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """(problem, n): rows that repeat an id, lack a needed field or have an unknown kind; only problems that occur."""
    missing = [F.sum(F.col(c).isNull().cast("long")).alias(f"missing {c}") for c in needed]
    bad = F.sum((F.col(kind).isNotNull() & ~F.col(kind).isin(kinds)).cast("long")).alias(f"unknown {kind}")
    one = lines.agg(*missing, bad).unpivot([], [f"missing {c}" for c in needed] + [f"unknown {kind}"], "problem", "n")
    twice = lines.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("c")).agg(F.sum(F.col("c") - 1).alias("n"))
    return one.union(twice.select(F.lit(f"repeated {key}"), "n")).filter("n > 0")


def representative(texts: DataFrame, shape: str, text: str, runs: Column) -> DataFrame:
    """(shape, text): the text with most runs; of equal ones the shortest, then the first by text."""
    best = F.min(F.struct((-F.coalesce(runs, F.lit(0))).alias("r"), F.length(text).alias("l"), F.col(text).alias("t"))).alias("b")
    return texts.filter(F.col(shape).isNotNull() & F.col(text).isNotNull()).groupBy(shape).agg(best).select(shape, F.col("b.t").alias(text))


def review_sample(rows: DataFrame, stratum: str, key: str, n: int) -> DataFrame:
    """(stratum, key, rank): n rows of each stratum, by the SHA-1 of their key. The ranks' window keeps n a task before it moves them."""
    spot = F.sha1(F.col(key).cast("string").cast("binary"))
    return rows.select(stratum, key, F.row_number().over(W.partitionBy(stratum).orderBy(spot, key)).alias("rank")).filter(F.col("rank") <= n)


def flows(links: DataFrame, src: str, dst: str, kind: str, jobs: str, control: str) -> DataFrame:
    """(src, dst, kinds, jobs, control): links between two units as one; it steers only if every link does."""
    kinds = F.array_join(F.array_sort(F.collect_set(kind)), ",")
    return links.dropna(subset=[src, dst]).groupBy(src, dst).agg(kinds.alias("kinds"), F.coalesce(F.sum(jobs), F.lit(0)).alias("jobs"), F.coalesce(F.bool_and(control), F.lit(False)).alias("control"))


def weighted_values(uses: DataFrame, shape: str, value: str, weight: Column, n: int) -> DataFrame:
    """(shape, top, weights): a shape's n values of most weight and those weights, as lists in one order; equal weights by value."""
    each = uses.select(shape, value, weight.cast("long").alias("w")).dropna(subset=[shape, value]).groupBy(shape, value).agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w"))
    kept = each.withColumn("r", F.row_number().over(W.partitionBy(shape).orderBy(F.desc("w"), value))).filter(F.col("r") <= n)
    held = F.array_sort(F.collect_list(F.struct("r", F.col(value).cast("string").alias("v"), F.col("w").cast("string").alias("w"))))
    return kept.groupBy(shape).agg(held.alias("h")).select(shape, F.array_join("h.v", ",").alias("top"), F.array_join("h.w", ",").alias("weights"))


def frozen(tables: DataFrame, written: DataFrame, read: DataFrame, views: DataFrame, hops: int = 3) -> DataFrame:
    """(name, frozen) of tables (name): neither in written (name), nor in read (name), nor below such a one by `hops` views (view, base)."""
    step, alive = views.select("view", "base").dropna().distinct(), read.select("name").dropna().distinct()
    front = alive
    for _ in range(hops):
        front = front.join(step, F.col("name") == F.col("view")).select(F.col("base").alias("name")).distinct()
        alive = alive.union(front)
    used = alive.union(written.select("name").dropna()).distinct().withColumn("used", F.lit(True))
    return tables.select("name").join(used, "name", "left").select("name", F.col("used").isNull().alias("frozen"))


def majority_join(uses: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """(a, b, kind, n) with a <= b: joined pairs, whichever side came first, with their most frequent kind; equal ones by name."""
    sides = uses.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(kind).alias("kind"), (F.col(a).isNotNull() & F.col(b).isNotNull()).alias("whole"))
    n = sides.filter("whole").groupBy("a", "b", "kind").agg(F.count("*").alias("n"))
    top = n.groupBy("a", "b").agg(F.min(F.struct((-F.col("n")).alias("m"), "kind")).alias("t"), F.sum("n").alias("n"))
    return top.select("a", "b", F.col("t.kind").alias("kind"), "n")


def confidence(own: Column, production: Column, suspect: Column, people: Column) -> Column:
    """What a join rests on, the strongest first; people that agree count from two on."""
    rest = F.when(F.coalesce(suspect, F.lit(False)), "suspect").when(people >= 2, "corroborated").otherwise("single")
    return F.when(F.coalesce(own, F.lit(False)), "self").when(F.coalesce(production, F.lit(False)), "production").otherwise(rest)


def bridges(columns: DataFrame, table: str, space: str) -> DataFrame:
    """(a, b, tables), a < b: id spaces that tables hold side by side, by how many do. A table's own columns bound its pairs."""
    held = columns.select(table, space).dropna().groupBy(table).agg(F.array_sort(F.collect_set(space)).alias("s")).filter(F.size("s") > 1)
    one = held.select("s", F.posexplode("s").alias("i", "a"))
    return one.select("a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("tables"))


def stability(groups: DataFrame, reruns: DataFrame, node: str, group: str, run: str) -> DataFrame:
    """(group, stability): a group's best Jaccard with any group of a rerun, averaged over all reruns; 0 where none meets it."""
    size, again = groups.groupBy(group).agg(F.count("*").alias("n")), reruns.select(run, F.col(group).alias("other"), F.col(node).alias("seen"))
    sizes = again.groupBy(F.col(run).alias("r"), F.col("other").alias("o")).agg(F.count("*").alias("k"))
    met = groups.join(again, F.col(node) == F.col("seen")).groupBy(group, run, "other").agg(F.count("*").alias("c"))
    met = met.join(size, group).join(sizes, (F.col(run) == F.col("r")) & (F.col("other") == F.col("o")))
    best = met.groupBy(group, run).agg(F.max(F.col("c") / (F.col("n") + F.col("k") - F.col("c"))).alias("j")).groupBy(group).agg(F.sum("j").alias("j"))
    runs = reruns.agg(F.count_distinct(run).alias("runs"))
    return size.join(best, group, "left").join(F.broadcast(runs)).select(group, F.try_divide(F.coalesce("j", F.lit(0.0)), "runs").alias("stability"))


def same_computations(found: DataFrame, parts: list[str], alias: str, grain: str, jobs: str) -> DataFrame:
    """(id, aliases, grain, jobs): computations whose parts are equal as one, with their five most-run names and most-run grain."""
    ids = found.withColumn("id", F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts]), 256))
    top = weighted_values(ids, "id", alias, F.col(jobs), 5).select("id", F.col("top").alias("aliases"))
    best = weighted_values(ids, "id", grain, F.col(jobs), 1).select("id", F.col("top").alias("grain"))
    return ids.groupBy("id").agg(F.sum(jobs).alias("jobs")).join(top, "id", "left").join(best, "id", "left").select("id", "aliases", "grain", "jobs")


def parameters(runs: DataFrame, shape: str, column: str, value: str) -> DataFrame:
    """(shape, column, n_values): columns that a shape was run with more than one value of."""
    return runs.groupBy(shape, column).agg(F.count_distinct(value).alias("n_values")).filter("n_values > 1")


def covered(edges: DataFrame, starts: DataFrame, below: str, above: str) -> DataFrame:
    """(node): starts (node) and all that edges lead up to from them, cycles included once. Each step is written to the shared folder."""
    step, seen = edges.select(F.col(below).alias("x"), F.col(above).alias("y")).dropna().distinct(), stored(starts.select("node").dropna().distinct(), "covered")
    front = seen
    while True:
        met = front.join(step, F.col("node") == F.col("x")).select(F.col("y").alias("node")).distinct()
        front = stored(met.join(seen, "node", "left_anti"), "covered")
        if front.isEmpty():
            return seen
        seen = stored(seen.union(front), "covered")


def alignment(designed: DataFrame, used: DataFrame, part: str, term: str, group: str) -> DataFrame:
    """(term, group, finding): designed terms against used groups that share parts.

    split: a term in several groups; several_terms: a group of several terms; both; agree: one and one; unread: a term
    in no group; undesigned: a group of no term.
    """
    d, u = designed.select(part, term).dropna().distinct(), used.select(part, group).dropna().distinct()
    met = d.join(u, part).select(term, group).distinct()
    groups, terms = met.groupBy(term).agg(F.count("*").alias("gs")), met.groupBy(group).agg(F.count("*").alias("ts"))
    finding = F.when((F.col("gs") > 1) & (F.col("ts") > 1), "both").when(F.col("gs") > 1, "split").when(F.col("ts") > 1, "several_terms").otherwise("agree")
    pairs = met.join(groups, term).join(terms, group).select(term, group, finding.alias("finding"))
    unread = d.select(term).distinct().join(met, term, "left_anti").withColumn("finding", F.lit("unread"))
    new = u.select(group).distinct().join(met, group, "left_anti").withColumn("finding", F.lit("undesigned"))
    return pairs.unionByName(unread, True).unionByName(new, True)


def access(parts: DataFrame, readable: DataFrame, whole: str, part: str) -> DataFrame:
    """(whole, n, n_readable, access): whether all, some or none of a whole's parts are in readable (part)."""
    may = readable.select(part).dropna().distinct().withColumn("may", F.lit(1))
    n = parts.select(whole, part).dropna().distinct().join(may, part, "left").groupBy(whole).agg(F.count("*").alias("n"), F.count("may").alias("n_readable"))
    return n.withColumn("access", F.when(F.col("n") == F.col("n_readable"), "all").when(F.col("n_readable") > 0, "some").otherwise("none"))


def readable_shapes(shapes: DataFrame, parts: DataFrame, readable: DataFrame, shape: str, part: str, text: str, hidden: str) -> DataFrame:
    """(shape): shapes that have parts, may read all of them, and whose text matches nothing hidden (a pattern); a null text hides nothing."""
    whole = access(parts, readable, shape, part).filter("access = 'all'").select(shape)
    return shapes.filter(~F.coalesce(F.col(text).rlike(hidden), F.lit(False))).select(shape).distinct().join(whole, shape, "left_semi")
