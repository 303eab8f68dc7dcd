"""How a log was understood, samples to look at, groups that come back, links that stories make: checks on what is built."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.operators.communities import communities
from loomgraph.operators.evidence import stability
from loomgraph.operators.levels import ONES, TENS, amount_forms
from loomgraph.sources.shared import stored


def homes(refs: DataFrame, destinations: DataFrame) -> DataFrame:
    """(dataset, project, votes): where most references and destinations (dataset, project) put a dataset; one that none names takes the
    vote of the datasets that share its name's first word. Equal votes go by name; a dataset without a name's kin has none."""
    n = refs.select("dataset", "project").unionByName(destinations.select("dataset", "project")).filter("dataset is not null").groupBy("dataset", "project").agg(F.count("*").alias("votes"))

    def top(rows: DataFrame, by: str) -> DataFrame:
        each = rows.filter("project is not null").groupBy(by, "project").agg(F.sum("votes").alias("votes"))
        best = each.groupBy(by).agg(F.min(F.struct((-F.col("votes")).alias("v"), "project")).alias("t"))
        return best.select(by, F.col("t.project").alias("project"), (-F.col("t.v")).alias("votes"))

    own = top(n, "dataset")
    word = F.regexp_extract("dataset", r"^[^_]+", 0).alias("word")
    kin = top(own.select("*", word), "word").withColumnRenamed("word", "w")
    rest = n.select("dataset").distinct().join(own, "dataset", "left_anti").select("dataset", word)
    return own.unionByName(rest.join(kin, F.col("word") == F.col("w"), "left").select("dataset", "project", F.coalesce("votes", F.lit(0)).alias("votes")))


def report(shapes: DataFrame) -> DataFrame:
    """(statement_type, status, shapes, jobs, errors, unresolved): how the texts of a log were understood."""
    return shapes.groupBy(F.coalesce("record.statement_type", F.lit("unreadable")).alias("statement_type"), F.col("record.status").alias("status")).agg(
        F.count("*").alias("shapes"), F.sum("jobs").alias("jobs"), F.sum("errors").alias("errors"), F.sum(F.size("record.unresolved")).alias("unresolved")
    )


def stratified(rows: DataFrame, strata: dict[str, Column], key: str, each: int, least: int) -> DataFrame:
    """(stratum, key, rank): `each` rows of every stratum that a row is in, by SHA-1 of the key, and as many of no stratum's choice ("rest")
    as bring the sample to `least`. A row of several strata is in each; one sampled already isn't in the rest."""
    spot = F.sha1(F.col(key).cast("string").cast("binary"))
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in sorted(strata.items())]), lambda x: x.isNotNull())
    one = rows.select(F.explode(named).alias("stratum"), F.col(key).alias("key"), spot.alias("spot"))
    rank = lambda w: F.row_number().over(w.orderBy("spot", "key"))
    kept = stored(one.withColumn("rank", rank(W.partitionBy("stratum"))).filter(F.col("rank") <= each).select("stratum", "key", "rank"), "sample")
    short = max(0, least - kept.select("key").distinct().count())
    rest = rows.select(F.col(key).alias("key"), spot.alias("spot")).join(kept.select("key").distinct(), "key", "left_anti").orderBy("spot", "key").limit(short)
    return kept.unionByName(rest.select(F.lit("rest").alias("stratum"), "key", rank(W.partitionBy(F.lit(0))).alias("rank")))


def reruns(sets: DataFrame, edges_of: Callable[[DataFrame], DataFrame], runs: int, share: float, gamma: float, key: str = "shape_id", unit: str = "unit") -> DataFrame:
    """(run, unit, community): communities again, half of the runs with another seed alone, half over a share of the statements too.

    sets (key, unit); edges_of gives (a, b, n) of some of them. A statement is in a run's share by its hash.
    """
    out = None
    for r in range(runs):
        part = sets if r < runs // 2 else sets.filter(F.crc32(F.concat_ws("/", F.col(key).cast("string"), F.lit(str(r))).cast("binary")) / 2**32 < share)
        one = communities(edges_of(part), gamma=gamma, seed=r + 1).select(F.lit(r).alias("run"), F.col("node").alias(unit), "community")
        out = one if out is None else out.unionByName(one)
    return stored(out, "reruns")


def held_together(groups: DataFrame, again: DataFrame, unit: str = "unit") -> DataFrame:
    """(community, stability) of groups (unit, community) over reruns (run, unit, community)."""
    return stability(groups, again, unit, "community", "run")


def blended_nearest(text: DataFrame, usage: DataFrame, level: int, k: int) -> DataFrame:
    """(a, b, score, rank): the k nearest of each node by (1 / level) * usage + (1 - 1 / level) * text; equal scores by name.

    text (query, near, score) has every pair that may count (all, or each node's nearest), usage (a, b, cosine) those used together.
    """
    w = 1.0 / level
    both = usage.select("a", "b", "cosine").union(usage.select("b", "a", "cosine"))
    pairs = text.select(F.col("query").alias("a"), F.col("near").alias("b"), "score").join(both, ["a", "b"], "full")
    scored = pairs.select("a", "b", F.round(w * F.coalesce("cosine", F.lit(0.0)) + (1 - w) * F.coalesce("score", F.lit(0.0)), 6).alias("score"))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))).filter(F.col("rank") <= k)


def relationships(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """(start, column, end): columns (table, column, variable) that hold another table's key (table, column, variable)."""
    ends = keys.select(F.col("table").alias("end"), F.col("column").alias("k"), F.col("variable").alias("v"))
    met = columns.join(ends, F.col("variable") == F.col("v")).filter(~((F.col("table") == F.col("end")) & (F.col("column") == F.col("k"))))
    return met.select(F.col("table").alias("start"), "column", "end").distinct()


def offered(skills: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, near, score, rank): the k skills (skill, embedding, retired) nearest to what is asked, retired ones aside."""
    from loomgraph.operators.graph import nearest

    good = skills.filter(~F.coalesce("retired", F.lit(False))).select(F.col("skill").alias("vec_id"), "embedding")
    return nearest(good, asked, k)


def annotated(turns: DataFrame, annotate: Callable[[str], dict], problems: Callable[[dict], list[str]]) -> DataFrame:
    """turns with `description` and `problems`: what a callable makes of each turn's conversation so far, once an answer passes its checks, or
    after a second try with what is still wrong. Prefixes are joined within a conversation, in order."""
    w = W.partitionBy("conversation").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    said = turns.withColumn("__so_far", F.array_join(F.collect_list(F.concat_ws(": ", "role", "text")).over(w), "\n"))

    def run(text: pd.Series) -> pd.DataFrame:
        out = []
        for t in text:
            found = annotate(t)
            wrong = problems(found)
            if wrong:
                found = annotate(t + "\n" + "; ".join(wrong))
                wrong = problems(found)
            out.append({"description": found.get("description"), "problems": wrong})
        return pd.DataFrame(out, columns=["description", "problems"])

    one = F.pandas_udf(run, "description string, problems array<string>")
    return said.withColumn("__a", one("__so_far")).select(*turns.columns, "__a.*")


def normal(text: str) -> str:
    """Lower case, hyphens and blanks as one blank."""
    return re.sub(r"[\s-]+", " ", (text or "").lower()).strip()


def stands_alone(form: str, text: str) -> bool:
    """Whether an amount is said, not as a part of a longer number, in digits or in words."""
    for m in re.finditer(rf"(?<![\w.$]){re.escape(form)}(?!\w|\.\d)", text):
        before = text[: m.start()].split()
        if not (form[0].isalpha() and before and (before[-1] in NUMBERS)):
            return True
    return False


#: Words that a spoken number is made of.
NUMBERS = {*ONES, *TENS, "hundred"}


def linked(turns: DataFrame, rows: DataFrame, by_name: bool = True, by_amount: bool = True) -> DataFrame:
    """(conversation, key, kind, evidence, turn): rows that a conversation speaks of, with the first turn that says so.

    turns (conversation, seq, text); rows (conversation, key, name, amount, recent): what the conversation's entity has. A
    name is said whole; a name that two rows bear says neither. An amount is said once for one row, the most recent.
    What a row claims is gone for others, so a conversation is one task's group.
    """

    def one(key: tuple, said: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        texts = [(int(s), normal(t)) for s, t in said.sort_values("seq")[["seq", "text"]].itertuples(index=False)]
        out: dict = {}
        claimed: set[str] = set()
        have = have.sort_values(["recent", "key"], ascending=[False, True])
        names = have["name"].map(normal).value_counts()
        for r in have.itertuples(index=False):
            name = normal(r.name)
            if by_name and name and names[name] == 1:
                seen = next((s for s, t in texts if re.search(rf"(?<!\w){re.escape(name)}(?!\w)", t)), None)
                if seen is not None:
                    out[r.key] = ("name", name, seen)
            if by_amount and pd.notna(r.amount):
                hit = next(((s, f) for s, t in texts for f in amount_forms(float(r.amount)) if f not in claimed and stands_alone(f, t)), None)
                if hit:
                    claimed.update(amount_forms(float(r.amount)))
                    if r.key not in out or hit[0] < out[r.key][2]:
                        out[r.key] = ("amount", hit[1], hit[0])
        return pd.DataFrame([(key[0], k, *v) for k, v in out.items()], columns=["conversation", "key", "kind", "evidence", "turn"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    both = turns.groupBy("conversation").cogroup(rows.groupBy("conversation"))
    return both.applyInPandas(one, f"conversation {kinds['conversation']}, key {kinds['key']}, kind string, evidence string, turn long")


def pointed(nodes: DataFrame, edges: DataFrame, label: str, prefix: str) -> DataFrame:
    """The nodes (anchor, label, key, props map) of a label, with the properties of the node each points at (edges start, end) under a prefix."""
    ends = nodes.select(F.col("anchor").alias("a"), F.col("key").alias("e"), F.transform_keys("props", lambda k, _: F.concat(F.lit(prefix + "."), k)).alias("more"))
    at = edges.select(F.col("anchor").alias("x"), F.col("start").alias("s"), F.col("end").alias("t"))
    met = nodes.filter(F.col("label") == label).join(at, (F.col("anchor") == F.col("x")) & (F.col("key") == F.col("s")), "left").join(ends, (F.col("anchor") == F.col("a")) & (F.col("t") == F.col("e")), "left")
    return met.select("anchor", "label", "key", F.when(F.col("more").isNull(), F.col("props")).otherwise(F.map_concat("props", "more")).alias("props"))


def also(rows: DataFrame, keys: DataFrame, fk: str, time: str, since: Column, until: Column, order: list[Column], cap: int) -> DataFrame:
    """The `cap` latest rows of a table outside the model for each key (key), within a window."""
    inside = rows.filter((F.to_date(time) >= since) & (F.to_date(time) <= until)).join(keys.select(F.col("key").alias("__k")).distinct(), F.col(fk) == F.col("__k"), "left_semi")
    return inside.withColumn("rank", F.row_number().over(W.partitionBy(fk).orderBy(*order))).filter(F.col("rank") <= cap)


def noised(edges: DataFrame, share: float, seed: int, a: str = "a", b: str = "b") -> DataFrame:
    """edges with a share of their ends b dealt anew among the ends there are, by hash: the same on every run."""
    h = F.crc32(F.concat_ws("/", F.col(a).cast("string"), F.col(b).cast("string"), F.lit(str(seed))).cast("binary"))
    ends = stored(edges.select(F.col(b).alias("__e")).distinct(), "ends")
    n = ends.count()
    numbered = ends.withColumn("__i", F.row_number().over(W.orderBy("__e")) - 1)
    moved = edges.withColumn("__m", h / 2**32 < share).withColumn("__at", F.pmod(F.xxhash64(a, b, F.lit(seed)), F.lit(max(1, n))).cast("int"))
    out = moved.join(numbered, F.col("__at") == F.col("__i"), "left")
    return out.withColumn(b, F.when(F.col("__m"), F.col("__e")).otherwise(F.col(b))).select(*edges.columns)
