"""Entity contexts over a model of nodes and relationships: what surrounds an entity, read hop by hop for many at once.

A model is metadata; reading it is joins. A relationship is a column of its start table that holds the end's key, so
from start to end there is one row, from end to start there may be many: those are bounded in time and number.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@dataclass(frozen=True)
class Kind:
    """A label of nodes: the table they are in, its key, and the column that says when a row is of."""

    label: str
    table: str
    key: str
    time: str | None = None


@dataclass(frozen=True)
class Link:
    """start has a column that holds end's key."""

    name: str
    start: str
    column: str
    end: str


@dataclass(frozen=True)
class Read:
    """One step of a template: over a link, from label to label, to one row or to many."""

    hop: int
    link: str
    from_label: str
    to_label: str
    many: bool


@dataclass(frozen=True)
class Model:
    kinds: tuple[Kind, ...]
    links: tuple[Link, ...]

    def kind(self, label: str) -> Kind:
        return next(k for k in self.kinds if k.label == label)

    def problems(self, columns: dict[str, list[str]]) -> list[str]:
        """What a model says that its tables (their columns by name) don't bear out."""
        labels = [k.label for k in self.kinds]
        out = [f"label {x} stands twice" for x in sorted({x for x in labels if labels.count(x) > 1})]
        out += [f"{k.label}: table {k.table} has no {c}" for k in self.kinds for c in (k.key, k.time) if c and c not in columns.get(k.table, [])]
        for x in self.links:
            if x.start not in labels or x.end not in labels:
                out.append(f"{x.name}: {x.start} to {x.end} joins no known labels")
            elif x.column not in columns.get(self.kind(x.start).table, []):
                out.append(f"{x.name}: {x.column} is no column of its start")
        return out

    def restricted(self, tables: set[str], hidden: set[tuple[str, str]] = frozenset()) -> Model:
        """What of the model one may see who may read these tables but for hidden (table, column)s."""
        kinds = tuple(k for k in self.kinds if k.table in tables and (k.table, k.key) not in hidden)
        labels = {k.label: k.table for k in kinds}
        return Model(kinds, tuple(x for x in self.links if x.start in labels and x.end in labels and (labels[x.start], x.column) not in hidden))


def template(model: Model, anchor: str, hops: int) -> list[Read]:
    """The reads around an anchor: at hop 1 every link that touches it, further on those to one row alone; each link once."""
    out, seen, front = [], set(), [anchor]
    for hop in range(1, hops + 1):
        further = []
        for label in front:
            for x in sorted(model.links, key=lambda x: (x.name, x.start, x.end)):
                if x.name in seen or label not in (x.start, x.end) or (hop > 1 and label != x.start):
                    continue
                seen.add(x.name)
                to = x.end if label == x.start else x.start
                out.append(Read(hop, x.name, label, to, label != x.start))
                further.append(to)
        front = list(dict.fromkeys(further))
    return out


def digest(reads: list[Read], cap: int, quarters: int) -> str:
    """The id of a template: equal for equal reads and bounds."""
    return hashlib.sha256(json.dumps([asdict(r) for r in reads] + [cap, quarters], sort_keys=True).encode()).hexdigest()[:16]


@dataclass
class Contexts:
    """nodes (anchor, label, key, hop); edges (anchor, link, start, end); reads (anchor, link, n, capped)."""

    nodes: DataFrame
    edges: DataFrame
    reads: DataFrame


def contexts(model: Model, tables: Callable[[str], DataFrame], anchor: str, keys: DataFrame, reads: list[Read], cap: int, since: Column, until: Column | None = None) -> Contexts:
    """The contexts of the anchors keys (key), all at once: each is what it would be alone.

    Many rows of a link are those of since to until (both days included), the `cap` latest of each anchor, equal days by
    key; one more tells that there were more. Anchors that are no rows have no context; null keys are none. Keys are
    compared and given as text.
    """
    top = model.kind(anchor)
    held = tables(top.table).select(F.col(top.key).cast("string").alias("anchor")).distinct()
    start = keys.select(F.col("key").cast("string").alias("anchor")).dropna().distinct().join(held, "anchor", "left_semi")
    found = {anchor: start.select("anchor", F.col("anchor").alias("key"))}
    nodes, edges, stats = start.select("anchor", F.lit(anchor).alias("label"), F.col("anchor").alias("key"), F.lit(0).alias("hop")), None, None
    for r in reads:
        link = next(x for x in model.links if x.name == r.link)
        here, begin, end = found[r.from_label], model.kind(link.start), model.kind(link.end)
        rows = tables(begin.table).select(F.col(begin.key).cast("string").alias("s"), F.col(link.column).cast("string").alias("e"), (F.to_date(begin.time) if begin.time else F.lit(None).cast("date")).alias("day"))
        if r.many:
            if begin.time:
                rows = rows.filter(F.col("day") >= since)
                rows = rows if until is None else rows.filter(F.col("day") <= until)
            met = here.join(rows, F.col("key") == F.col("e"))
            spot = W.partitionBy("anchor").orderBy(F.desc_nulls_last("day"), "s")
            met = met.withColumn("r", F.row_number().over(spot)).filter(F.col("r") <= cap + 1)
            n = met.groupBy("anchor").agg(F.least(F.max("r"), F.lit(cap)).cast("long").alias("n"), (F.max("r") > cap).alias("capped"))
            met = met.filter(F.col("r") <= cap)
            new = met.select("anchor", F.col("s").alias("key"))
        else:
            met = here.join(rows, F.col("key") == F.col("s")).filter("e is not null")
            there = tables(end.table).select(F.col(end.key).cast("string").alias("x")).distinct()
            met = met.join(there, F.col("e") == F.col("x"), "left_semi")
            n = met.groupBy("anchor").agg(F.count("*").alias("n"), F.lit(False).alias("capped"))
            new = met.select("anchor", F.col("e").alias("key"))
        edge = met.select("anchor", F.lit(r.link).alias("link"), F.col("s").alias("start"), F.col("e").alias("end"))
        stat = n.select("anchor", F.lit(r.link).alias("link"), "n", "capped")
        found[r.to_label] = new.distinct() if r.to_label not in found else found[r.to_label].union(new).distinct()
        nodes = nodes.unionByName(new.distinct().select("anchor", F.lit(r.to_label).alias("label"), "key", F.lit(r.hop).alias("hop")))
        edges, stats = (edge if edges is None else edges.unionByName(edge)), (stat if stats is None else stats.unionByName(stat))
    nodes = nodes.groupBy("anchor", "label", "key").agg(F.min("hop").alias("hop"))
    return Contexts(nodes, edges.distinct(), stats)


def cadence(days: DataFrame, key: str, day: str) -> DataFrame:
    """(key, cadence): the median of the days between a key's distinct days; null where it has one alone."""
    w = W.partitionBy(key).orderBy("d")
    each = days.select(key, F.to_date(day).alias("d")).dropna().distinct().select(key, F.datediff("d", F.lag("d").over(w)).alias("gap"))
    return each.groupBy(key).agg(F.percentile("gap", 0.5).alias("cadence"))


def holds_until(tables: DataFrame, fetched: Column, default_days: int) -> Column:
    """The day until which what was read holds: a cadence on; null (for ever) where nothing writes any more; `default_days` where none is known.

    tables has frozen and cadence.
    """
    days = F.coalesce(F.ceil("cadence").cast("int"), F.lit(default_days))
    return F.when(F.coalesce("frozen", F.lit(False)), F.lit(None).cast("date")).otherwise(F.date_add(fetched, days))


def fresh(steps: DataFrame, now: Column) -> DataFrame:
    """(reader, anchor, template, step, fetched): each reader's latest stored context of an anchor that still holds.

    steps (reader, anchor, template, step, fetched, until, capped); a null until holds for ever.
    """
    good = steps.filter((F.col("until").isNull() | (F.col("until") >= now)) & (F.col("fetched") <= now))
    last = F.max_by(F.struct("step", "fetched"), F.struct("fetched", "step")).alias("l")
    return good.groupBy("reader", "anchor", "template").agg(last).select("reader", "anchor", "template", "l.step", "l.fetched")


def guarded(nodes: DataFrame, readable: DataFrame, policied: DataFrame, now: Column) -> DataFrame:
    """The nodes a reader may be shown: of a readable table (table), still holding, and of a policied table (table) only what the reader read.

    nodes has reader, table, until and read_by.
    """
    mine = readable.select(F.col("reader").alias("__r"), F.col("table").alias("__t"))
    some = nodes.join(mine, (F.col("reader") == F.col("__r")) & (F.col("table") == F.col("__t")), "left_semi").filter(F.col("until").isNull() | (F.col("until") >= now))
    rows = policied.select(F.col("table").alias("__p")).distinct()
    kept = some.join(rows, F.col("table") == F.col("__p"), "left_anti")
    return kept.unionByName(some.filter("read_by <=> reader").join(rows, F.col("table") == F.col("__p"), "left_semi"))


def swept(rows: DataFrame, kind: str, time: str, keep_days: dict[str, int], now: Column) -> tuple[DataFrame, DataFrame]:
    """(kept rows, counts (kind, n, n_gone)): rows past the days their kind is kept go; a kind that isn't named stays."""
    limit = F.create_map(*[F.lit(x) for k, v in sorted(keep_days.items()) for x in (k, v)]) if keep_days else F.create_map().cast("map<string,int>")
    days = F.try_element_at(limit, F.col(kind).cast("string"))
    gone = F.coalesce(F.datediff(now, F.to_date(time)) > days, F.lit(False))
    counts = rows.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(gone).alias("n_gone"))
    return rows.filter(~gone), counts


def current_facts(facts: DataFrame, at: Column) -> DataFrame:
    """The facts (subject, predicate, value, valid_from, valid_until) that hold at a time; a null end is open."""
    return facts.filter((F.col("valid_from") <= at) & (F.col("valid_until").isNull() | (F.col("valid_until") > at)))


def superseded(facts: DataFrame, by: list[str], recorded: str, valid_from: str, corrected: str) -> DataFrame:
    """facts with valid_until and how: the next fact of the same thing ends this one when it is recorded (changed), or at once, if it
    corrects it (corrected, a boolean: the fact never held); the last one holds (null)."""
    w = W.partitionBy(*by).orderBy(recorded)
    after, fixes = F.lead(recorded).over(w), F.lead(corrected).over(w)
    until = F.when(fixes, F.col(valid_from)).otherwise(after)
    return facts.withColumn("valid_until", until).withColumn("how", F.when(after.isNull(), F.lit(None).cast("string")).when(fixes, "corrected").otherwise("changed"))


def chained(lines: DataFrame, conversation: str, order: list[str], key: str) -> DataFrame:
    """(conversation, seq, key, next): a conversation's lines in order, each with the one after it."""
    w = W.partitionBy(conversation).orderBy(*order)
    return lines.select(conversation, F.row_number().over(w).alias("seq"), F.col(key), F.lead(key).over(w).alias("next"))


def find(rows: DataFrame, wanted: DataFrame, column: str, key: str) -> DataFrame:
    """(value, key, n): what a property=value names; key is null unless exactly one row has it."""
    n = rows.select(F.col(column).cast("string").alias("value"), F.col(key).cast("string").alias("k")).join(wanted.select("value").distinct(), "value")
    return n.groupBy("value").agg(F.when(F.count("*") == 1, F.min("k")).alias("key"), F.count("*").alias("n"))


def answerable(asked: dict, context: dict, today: str) -> str | None:
    """Why a context can't answer a request, or None if it can.

    asked: anchors, tables, period (first, last) or None; context: anchor, tables, until, since, capped (tables).
    """
    if len(asked["anchors"]) != 1 or asked["anchors"][0] != context["anchor"]:
        return "it is not about this one entity"
    if context["until"] is not None and context["until"] < today:
        return "the context no longer holds"
    if missing := sorted(set(asked["tables"]) - set(context["tables"])):
        return f"{missing[0]} is not in the context"
    if asked["period"] and asked["period"][0] < context["since"]:
        return "the period starts before the context does"
    if many := sorted(set(asked["tables"]) & set(context["capped"])):
        return f"{many[0]} is not whole in the context"
    return None


def label(table: str) -> str:
    """A label from a table's name: its words, in capitals, without what layers put before it, in the singular."""
    words = [w for w in re.split(r"[^a-zA-Z0-9]+", table.rsplit(".", 1)[-1]) if w]
    words = [w for w in words if w.lower() not in ("dim", "fct", "fact", "stg", "raw", "tbl")] or words
    text = "".join(w[:1].upper() + w[1:] for w in words)
    return text[:-1] if text.endswith("s") and not text.endswith("ss") and len(text) > 3 else text


def distinct_labels(tables: list[str]) -> dict[str, str]:
    """A label for each table; tables whose labels are equal get their dataset's name before it, and then a number."""
    out = {t: label(t) for t in sorted(tables)}
    for mend in (lambda t, i: label(t.rsplit(".", 2)[-2] if "." in t else t) + out[t], lambda t, i: out[t] + (str(i + 1) if i else "")):
        for name in sorted({x for x in out.values() if list(out.values()).count(x) > 1}):
            for i, t in enumerate([t for t in out if out[t] == name]):
                out[t] = mend(t, i)
    return out
