"""Personal data by weak supervision.

Candidate spans come from broad patterns. Labelers - strict formats, gazetteers, words around the span - vote 1, -1 or
0 (no opinion) on each. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
is, its posteriors train a logistic span classifier over votes and span features, and spans that it accepts are added
to those of the four base kinds, which always stay.

Only counts of patterns reach the driver: at most 3**LABELERS votes times the kinds and feature buckets.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import stored, table

LOCAL = "[A-Za-z0-9._%+-]"
#: Base kinds, in the order in which spans that start together are listed. A match starts where a run of its first
#: class starts or the last match ended, so failing starts inside a run aren't tried again; loops are possessive, so
#: long matches use no stack.
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to occur, cheaper to look for than the pattern.
HINT = {"email": "@", "ip": ".", "card": "", "phone": "+"}
# Given names and titles of the person gazetteer, country codes of the account gazetteer.
GIVEN = "Anna|Maria|Peter|Paul|John|Mary|James|Robert|Michael|Linda|David|Susan|Thomas|Karen|Hans|Klaus|Ursula|Jean|Pierre|Marie|Claire|Jose|Juan|Carmen|Luis|Ana"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra"
COUNTRIES = "AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE"
#: Added kinds, each with its pattern, strict format, gazetteer ("" where there is none), and words that speak for it.
ADDED = {
    "ssn": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", "", r"(?i)\b(?:ssn|social security)\b"),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: [0-9A-Z]{4}){3,7}(?: [0-9A-Z]{1,3})?(?![0-9A-Za-z])", r"^[A-Z]{2}[0-9]{2}(?: [0-9]{4}){3,}", rf"^(?:{COUNTRIES})", r"(?i)\b(?:iban|account|konto|compte|cuenta)\b"),
    "national_phone": (r"(?<![0-9+(.-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", r"^(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-][2-9][0-9]{2}[ .-][0-9]{4}$", "", r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|telefono)\b"),
    "person": (rf"(?<!\p{{L}})(?:(?:{TITLES})\.? (?:\p{{Lu}}\p{{Ll}}{{1,30}} ?){{1,2}}|(?:{GIVEN}) \p{{Lu}}\p{{Ll}}{{1,30}})(?!\p{{L}})", rf"^(?:{TITLES})\.? \p{{Lu}}", rf"\b(?:{GIVEN})\b", r"(?i)\b(?:name|dear|contact|author|signed|regards)\b"),
}
KINDS = [*BASE, *ADDED]
AGAINST = r"(?i)\b(?:order|invoice|version|isbn|part|serial|sku|no)\b"
LABELERS = ["format", "gazetteer", "context_for", "context_against", "glued"]
#: Code points before a span that the context labelers read.
REACH = 48


#: Elements of an array that are folded at once; arrays of a million elements fold in a second.
BLOCK = 64


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x), where x is worked out once, however often the body or a function inside it names it."""
    return F.transform(F.array(x), body)[0]


def before_each(values: Column, zero: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints the fold of those before it; op is associative, zero its neutral element.

    Blocks of BLOCK values are folded first, then these, then each block from its own start, so an array that grows
    by an element at a time stays short.
    """

    def run(array: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(array, first, lambda a, v: F.struct(op(a["at"], v).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def cut(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))

    def folded(blocks: Column) -> Column:
        return F.flatten(F.zip_with(blocks, run(F.transform(blocks, lambda b: F.aggregate(b, zero, op)), zero), run))

    return bound(values, lambda v: F.when(F.size(v) > 0, bound(cut(v), folded)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, kind: str, pattern: str) -> Column:
    """The leftmost non-overlapping matches of pattern: structs (g, v), the text between the last match and this, and this."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)  # they see the same matches
    pairs = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.struct(g.alias("g"), v.alias("v")))
    hint = HINT.get(kind, "")
    some = F.contains(text, F.lit(hint)) if hint else F.lit(True)
    return F.when(some & text.rlike(pattern), pairs).otherwise(F.array().cast("array<struct<g:string,v:string>>"))


def spans(found: Column, kind: str) -> Column:
    """matches() as structs (start, end, kind, value, before), in code points; summed lengths place them."""
    ends = before_each(F.transform(found, lambda x: F.length(x["g"]) + F.length(x["v"])), F.lit(0), lambda a, b: a + b)

    def placed(x: Column, at: Column) -> Column:
        start = at + F.length(x["g"])
        return F.struct(start.alias("start"), (start + F.length(x["v"])).alias("end"), F.lit(KINDS.index(kind)).alias("kind"), x["v"].alias("value"), F.right(x["g"], F.lit(REACH)).alias("before"))

    none = F.array().cast("array<struct<start:int,end:int,kind:int,value:string,before:string>>")
    return F.when(F.size(found) == 0, none).otherwise(F.zip_with(found, ends, placed))


def apart(added: Column, base: Column) -> Column:
    """The spans of `added`, in order, that overlap none of `base`: in one list by start, none before reaches in, none after starts inside."""
    far = 2**31 - 1
    mark = lambda of: lambda s: F.struct(s["start"].alias("start"), F.lit(of).alias("added"), s["end"].alias("end"), s.alias("s"))
    every = F.array_sort(F.concat(F.transform(base, mark(0)), F.transform(added, mark(1))))
    reach = before_each(F.transform(every, lambda e: F.when(e["added"] == 0, e["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    ahead = F.reverse(before_each(F.reverse(F.transform(every, lambda e: F.when(e["added"] == 0, e["start"]).otherwise(far))), F.lit(far), lambda a, b: F.least(a, b)))
    seen = F.zip_with(F.zip_with(every, reach, lambda e, r: F.struct(e.alias("e"), r.alias("r"))), ahead, lambda x, n: F.struct(x["e"].alias("e"), ((x["e"]["added"] == 1) & (x["r"] <= x["e"]["start"]) & (n >= x["e"]["end"])).alias("free")))
    free = F.transform(F.filter(seen, lambda x: x["free"]), lambda x: x["e"]["s"])
    return F.when(F.size(added) == 0, added).when(F.size(base) == 0, F.array_sort(added)).otherwise(free)


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(a: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return a + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """What a match of a base kind must pass to stay."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+(?=.)", "")).between(1, 3) & (F.right(p, F.lit(9)).cast("int") <= 255))
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def votes(s: Column) -> list[Column]:
    """What each labeler says of a span."""

    def by_kind(which: int, miss: int) -> Column:
        out = F.lit(0)
        for kind, rules in ADDED.items():
            if rules[which]:
                out = F.when(s["kind"] == KINDS.index(kind), F.when(s["value"].rlike(rules[which]), 1).otherwise(miss)).otherwise(out)
        return out

    return [
        F.when(s["kind"] < len(BASE), 1).otherwise(by_kind(1, -1)),
        by_kind(2, -1),
        said(s),
        F.when(s["before"].rlike(AGAINST), -1).otherwise(0),
        F.when(s["before"].rlike(r"[=/#&?_]$"), -1).otherwise(0),
    ]


def said(s: Column) -> Column:
    out = F.when(s["before"].rlike(r"(?i)\b(?:mail|tel|phone|call|card|ip|contact)\b"), 1).otherwise(0)
    for kind, rules in ADDED.items():
        out = F.when(s["kind"] == KINDS.index(kind), F.when(s["before"].rlike(rules[3]), 1).otherwise(0)).otherwise(out)
    return out


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, base, added): the valid base spans, and candidates that overlap none of them, with votes and features."""
    body = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    patterns = BASE | {k: r[0] for k, r in ADDED.items()}
    found = body.select("doc_id", *[matches(F.col("text"), k, p).alias(f"in_{k}") for k, p in patterns.items()])
    kept = lambda kind: F.filter(spans(F.col(f"in_{kind}"), kind), lambda s: valid(kind, s["value"]))
    base, more = F.array_sort(F.concat(*map(kept, BASE))), F.concat(*[spans(F.col(f"in_{k}"), k) for k in ADDED])
    look = lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.array(*[v.cast("int") for v in votes(s)]).alias("votes"),
        F.least((s["end"] - s["start"]) / 8, F.lit(5)).cast("int").alias("size"),
    )
    both = found.select("doc_id", base.alias("base"), more.alias("more")).select("doc_id", "base", apart(F.col("more"), F.col("base")).alias("added"))
    return both.select("doc_id", F.transform("base", look).alias("base"), F.array_sort(F.transform("added", look)).alias("added"))


@dataclass
class Model:
    """reliability: P(vote = 1 | vote, personal) and P(vote = 1 | vote, other) of each labeler; weights of the classifier."""

    prior: float
    reliability: list[tuple[float, float]]
    weights: list[float]

    def logit(self, s: Column) -> Column:
        return sum((F.lit(w) * x for w, x in zip(self.weights[1:], features(s), strict=True)), F.lit(self.weights[0]))


def features(s: Column) -> list[Column]:
    return [*[s["votes"][i].cast("double") for i in range(len(LABELERS))], s["size"].cast("double") / 5, *[(s["kind"] == k).cast("double") for k in range(len(KINDS))]]


def pattern_counts(spans_of: DataFrame) -> list[tuple[int, tuple[int, ...], int, int]]:
    """(kind, votes, size, n): the only thing that leaves the cluster, bounded by the number of patterns."""
    s = spans_of.select(F.explode(F.concat("base", "added")).alias("s"))
    rows = s.groupBy("s.kind", "s.votes", "s.size").agg(F.count("*").alias("n")).collect()
    return sorted((r["kind"], tuple(r["votes"]), r["size"], r["n"]) for r in rows)


def fit(counts: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 50, steps: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> Model:
    """Expectation-maximisation over vote patterns, then logistic regression on its posteriors.

    The prior starts at a half and a labeler at 0.8 against 0.2; one pseudo-vote on each side keeps both off 0 and 1.
    Without candidates the model keeps those and accepts what more labelers speak for than against.
    """
    prior, trust = 0.5, [(0.8, 0.2)] * len(LABELERS)
    total = sum(n for *_, n in counts)

    def posterior(v: tuple[int, ...]) -> float:
        z = math.log(prior) - math.log(1 - prior)
        for x, (p, q) in zip(v, trust, strict=True):
            if x:
                z += math.log(p if x > 0 else 1 - p) - math.log(q if x > 0 else 1 - q)
        return 1 / (1 + math.exp(-max(-30, min(30, z))))

    for _ in range(rounds if total else 0):
        soft = [(v, posterior(v), n) for _, v, _, n in counts]
        prior = (sum(p * n for _, p, n in soft) + 1) / (total + 2)
        trust = []
        for i in range(len(LABELERS)):
            up = [sum((p if good else 1 - p) * n for v, p, n in soft if v[i] > 0) for good in (True, False)]
            any_ = [sum((p if good else 1 - p) * n for v, p, n in soft if v[i]) for good in (True, False)]
            trust.append(((up[0] + 0.8) / (any_[0] + 1), (up[1] + 0.2) / (any_[1] + 1)))
    x = [[1.0, *map(float, v), size / 5, *[float(k == j) for j in range(len(KINDS))]] for k, v, size, _ in counts]
    y, n = [posterior(v) for _, v, _, _ in counts], [c for *_, c in counts]
    w = [0.0, *[math.log(p / q) for p, q in trust], 0.0, *[0.0] * len(KINDS)]
    for _ in range(steps if total else 0):
        g = [ridge * a for a in w]
        for row, t, c in zip(x, y, n, strict=True):
            e = (1 / (1 + math.exp(-max(-30, min(30, sum(map(float.__mul__, w, row))))))) - t
            for j, a in enumerate(row):
                g[j] += e * a * c / total
        w = [a - rate * b for a, b in zip(w, g, strict=True)]
    return Model(prior, trust, w)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, the counts and digest of the base kinds, all spans, and the number of added ones.

    Null and empty texts have no spans (digest of the empty string, spans ""); rows that repeat an id are read apart;
    an empty table gives no rows; other columns play no part. Spans are kind:start:end by start, then by kind.
    """
    seen = stored(candidates(docs, key, text), "spans")
    model = fit(pattern_counts(seen))
    names = F.array(*map(F.lit, KINDS))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    taken = F.filter("added", lambda s: model.logit(s) >= 0)
    return seen.select("doc_id", *map(count, BASE), F.sha2(shown("base"), 256).alias("base_sha256"), shown(F.array_sort(F.concat("base", taken))).alias("spans"), F.size(taken).cast("long").alias("n_added"))


def op2_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
