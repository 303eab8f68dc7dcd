"""The bottom layer: a log of jobs and the records of its texts as tables of shapes, reads, joins, writes and flows.

A log (query, principal, job_type, destination, ts, error, cache_hit, bytes) becomes groups; distinct texts are read
once each, the representative of a shape is traced once, and all evidence is grouped from there. Ids of columns are
table.column. Rows are keyed by shape, so no operator gathers more than one shape's record in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.operators.graph import components
from loomgraph.plans import lineage as LN
from loomgraph.sources.shared import stored

# Functions that change a key's form alone, functions that pick one of its values, and steps that keep it.
FORMAT_FNS = ["TRIM", "LTRIM", "RTRIM", "LPAD", "RPAD", "UPPER", "LOWER"]
PICK_FNS = ["MAX", "MIN", "ANY_VALUE", "ARRAY_AGG", "SAFE_OFFSET", "OFFSET"]
IDENTITY_VIAS = ["direct", "passthrough", "rename", "unnest", "aggregate"]
NUMERIC = ["INT64", "NUMERIC", "BIGNUMERIC", "FLOAT64"]
PASSES = 5
#: Join keys that are judged on the driver at most.
KEYS = 20_000


def groups(jobs: DataFrame, *keys: str) -> DataFrame:
    """Jobs by query, job_type, principal, week (from Monday) and destination, and what other keys are named.

    jobs, errors, cache_hits, bytes_billed, first_seen, last_seen, days (those of the group, sorted: seven at most).
    """
    by = ["query", "job_type", "principal", F.to_date(F.date_trunc("week", "ts")).alias("week"), "destination", *keys]
    return jobs.groupBy(*by).agg(
        F.count("*").alias("jobs"), F.count_if("error").alias("errors"), F.count_if("cache_hit").alias("cache_hits"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_billed"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.array_sort(F.collect_set(F.to_date("ts"))).alias("days"),
    )


def texts(grouped: DataFrame) -> DataFrame:
    """(query, jobs, errors, ok): each distinct text with its jobs; rows without a text are no text's."""
    n = grouped.filter("query is not null").groupBy("query").agg(F.sum("jobs").alias("jobs"), F.sum("errors").alias("errors"))
    return n.withColumn("ok", F.col("jobs") - F.col("errors"))


def shaped(distinct: DataFrame, names: LN.Names, views: DataFrame | None = None) -> DataFrame:
    """texts with text_id, shape_id, literals, statements, error and origin; views (query) are definitions, which ran never."""
    every = distinct.withColumn("origin", F.lit("log"))
    if views is not None:
        every = every.unionByName(views.select("query", *[F.lit(0).cast("long").alias(c) for c in ("jobs", "errors", "ok")], F.lit("view").alias("origin")))
    return LN.fingerprints(every, "query", names)


def representatives(of: DataFrame) -> DataFrame:
    """(shape_id, query, origin): a shape's text with most good runs, of equal ones the shortest, then the first; views come last
    but for texts that never ran well."""
    view = F.col("origin") == "view"
    best = F.min(F.struct(F.when(view, 0).otherwise(-F.col("ok")).alias("r"), F.when(view, 0).otherwise(F.length("query")).alias("l"), "query", "origin")).alias("b")
    return of.filter("shape_id is not null").groupBy("shape_id").agg(best).select("shape_id", "b.query", "b.origin")


def shapes(of: DataFrame, grouped: DataFrame, catalog: LN.Tables) -> DataFrame:
    """Each shape with its record, its statistics (jobs, errors, texts, cache_hits, bytes, first and last seen) and whether it succeeded."""
    each = grouped.join(of.select("query", "shape_id", "text_id"), "query")
    stats = each.groupBy("shape_id").agg(
        *[F.sum(c).alias(c) for c in ("jobs", "errors", "cache_hits", "bytes_billed")], F.count_distinct("text_id").alias("texts"), F.count_distinct("principal").alias("people"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    traced = LN.records(representatives(of), "query", catalog)
    out = traced.join(stats, "shape_id", "left").na.fill(0, ["jobs", "errors", "cache_hits", "bytes_billed", "texts", "people"])
    return out.withColumn("succeeded", (F.col("origin") == "view") | (F.col("jobs") > F.col("errors")))


def name_of(s: Column | str) -> Column:
    s = F.col(s) if isinstance(s, str) else s
    return F.concat_ws(".", s["table"], s["column"])


def refs(of: DataFrame) -> DataFrame:
    """(shape_id, table, kind, partition_filter): tables a shape names; unknown ones only if it succeeded."""
    each = of.select("shape_id", "succeeded", F.col("record.scan.partition_filter").alias("p"), F.explode("record.tables").alias("t"))
    return each.filter(F.col("succeeded") | (F.col("t.kind") != "unknown")).select("shape_id", F.col("t.id").alias("table"), "t.kind", F.try_element_at("p", F.col("t.id")).alias("partition_filter"))


def reads(of: DataFrame) -> DataFrame:
    """(shape_id, col, path, roles, derived_roles, agg) of shapes that succeeded."""
    each = of.filter("succeeded").select("shape_id", F.explode("record.reads").alias("r"))
    return each.select("shape_id", name_of("r").alias("col"), "r.path", "r.roles", "r.derived_roles", "r.agg")


def filters(of: DataFrame) -> DataFrame:
    """(shape_id, i, col, path, op, clause, wrap, slots) of shapes that succeeded."""
    each = of.filter("succeeded").select("shape_id", F.posexplode("record.filters").alias("i", "f"))
    return each.select("shape_id", "i", name_of("f").alias("col"), "f.path", "f.op", "f.clause", "f.wrap", "f.slots")


def filter_values(found: DataFrame, of: DataFrame, n: int) -> DataFrame:
    """(shape_id, i, value, jobs, rank): the n values a filter was run with most, over all good texts of its shape; equal ones by value."""
    used = of.filter("ok > 0 and shape_id is not null").select("shape_id", "ok", "literals")
    slots = found.select("shape_id", "i", F.explode("slots").alias("slot"))
    one = used.select("shape_id", "ok", F.posexplode("literals").alias("slot", "said")).join(slots, ["shape_id", "slot"])
    each = one.select("shape_id", "i", "ok", F.explode("said").alias("value")).groupBy("shape_id", "i", "value").agg(F.sum("ok").alias("jobs"))
    return each.withColumn("rank", F.row_number().over(W.partitionBy("shape_id", "i").orderBy(F.desc("jobs"), "value"))).filter(F.col("rank") <= n)


def join_uses(of: DataFrame) -> DataFrame:
    """(shape_id, key, l, r, type, wraps, vias): the joins of shapes that succeeded; sides in order of their ids, whichever came first."""
    each = of.filter("succeeded").select("shape_id", F.explode("record.joins").alias("j"))
    side = lambda s: F.concat(name_of(s), F.when(s["path"].isNotNull(), F.concat(F.lit("#"), s["path"])).otherwise(F.lit("")))
    a, b = F.col("j.left"), F.col("j.right")
    first = side(a) <= side(b)
    key = F.concat_ws("=", F.least(side(a), side(b)), F.greatest(side(a), side(b)))
    ordered = lambda x, y: F.when(first, name_of(x)).otherwise(name_of(y))
    return each.select("shape_id", key.alias("key"), ordered(a, b).alias("l"), ordered(b, a).alias("r"), "j.type", F.concat(a["wrap"], b["wrap"]).alias("wraps"), F.array(a["via"], b["via"]).alias("vias"))


def write_columns(of: DataFrame) -> DataFrame:
    w = of.filter("succeeded").select("shape_id", "jobs", "record.statement_type", F.col("record.tables").alias("tables"), F.explode("record.writes").alias("w"))
    return w.select("shape_id", "jobs", "statement_type", "tables", F.col("w.table").alias("table"), F.col("w.mode").alias("mode"), F.col("w.columns").alias("columns"), F.col("w.merge_keys").alias("merge_keys"))


def writes(of: DataFrame) -> DataFrame:
    """(shape_id, table, mode, merge_keys) of shapes that succeeded."""
    return write_columns(of).select("shape_id", "table", "mode", F.coalesce(F.transform("merge_keys", lambda k: k["target"]), F.array().cast("array<string>")).alias("merge_keys"))


def flows(of: DataFrame) -> DataFrame:
    """(src, tgt, kinds, fns, paths, shapes, jobs, control): lineage of written columns; it steers only if every statement says so."""
    c = write_columns(of).select("shape_id", "jobs", "table", F.explode("columns").alias("c")).select("shape_id", "jobs", "table", "c", F.explode("c.from").alias("f"))
    rows = c.select(name_of("f").alias("src"), F.concat_ws(".", "table", "c.target").alias("tgt"), F.col("c.kind").alias("kind"), F.col("c.fn").alias("fn"), F.col("f.path").alias("path"), "f.control", "shape_id", "jobs")
    flat = lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_set(x))))
    return rows.groupBy("src", "tgt").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), flat("fn").alias("fns"), F.array_sort(F.collect_set("path")).alias("paths"), F.count_distinct("shape_id").alias("shapes"),
        F.sum("jobs").alias("jobs"), F.bool_and("control").alias("control"),
    )


def derived_from(of: DataFrame) -> DataFrame:
    """(tgt, src, modes, shapes, jobs): tables that feed a written one, by a column or by being read in the statement."""
    w = write_columns(of)
    by_column = w.select("shape_id", "jobs", "mode", F.col("table").alias("tgt"), F.explode(F.flatten(F.transform("columns", lambda c: F.transform(c["from"], lambda f: f["table"])))).alias("src"))
    by_read = w.select("shape_id", "jobs", "mode", F.col("table").alias("tgt"), F.explode("tables").alias("t")).filter("t.id <> tgt and t.kind <> 'system'")
    each = by_column.unionByName(by_read.select("shape_id", "jobs", "mode", "tgt", F.col("t.id").alias("src"))).distinct()
    return each.groupBy("tgt", "src").agg(F.array_sort(F.collect_set("mode")).alias("modes"), F.count_distinct("shape_id").alias("shapes"), F.sum("jobs").alias("jobs"))


def ran(grouped: DataFrame, of: DataFrame) -> DataFrame:
    """(principal, shape_id, jobs, errors, cache_hits, bytes_billed, n_days, first_seen, last_seen): what each principal ran; days of good runs alone."""
    each = grouped.filter("job_type <> 'LOAD' and query is not null").join(of.select("query", "shape_id").filter("shape_id is not null"), "query")
    days = each.filter("jobs > errors").select("principal", "shape_id", F.explode("days").alias("day")).groupBy("principal", "shape_id").agg(F.count_distinct("day").alias("n_days"))
    n = each.groupBy("principal", "shape_id").agg(*[F.sum(c).alias(c) for c in ("jobs", "errors", "cache_hits", "bytes_billed")], F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return n.join(days, ["principal", "shape_id"], "left").na.fill(0, ["n_days"])


def loaded(grouped: DataFrame) -> DataFrame:
    """(principal, table, jobs, errors, n_days): what each principal loaded from outside."""
    each = grouped.filter("job_type = 'LOAD' and destination is not null").select("principal", F.col("destination").alias("table"), "jobs", "errors", F.explode("days").alias("day"), "week")
    n = each.dropDuplicates(["principal", "table", "week", "jobs", "errors"]).groupBy("principal", "table").agg(F.sum("jobs").alias("jobs"), F.sum("errors").alias("errors"))
    return n.join(each.groupBy("principal", "table").agg(F.count_distinct("day").alias("n_days")), ["principal", "table"])


def write_days(grouped: DataFrame, of: DataFrame, written: DataFrame) -> DataFrame:
    """(table, day): the days a table was written on, by a load or by a statement that is no view's definition."""
    by_load = grouped.filter("job_type = 'LOAD' and destination is not null").select(F.col("destination").alias("table"), F.explode("days").alias("day"))
    good = grouped.filter("job_type <> 'LOAD' and jobs > errors").join(of.select("query", "shape_id"), "query").select("shape_id", F.explode("days").alias("day")).distinct()
    return by_load.union(good.join(written.filter("mode <> 'VIEW'").select("shape_id", "table").distinct(), "shape_id").select("table", "day")).distinct()


def profile_shares(profiles: DataFrame) -> DataFrame:
    """Profiles with shares of jobs on weekends and in business hours, and of slots that recur."""
    share = lambda c: F.try_divide(F.col(c), F.col("jobs"))
    return profiles.withColumns({"weekend_share": share("weekend_jobs"), "business_hours_share": share("business_jobs")})


def assets(catalog: DataFrame, referenced: DataFrame, used: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tables, columns) of catalog (table, kind, column, type), and of names that only the log knows: refs (table, kind), columns (col)."""
    known = catalog.select(F.col("table").alias("id"), "kind").distinct().withColumn("in_catalog", F.lit(True))
    new = referenced.select(F.col("table").alias("id"), "kind").distinct().join(known, "id", "left_anti").groupBy("id").agg(F.min("kind").alias("kind")).withColumn("in_catalog", F.lit(False))
    columns = catalog.select(F.concat_ws(".", "table", "column").alias("id"), "type").withColumn("in_catalog", F.lit(True))
    more = used.select(F.col("col").alias("id")).distinct().join(columns, "id", "left_anti").select("id", F.lit(None).cast("string").alias("type"), F.lit(False).alias("in_catalog"))
    return known.unionByName(new), columns.unionByName(more)


def sandboxes(tables: DataFrame, written: DataFrame, run: DataFrame, load: DataFrame, service: Column) -> DataFrame:
    """(table, sandbox): whether people alone write a table, never a service (a condition on principal) by statement or load."""
    by = written.select("shape_id", "table").distinct().join(run.select("principal", "shape_id"), "shape_id").groupBy("table").agg(F.bool_or(service).alias("served"))
    services = load.filter(service).select("table").distinct().withColumn("loaded", F.lit(True))
    out = tables.select("table").distinct().join(by, "table", "left").join(services, "table", "left")
    return out.select("table", (F.col("served").isNotNull() & ~F.coalesce("served", F.lit(False)) & F.col("loaded").isNull()).alias("sandbox"))


def uncast(fns: Column) -> Column:
    """The functions but casts."""
    return F.filter(fns, lambda f: ~f.rlike(r"^(SAFE_)?CAST<"))


def joins_identity(wraps: Column, vias: Column) -> Column:
    """Whether a join compares keys as they are, in another form, or picked from a group."""
    lits = lambda x: F.array(*map(F.lit, x))
    return (F.size(F.array_except(uncast(wraps), lits(FORMAT_FNS + PICK_FNS))) == 0) & (F.size(F.array_except(vias, lits(IDENTITY_VIAS))) == 0)


def keeps_identity(kinds: Column, fns: Column, control: Column, type_: Column) -> Column:
    """Whether lineage passes a value through; a picked number is a new measure."""
    lits = lambda x: F.array(*map(F.lit, x))
    own, number = uncast(fns), F.coalesce(F.upper(type_).rlike("^(" + "|".join(NUMERIC) + ")"), F.lit(False))
    copied = F.size(F.array_except(kinds, lits(["passthrough", "rename"]))) == 0
    formed = (F.size(own) > 0) & (F.size(F.array_except(own, lits(FORMAT_FNS + PICK_FNS))) == 0) & ~(F.arrays_overlap(own, lits(PICK_FNS)) & number)
    return ~F.coalesce(control, F.lit(False)) & (copied | formed)


def join_keys(uses: DataFrame, run: DataFrame, service: Column) -> DataFrame:
    """(key, l, r, identity, production, services, people, uses): each join key with who makes it."""
    who = uses.select("shape_id", "key").distinct().join(run.select("principal", "shape_id"), "shape_id").withColumn("svc", service)
    by = who.groupBy("key").agg(F.count_distinct(F.when(F.col("svc"), F.col("principal"))).alias("services"), F.count_distinct(F.when(~F.col("svc"), F.col("principal"))).alias("people"))
    keys = uses.groupBy("key", "l", "r").agg(F.bool_or(joins_identity(F.col("wraps"), F.col("vias"))).alias("identity"), F.count_distinct("shape_id").alias("uses"))
    out = keys.join(by, "key", "left").na.fill(0, ["services", "people"])
    return out.select("key", "l", "r", "identity", (F.col("services") > 0).alias("production"), "services", "people", "uses")


class Spaces:
    """Id spaces: columns that accepted joins and lineage make one; a column that neither touches has those of its name."""

    def __init__(self, same: list[tuple[str, str]], accepted: list[dict]):
        self.root: dict[str, str] = {}
        for a, b in same + [(k["l"], k["r"]) for k in accepted if k["identity"]]:
            p, q = sorted((self.find(a), self.find(b)))
            self.root[q] = p
        self.known = {self.find(c) for k in accepted for c in (k["l"], k["r"])}
        self.named: dict[str, set[str]] = {}
        for c in list(self.root):
            if self.find(c) in self.known:
                self.named.setdefault(c.rsplit(".", 1)[-1].lower(), set()).add(self.find(c))

    def find(self, c: str) -> str:
        self.root.setdefault(c, c)
        while self.root[c] != c:
            self.root[c] = self.root[self.root[c]]
            c = self.root[c]
        return c

    def of(self, c: str) -> set[str]:
        r = self.find(c)
        return {r} if r in self.known else set(self.named.get(c.rsplit(".", 1)[-1].lower(), ()))

    def apart(self, k: dict, production: list[dict], columns: dict[str, list[str]]) -> list[str]:
        """The tables of production joins that hold both sides' spaces as separate columns, if the key joins two spaces."""
        left, right = self.of(k["l"]), self.of(k["r"])
        if not left or not right or left & right:
            return []
        tables = dict.fromkeys(c.rsplit(".", 1)[0] for p in production for c in (p["l"], p["r"]))
        return sorted(t for t in tables for a in left for b in right if {a, b} <= {self.find(c) for c in columns.get(t, ())})


def suspects(keys: list[dict], same: list[tuple[str, str]], columns: dict[str, list[str]]) -> dict[str, list[str]]:
    """{key: tables that keep its sides apart}: people's joins against production and the people's joins that still stand.

    At first production alone judges, and a join never vouches for itself; ends when nothing changes, or after PASSES.
    """
    production, human = [k for k in keys if k["production"]], [k for k in keys if not k["production"]]
    found: dict[str, list[str]] = {}
    for i in range(PASSES):
        accepted = production + [k for k in human if i and k["key"] not in found]
        new = {k["key"]: via for k in human if (via := Spaces(same, [x for x in accepted if x is not k]).apart(k, production, columns))}
        if i and new.keys() == found.keys():
            break
        found = new
    return found


def judged(keys: DataFrame, lineage: DataFrame, columns: DataFrame) -> DataFrame:
    """join_keys() with suspect and confidence: self, production, suspect, corroborated (two people or more) or single.

    lineage: flows(); columns: (id, type). Keys are what people wrote, not rows: up to KEYS of them are judged on the driver.
    """
    rows = [r.asDict() for r in keys.limit(KEYS + 1).collect()]
    if len(rows) > KEYS:
        raise ValueError(f"over {KEYS} join keys")
    typed = lineage.join(columns.select(F.col("id").alias("src"), "type"), "src", "left")
    same = [(r["src"], r["tgt"]) for r in typed.filter(keeps_identity(F.col("kinds"), F.col("fns"), F.col("control"), F.col("type"))).select("src", "tgt").collect()]
    tables = {c.rsplit(".", 1)[0] for k in rows for c in (k["l"], k["r"])}
    held: dict[str, list[str]] = {}
    for r in columns.select("id").dropna().collect() if tables else ():
        if (t := r["id"].rsplit(".", 1)[0]) in tables:
            held.setdefault(t, []).append(r["id"])
    found = suspects(rows, same, held)
    bad = keys.sparkSession.createDataFrame([(k, ",".join(v)) for k, v in sorted(found.items())], "key string, kept_apart_by string")
    out = keys.join(F.broadcast(bad), "key", "left")  # KEYS rows at most
    from loomgraph.operators.evidence import confidence

    return out.withColumn("confidence", confidence(F.col("l") == F.col("r"), F.col("production"), F.col("kept_apart_by").isNotNull(), F.col("people")))


def variables(keys: DataFrame, usable: tuple[str, ...] = ("self", "production", "corroborated")) -> DataFrame:
    """(id, col, tables): columns that trusted joins of identity make one thing, named by the least, and how many tables it is in."""
    good = keys.filter(F.col("identity") & F.col("confidence").isin(list(usable)))
    out = components(good, "l", "r").select(F.concat(F.lit("var:"), "component").alias("id"), F.col("node").alias("col"))
    table_ = F.regexp_replace("col", r"\.[^.]*$", "")
    return out.join(out.groupBy("id").agg(F.count_distinct(table_).alias("tables")), "id")


def unjoined(columns: DataFrame, of: DataFrame) -> DataFrame:
    """(id): columns of no variable."""
    return columns.select("id").join(of.select(F.col("col").alias("id")), "id", "left_anti")


def naming(of: DataFrame, uses: DataFrame, values: DataFrame, n: int) -> DataFrame:
    """(id, joins, values): of each variable the n join keys and filtered values of most use, as text; equal ones by name."""
    key = uses.select("key", "l", "uses").join(of, F.col("l") == F.col("col")).groupBy("id", "key").agg(F.max("uses").alias("n"))
    said = values.join(of, "col").groupBy("id", "value").agg(F.sum("jobs").alias("n"))

    def top(rows: DataFrame, what: str, name: str) -> DataFrame:
        kept = rows.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), what))).filter(F.col("r") <= n)
        return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(what).alias("t")))), lambda s: s["t"]), ", ").alias(name))

    return of.select("id").distinct().join(top(key, "key", "joins"), "id", "left").join(top(said, "value", "values"), "id", "left")


def evidence_sets(read: DataFrame, of: DataFrame) -> DataFrame:
    """(shape_id, unit): what statements read, columns by their variable; statements of one unit show nothing and are left out."""
    each = read.select("shape_id", "col").join(of.select("col", "id"), "col", "left").select("shape_id", F.coalesce("id", "col").alias("unit")).distinct()
    many = each.groupBy("shape_id").agg(F.count("*").alias("n")).filter("n > 1").select("shape_id")
    return each.join(many, "shape_id", "left_semi")


def unit_edges(sets: DataFrame, lineage: DataFrame, of: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(a, b, coread, flows), a < b: how many statements (of keep, if given) read both units, and how many derive one from the other."""
    from loomgraph.operators.graph import coread

    some = sets if keep is None else sets.join(keep, "shape_id", "left_semi")
    both = coread(some, "shape_id", "unit").select("a", "b", F.col("n").alias("coread"), F.lit(0).cast("long").alias("flows"))
    unit = lambda c, name: of.select(F.col("col").alias(c), F.col("id").alias(name))
    f = lineage.filter("not control").join(unit("src", "x"), "src", "left").join(unit("tgt", "y"), "tgt", "left")
    x, y = F.coalesce("x", "src"), F.coalesce("y", "tgt")
    links = f.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.lit(0).cast("long").alias("coread"), F.col("shapes").alias("flows")).filter("a <> b")
    return both.unionByName(links).groupBy("a", "b").agg(F.sum("coread").alias("coread"), F.sum("flows").alias("flows"))


def projected(edges: DataFrame, units: DataFrame, lineage: bool = True) -> DataFrame:
    """(a, b, w): edges between known units (id) by their weight, and (id, null, null) for units without one."""
    w = F.col("coread") + (F.col("flows") if lineage else F.lit(0))
    some = edges.select("a", "b", w.cast("double").alias("w")).filter("w > 0")
    some = some.join(units.select(F.col("id").alias("a")), "a", "left_semi").join(units.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "w")
    some = stored(some, "edges")
    alone = units.select("id").distinct().join(some.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_anti")
    return some.unionByName(alone.select(F.col("id").alias("a")), allowMissingColumns=True)
