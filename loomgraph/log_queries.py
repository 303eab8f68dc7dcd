"""Queries over a log of jobs, made of the orders, and over what its texts say; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import bottom as B
from loomgraph.operators import evidence as E
from loomgraph.plans import lineage as LN
from loomgraph.plans.sqltext import Names
from loomgraph.sources.shared import stored
from loomgraph.sources.tables import table

NAMES = Names({"old.sales_v1": "w.sales"}, [(r"_[0-9a-f]{12}$", "_{hex}")], {"w.web.day_"}, "w")
#: What jobs run; {a} is an order's priority, {n} a number below 100, {h} twelve hexadecimal digits.
TEXTS = [
    "SELECT c_name FROM sales.customer WHERE c_mktsegment = '{a}'",
    "select C_NAME\n from old.sales_v1.customer where c_mktsegment = '{a}' -- once more",
    "SELECT o.o_orderpriority, SUM(o.o_totalprice) AS total FROM sales.orders o JOIN sales.customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = {n} GROUP BY 1",
    "INSERT INTO mart.spend (c_custkey, total) SELECT o_custkey, SUM(o_totalprice) FROM sales.orders WHERE o_orderstatus IN ('F', '{a}') GROUP BY 1",
    "SELECT s.total FROM mart.spend s LEFT JOIN sales.customer c ON s.c_custkey = c.c_custkey",
    "SELECT n.n_name FROM sales.customer c, sales.nation n WHERE c.c_nationkey = n.n_nationkey",
    "SELECT lost FROM nowhere.gone_{h}x WHERE k = {n}",
    "CREATE OR REPLACE TABLE mart.top AS SELECT c_custkey, c_name AS name FROM sales.customer WHERE c_acctbal > {n}",
]
#: Their shapes, with literals as ?.
SHAPES = [
    "SELECT c_name FROM w.sales.customer WHERE c_mktsegment = ?",
    "SELECT o . o_orderpriority , sum ( o . o_totalprice ) AS total FROM w.sales.orders o JOIN w.sales.customer c ON o . o_custkey = c . c_custkey WHERE c . c_nationkey = ? GROUP BY ?",
    "insert INTO w.mart.spend ( c_custkey , total ) SELECT o_custkey , sum ( o_totalprice ) FROM w.sales.orders WHERE o_orderstatus IN ( ? , ? ) GROUP BY ?",
    "SELECT s . total FROM w.mart.spend s LEFT JOIN w.sales.customer c ON s . c_custkey = c . c_custkey",
    "SELECT n . n_name FROM w.sales.customer c , w.sales.nation n WHERE c . c_nationkey = n . n_nationkey",
    "create OR replace table w.mart.top AS SELECT c_custkey , c_name AS name FROM w.sales.customer WHERE c_acctbal > ?",
]
VIEW = "SELECT c_name FROM sales.customer WHERE c_mktsegment = 'VIEWED'"
COLUMNS = {
    "w.sales.customer": {"c_custkey": "INT64", "c_name": "STRING", "c_nationkey": "INT64", "c_mktsegment": "STRING", "c_acctbal": "NUMERIC"},
    "w.sales.orders": {"o_orderkey": "INT64", "o_custkey": "INT64", "o_orderstatus": "STRING", "o_totalprice": "NUMERIC", "o_orderdate": "DATE", "o_orderpriority": "STRING"},
    "w.sales.nation": {"n_nationkey": "INT64", "n_name": "STRING"},
    "w.mart.spend": {"c_custkey": "INT64", "total": "NUMERIC"},
}
CATALOG = LN.Tables({t: {"kind": "TABLE", "partition": "o_orderdate" if t.endswith("orders") else None, "columns": c} for t, c in COLUMNS.items()}, NAMES)
_read: dict[tuple, dict] = {}


def log(spark, d):
    """A job an order: every eighth runs the same text, every ninth is a load; customers run them, every eighth a service."""
    o = table(spark, d, "orders")
    k, text = F.col("o_orderkey"), None
    for i, t in enumerate(TEXTS):
        parts = F.lit(t)
        for mark, by in (("{a}", F.col("o_orderpriority")), ("{n}", (k % 100).cast("string")), ("{h}", F.substring(F.md5(k.cast("string").cast("binary")), 1, 12))):
            parts = F.replace(parts, F.lit(mark), by) if mark in t else parts
        text = F.when(k % 8 == i, parts) if text is None else text.when(k % 8 == i, parts)
    load = k % 9 == 0
    who = F.col("o_custkey") % 40
    return o.select(
        F.when(~load, text).alias("query"), F.when(load, "LOAD").otherwise("QUERY").alias("job_type"), F.concat(F.when(who % 8 == 0, "svc").otherwise("p"), who.cast("string")).alias("principal"),
        F.when(load, F.concat(F.lit("w.sales."), F.when(k % 2 == 0, "orders").otherwise("customer"))).alias("destination"), F.col("o_orderdate").alias("ts"),
        ((F.col("o_orderstatus") == "P") | (k % 8 == 6)).alias("error"), (k % 5 == 0).alias("cache_hit"), (F.col("o_custkey") % 1000).cast("long").alias("bytes"),
    )


def seen(spark, d) -> dict:
    """The log's groups, texts, shapes and join keys, read once an application and folder and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _read:
        grouped = stored(B.groups(log(spark, d)), "groups")
        views = spark.createDataFrame([(VIEW,)], "query string")
        texts = stored(B.shaped(B.texts(grouped), NAMES, views), "texts")
        shapes = stored(B.shapes(texts, grouped, CATALOG), "shapes")
        run = stored(B.ran(grouped, texts), "ran")
        columns = spark.createDataFrame([(f"{t}.{c}", k) for t, cs in COLUMNS.items() for c, k in cs.items()], "id string, type string")
        keys = stored(B.judged(B.join_keys(B.join_uses(shapes), run, service()), B.flows(shapes), columns), "keys")
        _read[key] = {"groups": grouped, "texts": texts, "shapes": shapes, "ran": run, "columns": columns, "keys": keys}
    return _read[key]


def service():
    return F.col("principal").startswith("svc")


def joined(c):
    return F.array_join(F.array_sort(c), ",")


def b_fingerprints(spark, d):
    return seen(spark, d)["texts"].filter("origin = 'log'").select("query", "shape_id", F.array_join(F.transform("literals", lambda x: F.array_join(x, "+")), "|").alias("literals"), "statements")


def b_shapes(spark, d):
    s = seen(spark, d)["shapes"]
    return s.select("shape_id", "origin", "record.statement_type", "record.status", "succeeded", "jobs", "errors", "cache_hits", "bytes_billed", "texts", "people", "first_seen", "last_seen", "record.output.aggregate_only", "record.output.grouped")


def c_refs(spark, d):
    return B.refs(seen(spark, d)["shapes"])


def c_reads(spark, d):
    r = B.reads(seen(spark, d)["shapes"])
    return r.select("shape_id", "col", joined(F.col("roles")).alias("roles"), joined(F.col("derived_roles")).alias("derived_roles"), joined(F.col("agg")).alias("agg"))


def c_filters(spark, d):
    return B.filters(seen(spark, d)["shapes"]).select("shape_id", "col", "op", "clause", F.size("slots").alias("n_slots"))


def c_filter_values(spark, d):
    s = seen(spark, d)
    return B.filter_values(B.filters(s["shapes"]), s["texts"].filter("origin = 'log'"), 5).select("shape_id", "value", "jobs", "rank")


def c_join_uses(spark, d):
    return B.join_uses(seen(spark, d)["shapes"]).select("shape_id", "key", "type")


def c_writes(spark, d):
    return B.writes(seen(spark, d)["shapes"]).select("shape_id", "table", "mode")


def c_lineage(spark, d):
    f = B.flows(seen(spark, d)["shapes"])
    return f.select("src", "tgt", joined(F.col("kinds")).alias("kinds"), joined(F.col("fns")).alias("fns"), "shapes", "jobs", "control")


def c_derived_from(spark, d):
    return B.derived_from(seen(spark, d)["shapes"]).withColumn("modes", joined(F.col("modes")))


def c_ran(spark, d):
    return seen(spark, d)["ran"]


def c_loaded(spark, d):
    return B.loaded(seen(spark, d)["groups"])


def c_write_days(spark, d):
    s = seen(spark, d)
    return B.write_days(s["groups"], s["texts"], B.writes(s["shapes"])).groupBy("table").agg(F.count("*").alias("n_days"), F.min("day").alias("first"), F.max("day").alias("last"))


def c_sandbox(spark, d):
    s = seen(spark, d)
    out = B.sandboxes(B.refs(s["shapes"]).select("table"), B.writes(s["shapes"]), s["ran"], B.loaded(s["groups"]), service())
    return out


def c_assets(spark, d):
    s = seen(spark, d)
    catalog = spark.createDataFrame([(t, "table", c, k) for t, cs in COLUMNS.items() for c, k in cs.items()], "table string, kind string, column string, type string")
    tables, columns = B.assets(catalog, B.refs(s["shapes"]), B.reads(s["shapes"]))
    return tables.select("id", "kind", "in_catalog").unionByName(columns.select("id", F.lit("column").alias("kind"), "in_catalog"))


def d_join_keys(spark, d):
    return seen(spark, d)["keys"].select("key", "identity", "production", "services", "people", "uses", "confidence")


def d_variables(spark, d):
    return B.variables(seen(spark, d)["keys"])


def d_unjoined(spark, d):
    s = seen(spark, d)
    return B.unjoined(s["columns"], B.variables(s["keys"]))


def d_naming(spark, d):
    s = seen(spark, d)
    values = B.filter_values(B.filters(s["shapes"]), s["texts"].filter("origin = 'log'"), 3)
    cols = values.join(B.filters(s["shapes"]).select("shape_id", "i", "col"), ["shape_id", "i"])
    return B.naming(B.variables(s["keys"]), s["keys"], cols, 2)


def e_evidence_sets(spark, d):
    s = seen(spark, d)
    return B.evidence_sets(B.reads(s["shapes"]), B.variables(s["keys"]))


def e_unit_edges(spark, d):
    s = seen(spark, d)
    of = B.variables(s["keys"])
    return B.unit_edges(B.evidence_sets(B.reads(s["shapes"]), of), B.flows(s["shapes"]), of)


def e_projection(spark, d):
    s = seen(spark, d)
    of = B.variables(s["keys"])
    edges = B.unit_edges(B.evidence_sets(B.reads(s["shapes"]), of), B.flows(s["shapes"]), of)
    units = of.select("id").distinct().union(B.unjoined(s["columns"], of))
    return B.projected(edges, units)


def f_extracted(spark, d):
    """The measures and derived dimensions of the log's shapes, with how many have them."""
    s = seen(spark, d)
    c = LN.computed(B.representatives(s["texts"]), "query", CATALOG).filter("kind <> 'population'")
    return c.groupBy("kind", "expression", F.array_join("grain", ",").alias("grain")).agg(F.count_distinct("shape_id").alias("shapes"))


def a_groups(spark, d):
    g = B.groups(log(spark, d))
    days = F.array_join(F.transform("days", lambda x: x.cast("string")), ",").alias("days")
    return g.select(F.coalesce("query", F.lit("")).alias("query"), "job_type", "principal", "week", "destination", "jobs", "errors", "cache_hits", "bytes_billed", "first_seen", "last_seen", days)


def a_text_sample(spark, d):
    return E.hash_sample(seen(spark, d)["texts"].filter("origin = 'log'"), "query", 0.5).select("text_id", "jobs", "errors")


QUERIES = {
    f.__name__: f
    for f in (
        a_groups, a_text_sample, b_fingerprints, b_shapes, c_refs, c_reads, c_filters, c_filter_values, c_join_uses, c_writes, c_lineage, c_derived_from, c_ran, c_loaded, c_write_days, c_sandbox,
        c_assets, d_join_keys, d_variables, d_unjoined, d_naming, e_evidence_sets, e_unit_edges, e_projection, f_extracted,
    )
}


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def filled(t: str) -> str:
    out = quote(t)
    for mark, by in (("{a}", "o_orderpriority"), ("{n}", "(o_orderkey % 100)::VARCHAR"), ("{h}", "substr(md5(o_orderkey::VARCHAR), 1, 12)")):
        out = f"replace({out}, '{mark}', {by})" if mark in t else out
    return out


def rows(*lines: tuple) -> str:
    """VALUES of lines; None is NULL."""
    one = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, bool)) else quote(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, x)) + ")" for x in lines) + ")"


#: Which shape a text has, by its place; the seventh is of no known table and its shape counts by its name's end.
OF = [0, 0, 1, 2, 3, 4, None, 5]
LOG = f"""
log AS (SELECT CASE WHEN o_orderkey % 9 <> 0 THEN CASE o_orderkey % 8 {" ".join(f"WHEN {i} THEN {filled(t)}" for i, t in enumerate(TEXTS))} END END AS query,
  CASE WHEN o_orderkey % 9 = 0 THEN 'LOAD' ELSE 'QUERY' END AS job_type, CASE WHEN o_custkey % 8 = 0 THEN 'svc' ELSE 'p' END || (o_custkey % 40) AS principal,
  CASE WHEN o_orderkey % 9 = 0 THEN 'w.sales.' || CASE WHEN o_orderkey % 2 = 0 THEN 'orders' ELSE 'customer' END END AS destination, o_orderdate AS ts,
  o_orderstatus = 'P' OR o_orderkey % 8 = 6 AS error, o_orderkey % 5 = 0 AS cache_hit, (o_custkey % 1000)::BIGINT AS bytes, o_orderkey AS k, o_orderpriority AS a FROM orders),
g AS (SELECT query, job_type, principal, date_trunc('week', ts)::DATE AS week, destination, any_value(k % 8) AS t, count(*) AS jobs, count(*) FILTER (error) AS errors, count(*) FILTER (cache_hit) AS cache_hits, sum(bytes)::BIGINT AS bytes_billed,
  min(ts) AS first_seen, max(ts) AS last_seen, list_sort(list(DISTINCT ts::DATE)) AS days FROM log GROUP BY 1, 2, 3, 4, 5)"""
BY_TEXT = "CASE t " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(OF) if s is not None) + " END"
SHAPE = "CASE s " + " ".join(f"WHEN {i} THEN sha256({quote(s)})" for i, s in enumerate(SHAPES)) + " END"
#: How many texts of a shape ran, and how; s is the shape's place.
RUN = f"""{LOG},
q AS (SELECT *, {BY_TEXT} AS s FROM g WHERE query IS NOT NULL),
st AS (SELECT s, sum(jobs)::BIGINT AS jobs, sum(errors)::BIGINT AS errors, sum(cache_hits)::BIGINT AS cache_hits, sum(bytes_billed)::BIGINT AS bytes_billed, count(DISTINCT query) AS texts, count(DISTINCT principal) AS people, min(first_seen) AS first_seen, max(last_seen) AS last_seen FROM q WHERE s IS NOT NULL GROUP BY 1)"""
GONE = "sha256('SELECT lost FROM w.nowhere.gone_' || substr(md5(k::VARCHAR), 1, 12) || 'x WHERE k = ?')"
READS = rows(
    (0, "w.sales.customer.c_name", "project", ""), (0, "w.sales.customer.c_mktsegment", "filter", ""), (1, "w.sales.orders.o_orderpriority", "group,project", ""), (1, "w.sales.orders.o_totalprice", "project", "SUM"),
    (1, "w.sales.orders.o_custkey", "join", ""), (1, "w.sales.customer.c_custkey", "join", ""), (1, "w.sales.customer.c_nationkey", "filter", ""), (2, "w.sales.orders.o_custkey", "group,project", ""),
    (2, "w.sales.orders.o_totalprice", "project", "SUM"), (2, "w.sales.orders.o_orderstatus", "filter", ""), (3, "w.mart.spend.total", "project", ""), (3, "w.mart.spend.c_custkey", "join", ""), (3, "w.sales.customer.c_custkey", "join", ""),
    (4, "w.sales.nation.n_name", "project", ""), (4, "w.sales.customer.c_nationkey", "filter", ""), (4, "w.sales.nation.n_nationkey", "filter", ""), (5, "w.sales.customer.c_custkey", "project", ""), (5, "w.sales.customer.c_name", "project", ""),
    (5, "w.sales.customer.c_acctbal", "filter", ""),
)
REFS = rows(
    (0, "w.sales.customer", "table", None), (1, "w.sales.orders", "table", "none"), (1, "w.sales.customer", "table", None), (2, "w.sales.orders", "table", "none"), (3, "w.mart.spend", "table", None), (3, "w.sales.customer", "table", None),
    (4, "w.sales.customer", "table", None), (4, "w.sales.nation", "table", None), (5, "w.sales.customer", "table", None),
)
KEYS = ["w.sales.customer.c_custkey=w.sales.orders.o_custkey", "w.mart.spend.c_custkey=w.sales.customer.c_custkey", "w.sales.customer.c_nationkey=w.sales.nation.n_nationkey"]
USES = rows((1, KEYS[0], "INNER"), (3, KEYS[1], "LEFT"), (4, KEYS[2], "WHERE"))
V_CUST, V_NATION = "var:w.mart.spend.c_custkey", "var:w.sales.customer.c_nationkey"
OF_VARIABLE = rows((V_CUST, "w.mart.spend.c_custkey"), (V_CUST, "w.sales.customer.c_custkey"), (V_CUST, "w.sales.orders.o_custkey"), (V_NATION, "w.sales.customer.c_nationkey"), (V_NATION, "w.sales.nation.n_nationkey"))
VALUED = "SELECT s, 'w.sales.customer.c_mktsegment' AS col, v, n FROM (SELECT 0 AS s, a AS v, count(*) FILTER (NOT error) AS n FROM log WHERE k % 8 IN (0, 1) AND query IS NOT NULL GROUP BY ALL)"
FLOWS = rows(
    ("w.sales.orders.o_custkey", "w.mart.spend.c_custkey", "passthrough", "", 2), ("w.sales.orders.o_totalprice", "w.mart.spend.total", "aggregate", "SUM", 2), ("w.sales.customer.c_custkey", "w.mart.top.c_custkey", "passthrough", "", 5),
    ("w.sales.customer.c_name", "w.mart.top.name", "rename", "", 5),
)
CATALOG_ROWS = rows(*[(t, c) for t, cs in COLUMNS.items() for c in cs])
UNITS = f"u AS (SELECT DISTINCT s, coalesce(id, col) AS unit FROM {READS} r(s, col, x, y) LEFT JOIN {OF_VARIABLE} o(id, c) ON c = col), m AS (SELECT * FROM u WHERE s IN (SELECT s FROM u GROUP BY 1 HAVING count(*) > 1))"
EDGES = f"""{UNITS},
f AS (SELECT coalesce(x.id, src) AS a, coalesce(y.id, tgt) AS b FROM {FLOWS} f(src, tgt, k, fn, s) LEFT JOIN {OF_VARIABLE} x(id, c) ON x.c = src LEFT JOIN {OF_VARIABLE} y(id, c) ON y.c = tgt),
e AS (SELECT a, b, sum(c)::BIGINT AS coread, sum(f)::BIGINT AS flows FROM (SELECT p.unit AS a, q.unit AS b, 1 AS c, 0 AS f FROM m p JOIN m q ON p.s = q.s AND p.unit < q.unit UNION ALL SELECT least(a, b), greatest(a, b), 0, 1 FROM f WHERE a <> b) GROUP BY 1, 2)"""
SQL = {
    "a_groups": f"WITH {LOG} SELECT coalesce(query, '') AS query, job_type, principal, week, destination, jobs, errors, cache_hits, bytes_billed, first_seen, last_seen, array_to_string(list_transform(days, lambda x: x::VARCHAR), ',') AS days FROM g",
    "a_text_sample": f"WITH {LOG} SELECT sha1(query) AS text_id, sum(jobs)::BIGINT AS jobs, sum(errors)::BIGINT AS errors FROM g WHERE query IS NOT NULL AND ('0x' || sha1(query)[1:8])::BIGINT / 4294967296 < 0.5 GROUP BY 1",
    "b_fingerprints": f"""WITH {RUN} SELECT DISTINCT query, CASE WHEN t = 6 THEN {GONE} ELSE {SHAPE} END AS shape_id,
  CASE t WHEN 0 THEN a WHEN 1 THEN a WHEN 2 THEN (k % 100) || '|1' WHEN 3 THEN 'F|' || a || '|1' WHEN 6 THEN (k % 100)::VARCHAR WHEN 7 THEN (k % 100)::VARCHAR ELSE '' END AS literals, 1 AS statements
FROM (SELECT *, k % 8 AS t, {BY_TEXT.replace("CASE t", "CASE k % 8")} AS s FROM log WHERE query IS NOT NULL)""",
    "b_shapes": f"""WITH {RUN},
x AS (SELECT {SHAPE} AS shape_id, 'log' AS origin, CASE s WHEN 2 THEN 'INSERT' WHEN 5 THEN 'CREATE_TABLE_AS_SELECT' ELSE 'SELECT' END AS statement_type, 'ok' AS status, jobs > errors AS succeeded, jobs, errors, cache_hits, bytes_billed, texts, people, first_seen, last_seen,
  CASE WHEN s NOT IN (2, 5) THEN false END AS aggregate_only, CASE WHEN s NOT IN (2, 5) THEN s = 1 END AS grouped FROM st),
y AS (SELECT {GONE.replace("k::", "k_::").replace("k = ?", "k = ?")} AS shape_id, * FROM (SELECT any_value(k) AS k_, 'log', 'SELECT', 'partial', false, count(*), count(*), count(*) FILTER (cache_hit), sum(bytes)::BIGINT, count(DISTINCT query), count(DISTINCT principal), min(ts), max(ts), false, false FROM log WHERE k % 8 = 6 AND query IS NOT NULL GROUP BY md5(k::VARCHAR)))
SELECT * FROM x UNION ALL SELECT * EXCLUDE k_ FROM y""",
    "c_refs": f"WITH {RUN} SELECT {SHAPE} AS shape_id, t AS \"table\", kind, p AS partition_filter FROM {REFS} r(s, t, kind, p) JOIN st USING (s)",
    "c_reads": f"WITH {RUN} SELECT {SHAPE} AS shape_id, col, roles, '' AS derived_roles, agg FROM {READS} r(s, col, roles, agg) JOIN st USING (s)",
    "c_filters": f"""WITH {RUN} SELECT {SHAPE} AS shape_id, col, op, 'where' AS clause, n_slots
FROM {rows((0, "w.sales.customer.c_mktsegment", "=", 1), (1, "w.sales.customer.c_nationkey", "=", 1), (2, "w.sales.orders.o_orderstatus", "IN", 2), (5, "w.sales.customer.c_acctbal", ">", 1))} f(s, col, op, n_slots) JOIN st USING (s)""",
    "c_filter_values": f"""WITH {RUN},
w AS (SELECT 0 AS s, a AS value, sum(o) AS jobs FROM (SELECT query, any_value(a) AS a, count(*) FILTER (NOT error) AS o FROM log WHERE k % 8 IN (0, 1) GROUP BY 1) WHERE query IS NOT NULL AND o > 0 GROUP BY 2
  UNION ALL SELECT CASE k8 WHEN 2 THEN 1 ELSE 5 END, n::VARCHAR, o FROM (SELECT k % 8 AS k8, k % 100 AS n, count(*) FILTER (NOT error) AS o FROM log WHERE k % 8 IN (2, 7) AND query IS NOT NULL GROUP BY 1, 2) WHERE o > 0
  UNION ALL SELECT 2, a, o FROM (SELECT a, count(*) FILTER (NOT error) AS o FROM log WHERE k % 8 = 3 AND query IS NOT NULL GROUP BY 1) WHERE o > 0
  UNION ALL SELECT 2, 'F', count(*) FILTER (NOT error) FROM log WHERE k % 8 = 3 AND query IS NOT NULL)
SELECT {SHAPE} AS shape_id, value, jobs::BIGINT AS jobs, row_number() OVER (PARTITION BY s ORDER BY jobs DESC, value) AS rank FROM w QUALIFY rank <= 5""",
    "c_join_uses": f"WITH {RUN} SELECT {SHAPE} AS shape_id, key, type FROM {USES} u(s, key, type) JOIN st USING (s)",
    "c_writes": f"WITH {RUN} SELECT {SHAPE} AS shape_id, t AS \"table\", mode FROM {rows((2, 'w.mart.spend', 'INSERT'), (5, 'w.mart.top', 'CTAS'))} w(s, t, mode) JOIN st USING (s)",
    "c_lineage": f"WITH {RUN} SELECT src, tgt, kinds, fns, 1 AS shapes, jobs, false AS control FROM {FLOWS} f(src, tgt, kinds, fns, s) JOIN st USING (s)",
    "c_derived_from": f"WITH {RUN} SELECT tgt, src, modes, 1 AS shapes, jobs FROM {rows((2, 'w.mart.spend', 'w.sales.orders', 'INSERT'), (5, 'w.mart.top', 'w.sales.customer', 'CTAS'))} d(s, tgt, src, modes) JOIN st USING (s)",
    "c_ran": f"""WITH {RUN},
r AS (SELECT principal, CASE WHEN t = 6 THEN sha256('SELECT lost FROM w.nowhere.' || regexp_extract(query, 'gone_[0-9a-f]+x') || ' WHERE k = ?') ELSE {SHAPE} END AS shape_id, * EXCLUDE (principal) FROM q)
SELECT principal, shape_id, sum(jobs)::BIGINT AS jobs, sum(errors)::BIGINT AS errors, sum(cache_hits)::BIGINT AS cache_hits, sum(bytes_billed)::BIGINT AS bytes_billed, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
  (SELECT count(DISTINCT d) FROM (SELECT unnest(days) AS d, principal AS p, shape_id AS h FROM r z WHERE z.jobs > z.errors) WHERE p = r.principal AND h = r.shape_id) AS n_days FROM r GROUP BY 1, 2""",
    "c_loaded": f"""WITH {LOG} SELECT principal, destination AS "table", count(*) AS jobs, count(*) FILTER (error) AS errors, count(DISTINCT ts::DATE) AS n_days FROM log WHERE job_type = 'LOAD' GROUP BY 1, 2""",
    "c_write_days": f"""WITH {RUN},
w AS (SELECT destination AS t, unnest(days) AS day FROM g WHERE job_type = 'LOAD' UNION SELECT CASE s WHEN 2 THEN 'w.mart.spend' ELSE 'w.mart.top' END, unnest(days) FROM q WHERE s IN (2, 5) AND jobs > errors)
SELECT t AS "table", count(*) AS n_days, min(day) AS first, max(day) AS last FROM w GROUP BY 1""",
    "c_sandbox": f"""WITH {RUN},
w AS (SELECT CASE s WHEN 2 THEN 'w.mart.spend' ELSE 'w.mart.top' END AS t, bool_or(principal LIKE 'svc%') AS svc FROM q WHERE s IN (2, 5) GROUP BY 1),
l AS (SELECT DISTINCT destination FROM log WHERE job_type = 'LOAD' AND principal LIKE 'svc%')
SELECT DISTINCT r.t AS "table", w.svc IS NOT NULL AND NOT w.svc AND r.t NOT IN (SELECT destination FROM l) AS sandbox FROM {REFS} r(s, t, k, p) LEFT JOIN w USING (t)""",
    "c_assets": f"""SELECT DISTINCT t AS id, 'table' AS kind, true AS in_catalog FROM {CATALOG_ROWS} c(t, c) UNION ALL SELECT t || '.' || c, 'column', true FROM {CATALOG_ROWS} c(t, c)""",
    "d_join_keys": f"""WITH {RUN},
p AS (SELECT s, count(DISTINCT principal) FILTER (principal LIKE 'svc%') AS services, count(DISTINCT principal) FILTER (principal NOT LIKE 'svc%') AS people FROM q GROUP BY 1)
SELECT key, true AS identity, services > 0 AS production, services, people, 1 AS uses, CASE WHEN services > 0 THEN 'production' WHEN people >= 2 THEN 'corroborated' ELSE 'single' END AS confidence FROM {USES} u(s, key, type) JOIN p USING (s)""",
    "d_variables": f"SELECT id, col, count(*) OVER (PARTITION BY id) AS tables FROM {OF_VARIABLE} v(id, col)",
    "d_unjoined": f"SELECT t || '.' || c AS id FROM {CATALOG_ROWS} c(t, c) WHERE t || '.' || c NOT IN (SELECT col FROM {OF_VARIABLE} v(id, col))",
    "e_evidence_sets": f"WITH {UNITS} SELECT {SHAPE} AS shape_id, unit FROM m",
    "e_unit_edges": f"WITH {EDGES} SELECT * FROM e",
    "e_projection": f"""WITH {EDGES},
n AS (SELECT DISTINCT id FROM {OF_VARIABLE} v(id, col) UNION SELECT t || '.' || c FROM {CATALOG_ROWS} c(t, c) WHERE t || '.' || c NOT IN (SELECT col FROM {OF_VARIABLE} v(id, col))),
k AS (SELECT a, b, (coread + flows)::DOUBLE AS w FROM e WHERE a IN (SELECT id FROM n) AND b IN (SELECT id FROM n))
SELECT a, b, w FROM k UNION ALL SELECT id, NULL, NULL FROM n WHERE id NOT IN (SELECT a FROM k) AND id NOT IN (SELECT b FROM k)""",
    "f_extracted": f"SELECT * FROM {rows(('measure', 'SUM(orders.o_totalprice)', 'orders.o_orderpriority', 1), ('measure', 'SUM(orders.o_totalprice)', 'orders.o_custkey', 1))} f(kind, expression, grain, shapes)",
    "d_naming": f"""WITH {RUN},
v AS (SELECT n::VARCHAR AS v FROM (SELECT k % 100 AS n, count(*) FILTER (NOT error) AS o FROM log WHERE k % 8 = 2 AND query IS NOT NULL GROUP BY 1) WHERE o > 0 ORDER BY o DESC, n::VARCHAR LIMIT 2)
SELECT '{V_CUST}' AS id, '{KEYS[1]}, {KEYS[0]}' AS joins, NULL AS "values" UNION ALL SELECT '{V_NATION}', '{KEYS[2]}', (SELECT string_agg(v, ', ') FROM v)""",
}
