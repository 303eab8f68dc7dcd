"""Queries over how a log was understood, samples, blended nearness and what conversations speak of; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.log_queries import RUN, seen
from loomgraph.operators import bottom as B
from loomgraph.operators import graph as G
from loomgraph.operators import health as H
from loomgraph.sources.tables import table


def a_homes(spark, d):
    o, e = table(spark, d, "orders"), table(spark, d, "events")
    word = F.concat_ws("_", (F.col("o_custkey") % 11).cast("string"), (F.col("o_custkey") % 40).cast("string"))
    refs = o.select(word.alias("dataset"), F.when(F.col("o_custkey") % 40 < 30, F.col("o_orderpriority")).alias("project"))
    return H.homes(refs, e.select(F.concat_ws("_", (F.col("user_id") % 11).cast("string"), F.lit("x")).alias("dataset"), F.col("event_type").alias("project")))


def b_health(spark, d):
    return H.report(seen(spark, d)["shapes"].filter("origin = 'log'"))


def b_strata(spark, d):
    o = table(spark, d, "orders")
    strata = {"late": F.col("o_orderdate") > "1998-06-01", "large": F.col("o_totalprice") > 300000, "pending": F.col("o_orderstatus") == "P"}
    return H.stratified(o, strata, "o_orderkey", 5, 20)


def e_blended(spark, d):
    e = table(spark, d, "embeddings")
    text = G.nearest(e, e.filter("vec_id % 50 = 0"), 20)
    usage = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 7).alias("b"), (F.col("vec_id") % 9 / 10).alias("cosine"))
    return H.blended_nearest(text, usage, 2, 4)


def e_held_together(spark, d):
    """Communities of what statements read, run again: what holds together."""
    s = seen(spark, d)
    sets = B.evidence_sets(B.reads(s["shapes"]), B.variables(s["keys"]))
    edges = lambda part: G.coread(part, "shape_id", "unit")
    groups = H.communities(edges(sets)).withColumnRenamed("node", "unit")
    return H.held_together(groups, H.reruns(sets, edges, 4, 0.8, 1.0)).withColumn("stability", F.round("stability", 6))


def j_relationships(spark, d):
    s = seen(spark, d)
    v = B.variables(s["keys"]).select(F.regexp_replace("col", r"\.[^.]*$", "").alias("table"), F.substring_index("col", ".", -1).alias("column"), F.col("id").alias("variable"))
    keys = v.filter("(table = 'w.sales.customer' and column = 'c_custkey') or (table = 'w.sales.nation' and column = 'n_nationkey')")
    return H.relationships(v, keys)


def l_offered(spark, d):
    e = table(spark, d, "embeddings")
    skills = e.select(F.col("vec_id").alias("skill"), "embedding", (F.col("vec_id") % 3 == 0).alias("retired"))
    return H.offered(skills, e.filter("vec_id % 100 = 1"), 3)


def n_also(spark, d):
    c = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    out = H.also(table(spark, d, "orders"), c, "o_custkey", "o_orderdate", F.lit("1995-01-01").cast("date"), F.lit("1996-12-31").cast("date"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 2)
    return out.select("o_custkey", "o_orderkey", "rank")


def n_pointed(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    key = lambda x: F.col(x).cast("string")
    nodes = c.select((F.col("c_custkey") % 10).alias("anchor"), F.lit("Customer").alias("label"), key("c_custkey").alias("key"), F.create_map(F.lit("segment"), "c_mktsegment").alias("props"))
    ends = c.select((F.col("c_custkey") % 10).alias("anchor"), "c_nationkey").distinct().join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("anchor", F.lit("Nation").alias("label"), F.concat(F.lit("n"), key("n_nationkey")).alias("key"), F.create_map(F.lit("name"), "n_name").alias("props"))
    edges = c.select((F.col("c_custkey") % 10).alias("anchor"), key("c_custkey").alias("start"), F.concat(F.lit("n"), key("c_nationkey")).alias("end"))
    out = H.pointed(nodes.union(ends), edges, "Customer", "Nation")
    return out.select("anchor", "key", F.try_element_at("props", F.lit("segment")).alias("segment"), F.try_element_at("props", F.lit("Nation.name")).alias("nation"))


def n_linked(spark, d):
    """Conversations made of orders: every customer names a price and a brand, and has the parts of their orders."""
    o, li, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    said = o.filter("o_orderkey % 20 = 0").select(F.col("o_custkey").alias("conversation"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("I paid $"), F.format_string("%.2f", F.col("o_totalprice") % 500), F.lit(" for order number "), F.col("o_orderkey").cast("string")).alias("text"))
    rows = o.select(F.col("o_custkey").alias("conversation"), F.col("o_orderkey").alias("key"), F.concat(F.lit("order number "), F.col("o_orderkey").cast("string")).alias("name"), F.lit(None).cast("double").alias("amount"), F.col("o_orderkey").alias("recent"))
    return H.linked(said, rows)


QUERIES = {f.__name__: f for f in (a_homes, b_health, b_strata, e_blended, e_held_together, j_relationships, l_offered, n_also, n_pointed, n_linked)}
UNIT = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)"
COS = "round(list_dot_product(q.e, n.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(n.e, n.e)), 6)"
SQL = {
    "a_homes": """
WITH r AS (SELECT (o_custkey % 11) || '_' || (o_custkey % 40) AS ds, CASE WHEN o_custkey % 40 < 30 THEN o_orderpriority END AS p FROM orders UNION ALL SELECT (user_id % 11) || '_x', event_type FROM events),
o AS (SELECT ds, p, count(*) AS n FROM r WHERE p IS NOT NULL AND ds IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ds ORDER BY count(*) DESC, p) = 1),
k AS (SELECT split_part(ds, '_', 1) AS w, p, sum(n) AS n FROM o GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY split_part(ds, '_', 1) ORDER BY sum(n) DESC, p) = 1)
SELECT ds AS dataset, p AS project, n::BIGINT AS votes FROM o UNION ALL SELECT d.ds, k.p, coalesce(k.n, 0)::BIGINT FROM (SELECT DISTINCT ds FROM r WHERE ds NOT IN (SELECT ds FROM o)) d LEFT JOIN k ON split_part(d.ds, '_', 1) = w""",
    "b_health": f"""WITH {RUN}
SELECT CASE s WHEN 2 THEN 'INSERT' WHEN 5 THEN 'CREATE_TABLE_AS_SELECT' ELSE 'SELECT' END AS statement_type, 'ok' AS status, count(*) AS shapes, sum(jobs)::BIGINT AS jobs, sum(errors)::BIGINT AS errors, 0::BIGINT AS unresolved FROM st GROUP BY 1
UNION ALL SELECT 'SELECT', 'partial', count(DISTINCT query), count(*), count(*) FILTER (error), 3 * count(DISTINCT query) FROM log WHERE k % 8 = 6 AND query IS NOT NULL""",
    "b_strata": """
WITH s AS (SELECT o_orderkey AS key, sha1(o_orderkey::VARCHAR) AS h, unnest(['large', 'late', 'pending']) AS stratum, unnest([o_totalprice > 300000, o_orderdate > '1998-06-01', o_orderstatus = 'P']) AS y FROM orders),
k AS (SELECT stratum, key, row_number() OVER (PARTITION BY stratum ORDER BY h, key) AS rank FROM s WHERE y QUALIFY rank <= 5),
r AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY sha1(o_orderkey::VARCHAR), o_orderkey) AS rank FROM orders WHERE o_orderkey NOT IN (SELECT key FROM k))
SELECT * FROM k UNION ALL SELECT 'rest', key, rank FROM r WHERE rank <= 20 - (SELECT count(DISTINCT key) FROM k)""",
    "e_blended": f"""WITH {UNIT},
t AS (SELECT q.vec_id AS a, n.vec_id AS b, {COS} AS score FROM v q JOIN v n ON q.vec_id <> n.vec_id WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, n.vec_id) <= 20),
u AS (SELECT vec_id AS a, vec_id + 7 AS b, vec_id % 9 / 10 AS c FROM embeddings WHERE vec_id % 50 = 0), w AS (SELECT * FROM u UNION ALL SELECT b, a, c FROM u),
s AS (SELECT a, b, round(0.5 * coalesce(c, 0) + 0.5 * coalesce(score, 0), 6) AS score FROM t FULL JOIN w USING (a, b))
SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rank FROM s QUALIFY rank <= 4""",
    "j_relationships": """SELECT * FROM (VALUES ('w.mart.spend', 'c_custkey', 'w.sales.customer'), ('w.sales.orders', 'o_custkey', 'w.sales.customer'), ('w.sales.customer', 'c_nationkey', 'w.sales.nation')) r("start", "column", "end")""",
    "l_offered": f"""WITH {UNIT}, s AS (SELECT q.vec_id AS query, n.vec_id AS near, {COS} AS score FROM v q JOIN v n ON q.vec_id <> n.vec_id WHERE q.vec_id % 100 = 1 AND n.vec_id % 3 <> 0)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, near) AS rank FROM s QUALIFY rank <= 3""",
    "n_also": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_orderdate::DATE BETWEEN '1995-01-01' AND '1996-12-31' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) QUALIFY rank <= 2",
    "n_pointed": "SELECT c_custkey % 10 AS anchor, c_custkey::VARCHAR AS key, c_mktsegment AS segment, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
    "n_linked": "SELECT o_custkey AS conversation, o_orderkey AS key, 'name' AS kind, 'order number ' || o_orderkey AS evidence, o_orderkey AS turn FROM orders WHERE o_orderkey % 20 = 0",
}
