"""Queries over entity contexts, what holds of them, and a graph model of the tables; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import contexts as K
from loomgraph.operators import graph as G
from loomgraph.sources.tables import table

MODEL = K.Model(
    (K.Kind("Customer", "customer", "c_custkey"), K.Kind("Order", "orders", "o_orderkey", "o_orderdate"), K.Kind("Nation", "nation", "n_nationkey"), K.Kind("Region", "region", "r_regionkey"), K.Kind("Supplier", "supplier", "s_suppkey")),
    (K.Link("PLACED_BY", "Order", "o_custkey", "Customer"), K.Link("LIVES_IN", "Customer", "c_nationkey", "Nation"), K.Link("PART_OF", "Nation", "n_regionkey", "Region"), K.Link("BASED_IN", "Supplier", "s_nationkey", "Nation")),
)
DAY = "1997-06-30"


def around(spark, d):
    keys = table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    since = F.lit("1995-07-01").cast("date")
    return K.contexts(MODEL, lambda t: table(spark, d, t), "Customer", keys, K.template(MODEL, "Customer", 2), 3, since, F.lit(DAY).cast("date"))


def k_context_nodes(spark, d):
    return around(spark, d).nodes


def k_context_edges(spark, d):
    return around(spark, d).edges


def k_context_reads(spark, d):
    return around(spark, d).reads


def k_holds_until(spark, d):
    """How long what is known of a customer holds, by the days between orders; none ordered lately are frozen."""
    o = table(spark, d, "orders")
    n = K.cadence(o, "o_custkey", "o_orderdate").join(o.groupBy("o_custkey").agg((F.max(F.to_date("o_orderdate")) < F.lit("1996-01-01").cast("date")).alias("frozen")), "o_custkey")
    return n.select("o_custkey", "cadence", "frozen", K.holds_until(n, F.lit(DAY).cast("date"), 30).alias("until"))


def steps(spark, d):
    """Orders as stored reads: a clerk reads a customer on the order's day, for as many days as the order's key says."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return o.select(
        (F.col("o_orderkey") % 3).alias("reader"), F.col("o_custkey").alias("anchor"), (F.col("o_orderkey") % 2).alias("template"), F.col("o_orderkey").alias("step"), F.col("day").alias("fetched"),
        F.when(F.col("o_orderkey") % 10 != 0, F.date_add("day", (F.col("o_orderkey") % 400).cast("int"))).alias("until"), F.lit(False).alias("capped"),
    )


def k_fresh(spark, d):
    return K.fresh(steps(spark, d), F.lit(DAY).cast("date"))


def k_guarded(spark, d):
    s = steps(spark, d).select("reader", F.concat(F.lit("t"), F.col("step") % 4).alias("table"), "until", (F.col("step") % 5).alias("read_by"), "step")
    some = spark.createDataFrame([(r, f"t{t}") for r in range(3) for t in range(4) if (r + t) % 3], "reader int, table string")
    return K.guarded(s, some, spark.createDataFrame([("t2",)], "table string"), F.lit(DAY).cast("date")).select("reader", "table", "step")


def k_swept(spark, d):
    kept, counts = K.swept(table(spark, d, "events"), "event_type", "ts", {"click": 20, "view": 5}, F.lit("2024-02-01").cast("date"))
    return counts.join(kept.groupBy("event_type").agg(F.count("*").alias("n_kept")), "event_type", "left")


def k_current_facts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("value"), F.to_date("o_orderdate").alias("valid_from"), "o_orderkey")
    facts = K.superseded(o.withColumn("fix", F.col("o_orderkey") % 4 == 0).withColumn("at", F.struct("valid_from", "o_orderkey")), ["subject"], "at", "at", "fix")
    return K.current_facts(facts.select("subject", "value", "valid_from", F.col("valid_until.valid_from").alias("valid_until"), "o_orderkey"), F.lit(DAY).cast("date")).select("subject", "o_orderkey", "value")


def l_corrected_facts(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 4 == 0).alias("fix"))
    out = K.superseded(o, ["o_custkey"], "o_orderkey", "o_orderkey", "fix")
    return out.select("o_custkey", "o_orderkey", "valid_until", "how")


def l_chains(spark, d):
    return K.chained(table(spark, d, "orders").withColumn("conv", F.col("o_custkey")), "conv", ["o_orderdate", "o_orderkey"], "o_orderkey")


def k_found(spark, d):
    c = table(spark, d, "customer")
    wanted = c.select(F.col("c_name").alias("value")).union(c.select("c_mktsegment"))
    return K.find(c.select("c_custkey", "c_name"), wanted, "c_name", "c_custkey").unionByName(K.find(c, wanted, "c_mktsegment", "c_custkey"))


def j_scope(spark, d):
    """Parts that suppliers of the nations that services come from deliver."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    return li.join(s.filter("s_nationkey % 5 = 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select(F.col("l_partkey").alias("part")).distinct()


def j_two_hops(spark, d):
    """For each nation, how many other nations its customers share a supplier with, through orders."""
    li, o, c = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "customer")
    met = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("l_suppkey", F.col("c_nationkey").alias("a")).distinct()
    both = met.join(met.withColumnRenamed("a", "b"), "l_suppkey").filter("a <> b")  # at most one row a nation and supplier
    return both.groupBy("a").agg(F.count_distinct("b").alias("others"), F.count_distinct("l_suppkey").alias("suppliers"))


def j_without(spark, d):
    """Customers without a pending order, and how many suppliers live in their nation: an optional match and a missing one."""
    c, o, s = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "supplier")
    near = s.groupBy(F.col("s_nationkey").alias("n")).agg(F.count("*").alias("suppliers"))
    return c.join(o.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").join(near, F.col("c_nationkey") == F.col("n"), "left").select("c_custkey", F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def j_paths(spark, d):
    """How far every customer is from a region over the model's links, by the fewest."""
    edge = lambda t, a, ka, b, kb: table(spark, d, t).select(F.concat(F.lit(a), F.col(ka).cast("string")).alias("a"), F.concat(F.lit(b), F.col(kb).cast("string")).alias("b"))
    edges = edge("customer", "c", "c_custkey", "n", "c_nationkey").union(edge("nation", "n", "n_nationkey", "r", "n_regionkey"))
    starts = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("start"))
    return G.reach(edges, starts, 2).filter("hops = 2").select("start", "node", "hops")


QUERIES = {
    f.__name__: f
    for f in (k_context_nodes, k_context_edges, k_context_reads, k_holds_until, k_fresh, k_guarded, k_swept, k_current_facts, l_corrected_facts, l_chains, k_found, j_scope, j_two_hops, j_without, j_paths)
}
AROUND = f"""
o AS (SELECT o_custkey::VARCHAR AS anchor, o_orderkey::VARCHAR AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey::VARCHAR) AS r FROM orders
  WHERE o_orderdate::DATE BETWEEN '1995-07-01' AND '{DAY}' AND o_custkey IN (SELECT c_custkey FROM customer)),
c AS (SELECT c_custkey::VARCHAR AS anchor, n_nationkey::VARCHAR AS n, r_regionkey::VARCHAR AS g FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
STEPS = "s AS (SELECT o_orderkey % 3 AS reader, o_custkey AS anchor, o_orderkey % 2 AS template, o_orderkey AS step, o_orderdate::DATE AS fetched, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate::DATE + (o_orderkey % 400)::INT END AS until FROM orders)"
SQL = {
    "k_context_nodes": f"""WITH {AROUND} SELECT c_custkey::VARCHAR AS anchor, 'Customer' AS label, c_custkey::VARCHAR AS key, 0 AS hop FROM customer UNION ALL SELECT anchor, 'Order', s, 1 FROM o WHERE r <= 3 UNION ALL SELECT anchor, 'Nation', n, 1 FROM c UNION ALL SELECT anchor, 'Region', g, 2 FROM c""",
    "k_context_edges": f"WITH {AROUND} SELECT anchor, 'PLACED_BY' AS link, s AS start, anchor AS \"end\" FROM o WHERE r <= 3 UNION ALL SELECT anchor, 'LIVES_IN', anchor, n FROM c UNION ALL SELECT DISTINCT anchor, 'PART_OF', n, g FROM c",
    "k_context_reads": f"WITH {AROUND} SELECT anchor, 'PLACED_BY' AS link, least(max(r), 3)::BIGINT AS n, max(r) > 3 AS capped FROM o GROUP BY 1 UNION ALL SELECT anchor, 'LIVES_IN', 1, false FROM c UNION ALL SELECT anchor, 'PART_OF', 1, false FROM c",
    "k_holds_until": f"""
WITH d AS (SELECT DISTINCT o_custkey, o_orderdate::DATE AS d FROM orders), g AS (SELECT o_custkey, d, d - lag(d) OVER (PARTITION BY o_custkey ORDER BY d) AS gap FROM d),
c AS (SELECT o_custkey, quantile_cont(gap, 0.5)::DOUBLE AS cadence, max(d) < DATE '1996-01-01' AS frozen FROM g GROUP BY 1)
SELECT o_custkey, cadence, frozen, CASE WHEN NOT frozen THEN DATE '{DAY}' + coalesce(ceil(cadence)::INT, 30) END AS until FROM c""",
    "k_fresh": f"WITH {STEPS} SELECT reader, anchor, template, max_by(step, (fetched, step)) AS step, max(fetched) AS fetched FROM s WHERE (until IS NULL OR until >= '{DAY}') AND fetched <= '{DAY}' GROUP BY 1, 2, 3",
    "k_guarded": f"""WITH {STEPS} SELECT reader, 't' || (step % 4) AS "table", step FROM s WHERE (reader + step % 4) % 3 <> 0 AND (until IS NULL OR until >= '{DAY}') AND (step % 4 <> 2 OR step % 5 = reader)""",
    "k_swept": """
WITH e AS (SELECT event_type, date_diff('day', ts::DATE, DATE '2024-02-01') > CASE event_type WHEN 'click' THEN 20 WHEN 'view' THEN 5 END AS gone FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (gone) AS n_gone, nullif(count(*) - count(*) FILTER (gone), 0) AS n_kept FROM e GROUP BY 1""",
    "k_current_facts": f"""
WITH f AS (SELECT o_custkey AS subject, o_orderkey, o_orderpriority AS value, o_orderdate::DATE AS a, lead(o_orderdate::DATE) OVER w AS b, lead(o_orderkey % 4 = 0) OVER w AS fix FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, o_orderkey))
SELECT subject, o_orderkey, value FROM f WHERE a <= '{DAY}' AND (b IS NULL OR (NOT fix AND b > '{DAY}') OR (fix AND a > '{DAY}'))""",
    "l_corrected_facts": """
WITH f AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER w AS b, lead(o_orderkey % 4 = 0) OVER w AS fix FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, o_orderkey, CASE WHEN fix THEN o_orderkey ELSE b END AS valid_until, CASE WHEN b IS NOT NULL THEN CASE WHEN fix THEN 'corrected' ELSE 'changed' END END AS how FROM f""",
    "l_chains": "SELECT o_custkey AS conv, row_number() OVER w AS seq, o_orderkey, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
    "k_found": """
WITH v AS (SELECT c_name AS value, c_custkey AS k FROM customer UNION ALL SELECT c_mktsegment, c_custkey FROM customer WHERE c_mktsegment IS NOT NULL)
SELECT value, CASE WHEN count(*) = 1 THEN min(k::VARCHAR) END AS key, count(*) AS n FROM v GROUP BY 1""",
    "j_scope": "SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 5 = 0)",
    "j_two_hops": """
WITH m AS (SELECT DISTINCT l_suppkey, c_nationkey AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT x.a, count(DISTINCT y.a) AS others, count(DISTINCT l_suppkey) AS suppliers FROM m x JOIN m y USING (l_suppkey) WHERE x.a <> y.a GROUP BY 1""",
    "j_without": "SELECT c_custkey, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey) AS suppliers FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "j_paths": "SELECT 'c' || c_custkey AS start, 'r' || n_regionkey AS node, 2 AS hops FROM customer JOIN nation ON c_nationkey = n_nationkey",
}
