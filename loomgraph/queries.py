"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph import answer_queries, context_queries, evidence_queries, health_queries, log_queries, more_queries, process_queries, source_queries
from loomgraph.operators import ranks as R
from loomgraph.operators import usage as U
from loomgraph.plans.requests import Computation, Derived, Dimension, Filter, Join, Layout, Measure, Request, answer, majority_outer, week_starts
from loomgraph.sources.tables import table

STAR = Layout(
    [
        Join("lineitem", "l_orderkey", "orders", "o_orderkey"),
        Join("lineitem", "l_partkey", "part", "p_partkey"),
        Join("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        Join("orders", "o_custkey", "customer", "c_custkey"),
        Join("customer", "c_nationkey", "nation", "n_nationkey"),
        Join("nation", "n_regionkey", "region", "r_regionkey"),
    ],
    computations={
        c.name: c
        for c in (
            Computation("open value", "measure", "SUM(orders.o_totalprice)", ("orders",), ("orders.o_orderstatus = 'O'",)),
            Computation("open orders", "measure", "COUNT(*)", ("orders",), ("orders.o_orderstatus = 'O'",)),
            Computation("finished share", "measure", "SUM(CASE WHEN orders.o_orderstatus = 'F' THEN 1 ELSE 0 END) / COUNT(*)", ("orders",)),
            Computation("last price", "measure", "MAX_BY(orders.o_totalprice, orders.o_orderkey)", ("orders",), (), ("orders.o_custkey",)),
            Computation("buyers", "measure", "COUNT(DISTINCT orders.o_custkey)", ("orders",)),
            Computation("size", "dimension", "CASE WHEN orders.o_totalprice > 250000 THEN 'big' ELSE 'small' END", ("orders",)),
            Computation("rich", "population", "customer.c_acctbal > 5000 AND customer.c_mktsegment <> 'FURNITURE'", ("customer",)),
        )
    },
)
MONTH, REGION = Dimension("month", "orders.o_orderdate", "month"), Dimension("region", "region.r_name")
SALES = Measure("sales", "orders", "sum", "o_totalprice")
ORDERS = Measure("n_orders", "orders", "count")
OPEN = Measure("n_open", "orders", "count", None, (Filter("orders.o_orderstatus", "=", "O"),))
LINES = Measure("n_lines", "lineitem", "count")
FROM = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"

REQUESTS = {
    "i_two_hop_month_region": (Request((SALES, ORDERS), (), (MONTH, REGION)), f"SELECT date_trunc('month', o_orderdate)::DATE AS month, r_name AS region, sum(o_totalprice) AS sales, count(*) AS n_orders {FROM} GROUP BY 1, 2"),
    "i_conditional_ratio": (Request((ORDERS, OPEN), (Derived("open_share", "ratio", "n_open", "n_orders"),), (REGION,)), f"SELECT r_name AS region, count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'O') / count(*) AS open_share {FROM} GROUP BY 1"),
    "i_two_facts": (Request((ORDERS, LINES), (Derived("more", "difference", "n_lines", "n_orders"),), (REGION,)), f"WITH a AS (SELECT r_name AS region, count(*) AS n_orders {FROM} GROUP BY 1), b AS (SELECT r_name AS region, count(*) AS n_lines {FROM} JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT region, n_orders, n_lines, n_lines - n_orders AS more FROM a FULL JOIN b USING (region)"),
    "i_per_then": (Request((Measure("mean_customer_sales", "orders", "sum", "o_totalprice", (), "o_custkey", "avg"),), (), (REGION,)), f"SELECT region, avg(v) AS mean_customer_sales FROM (SELECT r_name AS region, o_custkey, sum(o_totalprice) AS v {FROM} GROUP BY 1, 2) GROUP BY 1"),
    "i_period_having_top": (
        Request((ORDERS,), (), (Dimension("customer", "orders.o_custkey"),), (), ("orders.o_orderdate", "1996-01-01", "1997-12-31"), (Filter("n_orders", ">=", 3),), (("n_orders", True), ("customer", False)), 20),
        "SELECT o_custkey AS customer, count(*) AS n_orders FROM orders WHERE o_orderdate::DATE BETWEEN '1996-01-01' AND '1997-12-31' GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 20",
    ),
    "i_listing": (Request((), (), (Dimension("segment", "customer.c_mktsegment"), Dimension("nation", "nation.n_name"))), "SELECT DISTINCT c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "i_totals": (Request((ORDERS, LINES), (Derived("lines_per_order", "ratio", "n_lines", "n_orders"),)), "SELECT n_orders, n_lines, n_lines / n_orders AS lines_per_order FROM (SELECT count(*) AS n_orders FROM orders), (SELECT count(*) AS n_lines FROM lineitem)"),
    "i_count_distinct": (Request((Measure("buyers", "orders", "count_distinct", "o_custkey"), Measure("least", "orders", "min", "o_totalprice"), Measure("most", "orders", "max", "o_totalprice")), (), (REGION, Dimension("year", "orders.o_orderdate", "year"))), f"SELECT r_name AS region, date_trunc('year', o_orderdate)::DATE AS year, count(DISTINCT o_custkey) AS buyers, min(o_totalprice) AS least, max(o_totalprice) AS most {FROM} GROUP BY 1, 2"),
    "i_sunday_weeks": (Request((ORDERS,), (), (Dimension("week", "orders.o_orderdate", "week"),)), "SELECT o_orderdate::DATE - dayofweek(o_orderdate)::INT AS week, count(*) AS n_orders FROM orders GROUP BY 1"),
    "i_quarter_filtered": (Request((SALES,), (), (Dimension("quarter", "orders.o_orderdate", "quarter"),), (Filter("customer.c_mktsegment", "in", ("BUILDING", "MACHINERY")),)), "SELECT date_trunc('quarter', o_orderdate)::DATE AS quarter, sum(o_totalprice) AS sales FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1"),
}
# What the compiler decides: which rows an aggregate keeps, where a fact starts, which column answers for another.
REQUESTS |= {
    "i_shared_conditions": (
        Request((Measure("value", computation="open value"), Measure("n_open", computation="open orders")), (), (REGION,)),
        f"SELECT r_name AS region, sum(o_totalprice) AS value, count(*) AS n_open {FROM} WHERE o_orderstatus = 'O' GROUP BY 1",
    ),
    "i_own_conditions": (
        Request((Measure("value", computation="open value"), Measure("share", computation="finished share"), ORDERS), (), (REGION,)),
        f"SELECT r_name AS region, sum(o_totalprice) FILTER (o_orderstatus = 'O') AS value, (count(*) FILTER (o_orderstatus = 'F')) / count(*) AS share, count(*) AS n_orders {FROM} GROUP BY 1",
    ),
    "i_latest_value": (
        Request((Measure("held", computation="last price"),), (), (Dimension("segment", "customer.c_mktsegment"),)),
        "SELECT segment, sum(v) AS held FROM (SELECT c_mktsegment AS segment, o_custkey, max_by(o_totalprice, o_orderkey) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1",
    ),
    "i_latest_at_its_grain": (
        Request((Measure("held", computation="last price"),), (), (Dimension("customer", "orders.o_custkey"),), (), ("orders.o_orderdate", "1997-01-01", None)),
        "SELECT o_custkey AS customer, max_by(o_totalprice, o_orderkey) AS held FROM orders WHERE o_orderdate::DATE >= '1997-01-01' GROUP BY 1",
    ),
    "i_fact_moves": (
        Request((Measure("buyers", computation="buyers"),), (), (Dimension("brand", "part.p_brand"),), (Filter("lineitem.l_quantity", ">=", 10),)),
        "SELECT p_brand AS brand, count(DISTINCT o_custkey) AS buyers FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 10 GROUP BY 1",
    ),
    "i_equal_column": (
        Request((LINES,), (), (Dimension("supplier", "supplier.s_suppkey"), Dimension("customer", "customer.c_custkey")), (Filter("lineitem.l_quantity", ">", 49),)),
        "SELECT l_suppkey::BIGINT AS supplier, o_custkey::BIGINT AS customer, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 49 GROUP BY 1, 2",
    ),
    "i_period_of_two_facts": (
        Request((ORDERS, LINES), (Derived("per_order", "ratio", "n_lines", "n_orders"),), (), (), ("orders.o_orderdate", "1996-01-01", "1996-12-31")),
        "SELECT n_orders, n_lines, n_lines / n_orders AS per_order FROM (SELECT count(*) AS n_orders FROM orders WHERE year(o_orderdate) = 1996), (SELECT count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1996)",
    ),
    "i_columns_compared": (
        Request((LINES,), (), (Dimension("flag", "lineitem.l_returnflag"),), (Filter("lineitem.l_suppkey", ">", "lineitem.l_partkey"),)),
        "SELECT l_returnflag AS flag, count(*) AS n_lines FROM lineitem WHERE l_suppkey > l_partkey GROUP BY 1",
    ),
    "i_population": (
        Request((ORDERS,), (), (Dimension("size", computation="size"), REGION), (Filter("rich"),)),
        f"SELECT CASE WHEN o_totalprice > 250000 THEN 'big' ELSE 'small' END AS size, r_name AS region, count(*) AS n_orders {FROM} WHERE c_acctbal > 5000 AND c_mktsegment <> 'FURNITURE' GROUP BY 1, 2",
    ),
    "i_derived_of_derived": (
        Request((ORDERS, OPEN), (Derived("twice", "ratio", "rest", "n_orders"), Derived("rest", "difference", "n_orders", "n_open")), (REGION,), (), None, (Filter("n_orders", ">", 5),), (("rest", True), ("region", False)), 3),
        f"SELECT region, n_orders, n_open, rest / n_orders AS twice, rest FROM (SELECT r_name AS region, count(*) AS n_orders, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) - count(*) FILTER (o_orderstatus = 'O') AS rest {FROM} GROUP BY 1 HAVING count(*) > 5) ORDER BY rest DESC, region LIMIT 3",
    ),
}


def i_week_starts(spark, d):
    """How most orders of a status name the start of a week, by their priority."""
    day = F.element_at(F.array(*map(F.lit, ("SUNDAY", "MONDAY", "ISOWEEK", "DAY", "SUNDAY"))), F.substring("o_orderpriority", 1, 1).cast("int"))
    t = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("table"), F.month("o_orderdate").cast("string").alias("column"), day.alias("day")).agg(F.count("*").alias("shapes"))
    return week_starts(t)


def i_join_kinds(spark, d):
    """Joins of a log of the line items, outer where most uses are."""
    n = table(spark, d, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"))
    uses = [(f"t{r[0] % 4}", "k", f"t{r[0] % 3 + 4}", "k", "LEFT" if r[1] == "N" else "INNER", r[2]) for r in n.collect()]
    return spark.createDataFrame([(j.left, j.right, j.outer) for j in majority_outer(uses)], "left string, right string, outer boolean")


def a_log_groups(spark, d):
    out = U.log_groups(table(spark, d, "events"), ["user_id", "event_type"], "ts", "value", F.col("event_type") == "error")
    return out.withColumn("total", F.round("total", 4))


def a_principal_profiles(spark, d):
    return U.principal_profiles(table(spark, d, "events"), "user_id", "ts").withColumn("daily_cv", F.round("daily_cv", 6))


def h_top_values(spark, d):
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return U.top_per_group(n, ["user_id"], [F.desc("n"), F.asc("event_type")], 2)


def n_transitions(spark, d):
    return U.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


def n_smoothed_odds(spark, d):
    e = table(spark, d, "events")
    good = e.groupBy(F.col("user_id").alias("u"), F.to_date("ts").alias("d")).agg(F.bool_or(F.col("event_type") == "purchase").alias("good"))
    touched = e.select("user_id", F.to_date("ts").alias("day"), "event_type").distinct().join(good, (F.col("user_id") == F.col("u")) & (F.col("day") == F.col("d")))
    return U.smoothed_odds(touched, "event_type", "good", 5.0, 10)


def k_capped_context(spark, d):
    out = U.capped_context(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey", "o_orderdate", "1996-01-01", "1998-12-31", [F.desc("o_orderdate"), F.asc("o_orderkey")], 3)
    return out.select("o_custkey", "o_orderkey", "rank", "capped")


def k_cadence(spark, d):
    return U.cadence_days(table(spark, d, "events"), "user_id", "ts")


def l_superseded_facts(spark, d):
    facts = table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.max("o_orderpriority").alias("priority"))
    return U.superseded(facts, ["o_custkey"], "o_orderdate")


def o_v_measure(spark, d):
    return U.v_measure(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select(*[F.round(c, 6).alias(c) for c in ("homogeneity", "completeness", "v")])


def o_auc(spark, d):
    o = table(spark, d, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").alias("good"))
    return R.auc(o, "score", "good").select(F.round("auc", 6).alias("auc"))


QUERIES = {name: (lambda spark, d, r=req: answer(spark, d, STAR, r)) for name, (req, _) in REQUESTS.items()}
QUERIES |= {f.__name__: f for f in (i_week_starts, i_join_kinds, a_log_groups, a_principal_profiles, h_top_values, n_transitions, n_smoothed_odds, k_capped_context, k_cadence, l_superseded_facts, o_v_measure, o_auc)}
SQL = {name: sql for name, (_, sql) in REQUESTS.items()} | {
    "i_week_starts": """
WITH v AS (SELECT o_orderstatus AS t, month(o_orderdate)::VARCHAR AS c, CASE o_orderpriority[1:1] WHEN '1' THEN 'week' WHEN '5' THEN 'week' WHEN '2' THEN 'week_monday' WHEN '3' THEN 'week_monday' END AS grain, count(*) AS n FROM orders GROUP BY 1, 2, 3),
r AS (SELECT *, sum(n) OVER (PARTITION BY t, c) AS a FROM v WHERE grain IS NOT NULL)
SELECT t AS "table", c AS "column", grain FROM r WHERE 2 * n > a""",
    "i_join_kinds": """
WITH u AS (SELECT 't' || (l_linenumber % 4) AS l, 't' || (l_linenumber % 3 + 4) AS r, l_returnflag = 'N' AS o FROM lineitem)
SELECT l AS "left", r AS "right", count(*) FILTER (o) > count(*) FILTER (NOT o) AS "outer" FROM u GROUP BY 1, 2""",
    "a_log_groups": "SELECT user_id, event_type, date_trunc('week', ts)::DATE AS week, count(*) AS jobs, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS total, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT ts::DATE) AS n_days FROM events GROUP BY 1, 2, 3",
    "a_principal_profiles": """
WITH b AS (SELECT user_id, count(*) AS jobs, count(DISTINCT ts::DATE) AS active_days, count(*) FILTER (dayofweek(ts) IN (0, 6)) AS weekend_jobs,
  count(*) FILTER (hour(ts) BETWEEN 9 AND 17 AND dayofweek(ts) NOT IN (0, 6)) AS business_jobs FROM events GROUP BY 1),
s AS (SELECT user_id, hour(ts) AS h, minute(ts) AS m, count(DISTINCT ts::DATE) AS sd FROM events GROUP BY ALL),
r AS (SELECT user_id, count(*) FILTER (sd >= 0.5 * active_days) AS recurring_slots FROM s JOIN b USING (user_id) GROUP BY 1),
v AS (SELECT user_id, round(stddev_samp(n) / avg(n), 6) AS daily_cv FROM (SELECT user_id, ts::DATE AS d, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1)
SELECT user_id, jobs, active_days, weekend_jobs, business_jobs, recurring_slots, daily_cv FROM b JOIN r USING (user_id) JOIN v USING (user_id)""",
    "h_top_values": "SELECT * FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rank FROM events GROUP BY 1, 2) WHERE rank <= 2",
    "n_transitions": """
WITH s AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
c AS (SELECT src, count(*) AS count FROM s GROUP BY 1)
SELECT src, dst, count(*) AS num, any_value(c.count) AS count, round(count(*) / any_value(c.count), 6) AS probability FROM s JOIN c USING (src) WHERE dst IS NOT NULL GROUP BY 1, 2""",
    "n_smoothed_odds": """
WITH g AS (SELECT user_id, ts::DATE AS d, bool_or(event_type = 'purchase') AS good FROM events GROUP BY 1, 2),
t AS (SELECT DISTINCT e.user_id, e.ts::DATE AS d, event_type, good FROM events e JOIN g ON e.user_id = g.user_id AND e.ts::DATE = g.d),
b AS (SELECT avg(good::INT) AS base FROM t)
SELECT event_type, count(*) AS n, sum(good::INT)::BIGINT AS n_good, (sum(good::INT) + 5.0::DOUBLE * any_value(base)) / (count(*) + 5.0::DOUBLE) AS odds FROM t, b GROUP BY 1 HAVING count(*) >= 10""",
    "k_capped_context": """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS n
  FROM orders WHERE o_orderdate::DATE BETWEEN '1996-01-01' AND '1998-12-31' AND o_custkey IN (SELECT c_custkey FROM customer))
SELECT o_custkey, o_orderkey, rank, n > 3 AS capped FROM r WHERE rank <= 3""",
    "k_cadence": "WITH d AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events), g AS (SELECT user_id, d - lag(d) OVER (PARTITION BY user_id ORDER BY d) AS gap FROM d) SELECT user_id, quantile_cont(gap, 0.5)::DOUBLE AS cadence FROM g WHERE gap IS NOT NULL GROUP BY 1",
    "l_superseded_facts": "WITH f AS (SELECT o_custkey, o_orderdate, max(o_orderpriority) AS priority FROM orders GROUP BY 1, 2) SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS valid_until FROM f",
    "o_v_measure": """
WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
e AS (SELECT (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS ha, (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS hb, (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM c) AS hab),
h AS (SELECT CASE WHEN ha = 0 THEN 1 ELSE 1 - (hab - hb) / ha END AS x, CASE WHEN hb = 0 THEN 1 ELSE 1 - (hab - ha) / hb END AS y FROM e)
SELECT round(x, 6) AS homogeneity, round(y, 6) AS completeness, round(2 * x * y / (x + y), 6) AS v FROM h""",
    "o_auc": """
WITH r AS (SELECT l_returnflag = 'R' AS good, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem),
t AS (SELECT sum(r) FILTER (good) AS s, count(*) FILTER (good)::DOUBLE AS p, count(*) FILTER (NOT good)::DOUBLE AS q FROM r)
SELECT round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM t""",
}
QUERIES |= more_queries.QUERIES | evidence_queries.QUERIES | process_queries.QUERIES | log_queries.QUERIES | context_queries.QUERIES | answer_queries.QUERIES | source_queries.QUERIES | health_queries.QUERIES
SQL |= more_queries.SQL | evidence_queries.SQL | process_queries.SQL | log_queries.SQL | context_queries.SQL | answer_queries.SQL | source_queries.SQL | health_queries.SQL
