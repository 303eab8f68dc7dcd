"""Queries over choices, computations, design against use, repeated work, access and scores; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import answers as A
from loomgraph.sources.tables import table


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding", "label")


def h_descend(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 3).cast("long").alias("parent")).filter("child <> parent")
    return A.descend(c.filter("child <= 3").select(F.col("child").alias("node")), c, 3)


def members(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_brand").alias("group"), F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")).alias("table"), F.col("p_name").alias("col")).distinct()


def h_used(spark, d):
    """How many customers ordered something of each type and size."""
    li, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    run = o.select(F.col("o_custkey").alias("principal"), F.col("o_orderkey").alias("shape_id"))
    read = li.select(F.col("l_orderkey").alias("shape_id"), F.col("l_partkey").alias("col"))
    return A.used(run, read, p.select(F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")).alias("table"), F.col("p_partkey").alias("col")))


def h_cohort(spark, d):
    frozen = members(spark, d).filter("col like '%ring'").select("table").distinct()
    top = A.cohort(members(spark, d), h_used(spark, d), frozen, ["Brand#1", "Brand#2", "Brand#3"], 12, by_usage=True)
    return spark.createDataFrame([(i, t) for i, t in enumerate(top)], "rank int, table string")


def h_similar(spark, d):
    e = vectors(spark, d).withColumn("tables", F.array(F.concat(F.lit("t"), "label"), F.concat(F.lit("u"), F.col("vec_id") % 4)))
    bad = spark.createDataFrame([("t1",), ("u3",)], "table string")
    return A.similar(e, e.filter("vec_id % 100 = 0"), bad, 3, "vec_id")


def h_definitions(spark, d):
    e = vectors(spark, d).withColumn("health_check", F.when(F.col("vec_id") % 7 == 0, True)).withColumn("same_as", F.when(F.col("vec_id") % 5 == 0, F.col("vec_id") + 1))
    return A.definitions(e, e.filter("vec_id % 100 = 0"), 4, 0.1, "vec_id")


def f_flags(spark, d):
    p = table(spark, d, "part")
    comps = p.groupBy((F.col("p_partkey") % 60).alias("id")).agg(F.collect_set(F.concat("p_type", F.lit("/"), F.col("p_size").cast("string"))).alias("tables"))
    by = p.select((F.col("p_partkey") % 60).alias("id"), (F.col("p_size") == 7).alias("service"), (F.col("p_size") < 49).alias("aggregate_only"), (F.col("p_brand") == "Brand#1").alias("grouped"))
    bad = p.filter("p_retailprice > 1900").select(F.concat("p_type", F.lit("/"), F.col("p_size").cast("string")).alias("table"))
    out = A.flagged(comps, by, bad)
    return out.withColumn("status", A.lifecycle(F.col("trusted"), F.col("production")))


def f_near(spark, d):
    return A.near_alike(vectors(spark, d).withColumn("block", F.col("label")), 0.3, 3, "vec_id")


def f_merged(spark, d):
    e = vectors(spark, d)
    return A.merged(f_near(spark, d), e.select(F.col("vec_id").alias("id"), (F.col("vec_id") * 37 % 101).alias("jobs")))


def f_provenance(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("shape_id"), F.lit(1).alias("jobs"))
    return A.provenance(o, 2)


def f_area_votes(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    up = c.select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("n"), "c_nationkey").alias("parent")).union(table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")))
    return A.area_votes(o.select(F.concat_ws("/", F.month("o_orderdate").cast("string"), "o_orderpriority").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("col")), up, 3)


def f_successions(spark, d):
    """Orders as requests of a customer: what they read are brands; they succeed each other when the priority differs."""
    succ, _ = A.successions(requests_of(spark, d), 60, 0.2)
    return succ.withColumn("jaccard", F.round("jaccard", 6))


def f_variants(spark, d):
    _, variants = A.successions(requests_of(spark, d), 60, 0.2)
    return variants


def requests_of(spark, d):
    o, li, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    own = F.concat_ws(":", F.col("o_custkey").cast("string"), "p_brand")
    reads = li.join(p, F.col("l_partkey") == F.col("p_partkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).filter("p_brand is not null").groupBy("l_orderkey").agg(F.collect_set(own).alias("reads"))
    day = F.to_date("o_orderdate")
    return o.join(reads, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("id"), day.alias("first_seen"), day.alias("last_seen"), F.array("o_custkey").alias("principals"), "reads", F.array("o_orderpriority").alias("tables"),
        F.array(F.concat_ws("/", day.cast("string"), F.col("o_orderstatus"))).alias("computes"),
    )


def g_best(spark, d):
    e = vectors(spark, d)
    return A.best(e.filter("vec_id % 50 = 1"), e.filter("vec_id % 10 = 0"), 0.3, "vec_id", "embedding")


def g_findings(spark, d):
    """A catalog that binds customers to terms, against what their orders are."""
    c, o, n = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "nation")
    k = F.col("c_custkey")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    bound = c.filter(k % 3 < 2).select(name("c", k).alias("col"), name("term", k % 40).alias("term")).union(c.filter(k % 50 == 1).select(name("c", k), name("term", k % 7)))
    bound = bound.union(n.select(F.lit(None).cast("string"), name("term", F.col("n_nationkey") * 3)))
    columns = c.select(name("c", k).alias("col"), name("u", k % 90).alias("unit"), name("t", F.col("c_nationkey")).alias("table"))
    reads = o.filter("o_orderkey % 3 = 0").select(name("c", F.col("o_custkey")).alias("col"))
    suspects = c.filter(k % 90 < 45).select(name("u", k % 90).alias("a"), name("u", k % 90 + 40).alias("b")).distinct()
    tables = n.select(name("t", F.col("n_nationkey")).alias("table"), (F.col("n_nationkey") % 2 == 0).alias("certified"), (F.col("n_nationkey") % 3 == 0).alias("described"))
    run = c.filter("c_acctbal > 9000").select(name("t", F.col("c_nationkey")).alias("table"), k.alias("principal"))
    near = c.select(name("u", k % 90).alias("unit"), name("term", k % 40).alias("term")).distinct()
    groups = c.select(name("g", k % 33).alias("group"), name("u", k % 99).alias("unit"), (k % 33 > 9).alias("stable")).distinct()
    classes = n.select(F.col("n_name").alias("class"), (F.col("n_regionkey") > 1).alias("matched"))
    return A.findings(bound, columns, reads, suspects, tables, run, near, groups, classes)


def l_jaccard_pairs(spark, d):
    e = table(spark, d, "events").select("user_id", F.concat_ws("/", "event_type", F.dayofmonth("ts").cast("string"), F.floor(F.hour("ts") / 6).cast("string")).alias("item"))
    return A.jaccard_pairs(e, "user_id", "item", 0.1)


def j_sharing(spark, d):
    """Orders that have two parts or more in common with an asked one."""
    li = table(spark, d, "lineitem")
    return A.sharing(li, "l_orderkey", "l_partkey", F.col("l_orderkey") % 100 == 0, 2)


def l_remembered(spark, d):
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    asks = o.select(F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("ident"), F.col("o_orderkey").alias("answer"), day.alias("at"), F.when(F.col("o_orderkey") % 5 != 0, F.date_add(day, 300)).alias("until"), (F.col("o_orderstatus") == "P").alias("rejected"))
    return A.remembered(asks, F.lit("1997-06-30").cast("date"))


def l_skills(spark, d):
    o, li, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    tasks = o.select(F.col("o_orderkey").alias("task"), (F.col("o_orderstatus") != "P").alias("good"))
    steps = li.join(p, F.col("l_partkey") == F.col("p_partkey")).filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("task"), F.struct("l_linenumber", "p_type", "l_partkey").alias("seq"), F.col("p_type").alias("step"))
    return A.skills(tasks, steps, o.select(F.col("o_orderkey").alias("task"), (F.col("o_custkey") % 50).alias("cluster")), 20, 0.3).withColumn("rate", F.round("rate", 6))


def l_measured(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 30).alias("skill"), (F.col("o_orderkey") % 3 > 0).alias("followed"), (F.col("o_orderstatus") == "F").alias("good"))
    return A.measured(o, 10, 0.5)


def m_computation_ok(spark, d):
    p = table(spark, d, "part")
    comps = p.groupBy((F.col("p_partkey") % 200).alias("id")).agg(F.collect_set(F.col("p_size").cast("string")).alias("tables"), F.collect_set("p_brand").alias("columns"), F.min("p_name").alias("text"))
    may = p.filter("p_size <> 13").select(F.col("p_size").cast("string").alias("name")).union(p.filter("p_brand <> 'Brand#9'").select("p_brand"))
    return A.computation_ok(comps, may, "widget$")


def m_groups_access(spark, d):
    return allowed(spark, d)[2]


def m_hidden(spark, d):
    return allowed(spark, d)[1]


def m_tables(spark, d):
    return allowed(spark, d)[0]


def allowed(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    grants = s.select((F.col("s_suppkey") % 7).alias("principal"), F.col("s_nationkey").alias("table"))
    policies = table(spark, d, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("table"))
    tags = c.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("col"), F.col("c_nationkey").alias("table"), (F.col("c_custkey") % 7).alias("principal"))
    return A.allowlist(grants, policies, tags, c.select(F.concat_ws("/", "c_mktsegment", (F.col("c_custkey") % 25).cast("string")).alias("group"), F.col("c_custkey").alias("col"), F.col("c_nationkey").alias("table")))


def probabilities(spark, d, keep):
    e = table(spark, d, "events").filter(keep)
    from loomgraph.operators.usage import transitions

    return transitions(e, "user_id", ["ts", "event_id"], "event_type").select("src", "dst", "probability")


def o_fidelity(spark, d):
    out = A.fidelity(probabilities(spark, d, "true"), probabilities(spark, d, "event_id % 2 = 0"))
    return out.select("n", F.round("mean_difference", 6).alias("mean_difference"), F.round("correlation", 5).alias("correlation"))


def o_paired(spark, d):
    li = table(spark, d, "lineitem").withColumn("a", F.when(F.col("l_linenumber") != 3, F.col("l_tax")))
    return A.paired(li, "a", "l_discount").select("n", F.round("difference", 7).alias("difference"), F.round("half_width", 7).alias("half_width"))


def o_folds(spark, d):
    return A.folds(table(spark, d, "orders"), "o_orderkey", 5).groupBy("fold").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("s"))


def o_coverage(spark, d):
    li = table(spark, d, "lineitem").withColumn("good", F.col("l_returnflag") == "R")
    return A.coverage(li, "l_quantity", "good", "l_discount", [1, 10, 25, 50]).select("floor", F.round("share", 6).alias("share"), F.round("brier", 6).alias("brier"))


def o_summary(spark, d):
    return A.summary(table(spark, d, "events"), ["event_type"], "value", {"click": 10.0, "view": 25.0}).withColumn("share", F.round("share", 6))


QUERIES = {
    f.__name__: f
    for f in (
        h_descend, h_used, h_cohort, h_similar, h_definitions, f_flags, f_near, f_merged, f_provenance, f_area_votes, f_successions, f_variants, g_best, g_findings, l_jaccard_pairs, j_sharing, l_remembered,
        l_skills, l_measured, m_computation_ok, m_groups_access, m_hidden, m_tables, o_fidelity, o_paired, o_folds, o_coverage, o_summary,
    )
}

UNIT = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL)"
COS = "round(list_dot_product(q.e, n.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(n.e, n.e)), 6)"
KIND = "p_type || '/' || p_size"
USED = f"u AS (SELECT {KIND} AS t, count(DISTINCT o_custkey) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1)"
NEAR = f"""WITH RECURSIVE {UNIT},
s AS (SELECT q.vec_id AS q, n.vec_id AS n, {COS} AS c FROM v q JOIN v n ON q.label = n.label AND q.vec_id <> n.vec_id),
k AS (SELECT least(q, n) AS a, greatest(q, n) AS b FROM s WHERE c >= 0.3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, n) <= 3),
g AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r AS (SELECT a AS node, a AS other FROM g UNION SELECT node, b FROM r JOIN g ON other = a),
f AS (SELECT node, min(other) AS component FROM r GROUP BY 1)"""
READS = "d AS (SELECT l_orderkey AS k, list(DISTINCT p_brand) AS reads FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL GROUP BY 1), o AS (SELECT o_orderkey AS id, o_custkey AS person, o_orderdate::DATE AS day, o_orderpriority AS p, o_orderstatus AS s, reads FROM orders JOIN d ON o_orderkey = k)"
ALLOW = """g AS (SELECT DISTINCT s_suppkey % 7 AS principal, s_nationkey AS t FROM supplier WHERE s_nationkey IS NOT NULL),
h AS (SELECT DISTINCT g.principal, c_custkey AS col FROM g JOIN customer ON c_nationkey = t WHERE c_custkey % 10 = 0 AND c_custkey % 7 <> g.principal),
p AS (SELECT concat_ws('/', c_mktsegment, c_custkey % 25) AS grp, c_custkey AS col, c_nationkey AS t FROM customer)"""
TRANSITIONS = "{0} AS (SELECT src, dst, round(count(*) / any_value(c), 6) AS p FROM (SELECT *, count(*) OVER (PARTITION BY src) AS c FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events WHERE {1})) WHERE dst IS NOT NULL GROUP BY 1, 2)"
BOUND = """
b AS (SELECT 'c' || c_custkey AS col, 'term' || (c_custkey % 40) AS term FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT 'c' || c_custkey, 'term' || (c_custkey % 7) FROM customer WHERE c_custkey % 50 = 1 UNION ALL SELECT NULL, 'term' || (n_nationkey * 3) FROM nation),
bu AS (SELECT DISTINCT col, 'u' || (c_custkey % 90) AS unit, term FROM b JOIN customer ON 'c' || c_custkey = col),
tu AS (SELECT DISTINCT unit, term FROM bu),
sus AS (SELECT DISTINCT 'u' || (c_custkey % 90) AS a, 'u' || (c_custkey % 90 + 40) AS b FROM customer WHERE c_custkey % 90 < 45),
run AS (SELECT DISTINCT 't' || c_nationkey AS t, c_custkey AS principal FROM customer WHERE c_acctbal > 9000)"""
SQL = {
    "h_descend": """
WITH RECURSIVE e AS (SELECT c_custkey::BIGINT AS c, (c_custkey // 3)::BIGINT AS p FROM customer WHERE c_custkey <> c_custkey // 3),
r AS (SELECT c AS top, c AS node, 0 AS hops FROM e WHERE c <= 3 UNION SELECT top, c, hops + 1 FROM r JOIN e ON p = node WHERE hops < 3)
SELECT top, node, min(hops)::INT AS hops FROM r GROUP BY 1, 2""",
    "h_used": f"""WITH {USED} SELECT t AS "table", n FROM u""",
    "h_cohort": f"""WITH {USED},
m AS (SELECT {KIND} AS t, count(DISTINCT p_name) AS cols FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1), f AS (SELECT DISTINCT {KIND} AS t FROM part WHERE p_name LIKE '%ring')
SELECT (row_number() OVER (ORDER BY m.t IN (SELECT t FROM f), coalesce(n, 0) DESC, cols DESC, m.t) - 1)::INT AS rank, m.t AS "table" FROM m LEFT JOIN u USING (t) QUALIFY rank < 12""",
    "h_similar": f"""WITH {UNIT}, s AS (SELECT q.vec_id AS query, n.vec_id AS near, {COS} AS score FROM v q JOIN v n ON q.vec_id <> n.vec_id WHERE q.vec_id % 100 = 0 AND n.label <> 1 AND n.vec_id % 4 <> 3)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, near)::INT AS rank FROM s QUALIFY rank <= 3""",
    "h_definitions": f"""WITH {UNIT}, s AS (SELECT q.vec_id AS query, n.vec_id AS near, {COS} AS score FROM v q JOIN v n ON q.vec_id <> n.vec_id WHERE q.vec_id % 100 = 0 AND n.vec_id % 7 <> 0 AND n.vec_id % 5 <> 0)
SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, near)::INT AS rank FROM s WHERE score >= 0.1 QUALIFY rank <= 4""",
    "f_flags": f"""
WITH x AS (SELECT p_partkey % 60 AS id, bool_or({KIND} IN (SELECT {KIND} FROM part WHERE p_retailprice > 1900)) AS bad, bool_or(p_size = 7) AS production, bool_and(p_size < 49 AND p_brand <> 'Brand#1') AS health_check FROM part GROUP BY 1)
SELECT id, NOT bad AS trusted, production, health_check, CASE WHEN bad THEN 'deprecated' WHEN production THEN 'stable' ELSE 'draft' END AS status FROM x""",
    "f_near": f"{NEAR} SELECT * FROM f",
    "f_merged": f"{NEAR}, j AS (SELECT node, component, max_by(node, (node * 37 % 101, node)) OVER (PARTITION BY component) AS same_as FROM f) SELECT node AS id, same_as FROM j WHERE node <> same_as",
    "f_provenance": "SELECT o_custkey AS id, o_orderpriority AS shape_id, count(*) AS jobs, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority)::INT AS rank FROM orders GROUP BY 1, 2 QUALIFY rank <= 2",
    "f_area_votes": """
WITH x AS (SELECT month(o_orderdate) || '/' || o_orderpriority AS id, 'r' || n_regionkey AS area, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, area) = 1""",
    "f_successions": f"""WITH {READS},
p AS (SELECT x.id AS a, y.id AS b, (y.day - x.day)::INT AS gap, len(list_intersect(x.reads, y.reads)) AS c, len(x.reads) + len(y.reads) AS n FROM o x JOIN o y ON x.person = y.person AND y.day - x.day BETWEEN 1 AND 60 AND x.p <> y.p)
SELECT a, b, gap, round(c / (n - c), 6) AS jaccard FROM p WHERE c / (n - c) >= 0.2""",
    "f_variants": f"WITH {READS} SELECT x.id AS a, y.id AS b FROM o x JOIN o y ON x.p = y.p AND x.day = y.day AND x.s = y.s AND x.id < y.id",
    "g_best": f"""WITH {UNIT}, s AS (SELECT q.vec_id AS query, n.vec_id AS term, {COS} AS score FROM v q JOIN v n ON q.vec_id <> n.vec_id WHERE q.vec_id % 50 = 1 AND n.vec_id % 10 = 0)
SELECT * FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, term) = 1""",
    "g_findings": f"""WITH {BOUND}
SELECT DISTINCT 'agree' AS finding, unit AS what, term AS other FROM tu WHERE (unit, term) IN (SELECT 'u' || (c_custkey % 90), 'term' || (c_custkey % 40) FROM customer)
UNION ALL SELECT 'several_terms', col, string_agg(term, ',' ORDER BY term) FROM (SELECT DISTINCT col, term FROM bu) GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'split', unit, string_agg(term, ',' ORDER BY term) FROM tu GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'kept_apart', x.term, a || '=' || b FROM sus JOIN tu x ON x.unit = a JOIN tu y ON y.unit = b AND x.term = y.term
UNION ALL SELECT DISTINCT 'orphan', term, NULL FROM b WHERE term NOT IN (SELECT term FROM b WHERE col IS NOT NULL)
UNION ALL SELECT DISTINCT 'unread', term, NULL FROM bu WHERE term NOT IN (SELECT term FROM bu WHERE col IN (SELECT 'c' || o_custkey FROM orders WHERE o_orderkey % 3 = 0))
UNION ALL SELECT 'certified_unqueried', 't' || n_nationkey, NULL FROM nation WHERE n_nationkey % 2 = 0 AND 't' || n_nationkey NOT IN (SELECT t FROM run)
UNION ALL SELECT 'undescribed_tables', t, count(*)::VARCHAR FROM run JOIN nation ON 't' || n_nationkey = t WHERE n_nationkey % 3 <> 0 GROUP BY 2 HAVING count(*) >= 3
UNION ALL SELECT DISTINCT 'undesigned_groups', 'g' || (c_custkey % 33), NULL FROM customer WHERE c_custkey % 33 > 9 AND 'g' || (c_custkey % 33) NOT IN (SELECT 'g' || (c_custkey % 33) FROM customer WHERE 'u' || (c_custkey % 99) IN (SELECT unit FROM tu))
UNION ALL SELECT 'unmatched_classes', n_name, NULL FROM nation WHERE n_regionkey <= 1""",
    "l_jaccard_pairs": """
WITH s AS (SELECT DISTINCT user_id, event_type || '/' || day(ts) || '/' || (hour(ts) // 6) AS item FROM events), n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.user_id AS a, y.user_id AS b, count(*) AS c FROM s x JOIN s y ON x.item = y.item AND x.user_id < y.user_id GROUP BY 1, 2)
SELECT a, b, c / (m.n + k.n - c) AS jaccard FROM p JOIN n m ON m.user_id = a JOIN n k ON k.user_id = b WHERE c / (m.n + k.n - c) >= 0.1""",
    "j_sharing": """
WITH r AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)
SELECT x.l_orderkey AS a, y.l_orderkey AS b, count(*)::INT AS shared FROM r x JOIN r y ON x.l_partkey = y.l_partkey AND x.l_orderkey <> y.l_orderkey WHERE x.l_orderkey % 100 = 0 GROUP BY 1, 2 HAVING count(*) >= 2""",
    "l_remembered": """
WITH a AS (SELECT o_custkey || '/' || o_orderpriority AS ident, o_orderkey AS answer, o_orderdate::DATE AS dy FROM orders WHERE o_orderstatus <> 'P' AND o_orderdate::DATE <= '1997-06-30' AND (o_orderkey % 5 = 0 OR o_orderdate::DATE + 300 >= '1997-06-30'))
SELECT ident, max_by(answer, (dy, answer)) AS answer, max(dy) AS "at" FROM a GROUP BY 1""",
    "l_skills": """
WITH s AS (SELECT l_orderkey AS task, string_agg(p_type, ' > ' ORDER BY l_linenumber, p_type, l_partkey) AS path FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 2 GROUP BY 1),
e AS (SELECT o_custkey % 50 AS cluster, o_orderstatus <> 'P' AS good, coalesce(path, '') AS path FROM orders LEFT JOIN s ON task = o_orderkey),
p AS (SELECT cluster, path FROM e WHERE good GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, path) = 1)
SELECT cluster, n, round(rate, 6) AS rate, path, sha256(path)[1:16] AS key FROM (SELECT cluster, count(*) AS n, avg(good::INT) AS rate FROM e GROUP BY 1) JOIN p USING (cluster) WHERE n >= 20 AND rate >= 0.3""",
    "l_measured": """
WITH x AS (SELECT o_custkey % 30 AS skill, count(*) AS offered, count(*) FILTER (o_orderkey % 3 > 0) AS followed, count(*) FILTER (o_orderkey % 3 > 0 AND o_orderstatus = 'F') AS good FROM orders GROUP BY 1)
SELECT *, followed >= 10 AND good < 0.5 * followed AS retired FROM x""",
    "m_computation_ok": "SELECT p_partkey % 200 AS id FROM part GROUP BY 1 HAVING NOT regexp_matches(min(p_name), 'widget$') AND count(*) FILTER (p_size = 13 OR p_brand = 'Brand#9') = 0",
    "m_groups_access": f"""WITH {ALLOW}, n AS (SELECT grp, count(*) AS n FROM p GROUP BY 1),
k AS (SELECT g.principal, grp, count(*) AS k FROM g JOIN p USING (t) WHERE (g.principal, col) NOT IN (SELECT principal, col FROM h) GROUP BY 1, 2)
SELECT a.principal, grp AS "group", CASE WHEN k = n THEN 'all' WHEN k > 0 THEN 'some' ELSE 'none' END AS access FROM (SELECT DISTINCT principal FROM g) a CROSS JOIN n LEFT JOIN k USING (principal, grp)""",
    "m_hidden": f"WITH {ALLOW} SELECT * FROM h",
    "m_tables": f"""WITH {ALLOW} SELECT principal, t AS "table", t IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AS policied FROM g""",
    "o_fidelity": f"""WITH {TRANSITIONS.format("x", "true")}, {TRANSITIONS.format("y", "event_id % 2 = 0")}
SELECT count(*) AS n, round(avg(abs(coalesce(x.p, 0) - coalesce(y.p, 0))), 6) AS mean_difference, round(corr(coalesce(x.p, 0), coalesce(y.p, 0)), 5) AS correlation FROM x FULL JOIN y USING (src, dst)""",
    "o_paired": "SELECT count(*) AS n, round(avg(l_tax - l_discount), 7) AS difference, round(1.96 * stddev_samp(l_tax - l_discount) / sqrt(count(*)), 7) AS half_width FROM lineitem WHERE l_linenumber <> 3",
    "o_coverage": """
SELECT f AS floor, round(avg((l_quantity >= f)::INT), 6) AS share, round(avg((l_discount - (l_returnflag = 'R')::INT) ** 2) FILTER (l_quantity >= f), 6) AS brier FROM lineitem, (VALUES (1), (10), (25), (50)) v(f) GROUP BY 1""",
    "o_summary": """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, max(value) FILTER (r = greatest(1, ceil(n * 0.5))) AS p50, max(value) FILTER (r = greatest(1, ceil(n * 0.95))) AS p95,
  round(avg((value <= CASE event_type WHEN 'click' THEN 10 WHEN 'view' THEN 25 END)::INT), 6) AS share FROM r GROUP BY 1""",
}
