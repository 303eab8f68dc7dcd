"""Queries over evidence, alignment, access, communities and windows of time, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.operators import communities as C
from loomgraph.operators import evidence as E
from loomgraph.sources.tables import table
from loomgraph.streaming import usage as S


def a_home_vote(spark, d):
    return E.home_vote(table(spark, d, "events"), "user_id", "event_type")


def a_hash_sample(spark, d):
    return E.hash_sample(table(spark, d, "documents"), "text", 0.25).select("doc_id")


def a_notes(spark, d):
    out = E.notes(table(spark, d, "conversations"), "conv_id", "turn", "text", F.col("role") == "user")
    return out.select("conv_id", F.sha2("notes", 256).alias("notes_sha256"))


def a_source_problems(spark, d):
    c = table(spark, d, "conversations")
    return E.source_problems(c, "conv_id", ["turn", "text"], "role", ["user", "assistant"])


def b_representative(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count_if(F.col("value") > 50).alias("runs"))
    return E.representative(e, "user_id", "event_type", F.col("runs"))


def b_review_sample(spark, d):
    return E.review_sample(table(spark, d, "orders"), "o_orderpriority", "o_orderkey", 20)


def c_flows(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("src"), (F.col("user_id") % 7).alias("dst"), "event_type", F.lit(1).alias("jobs"), (F.col("value") > 1).alias("control"))
    return E.flows(e, "src", "dst", "event_type", "jobs", "control")


def c_weighted_values(spark, d):
    return E.weighted_values(table(spark, d, "orders"), "o_custkey", "o_orderpriority", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0), 3)


def c_frozen(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    name = F.col("c_custkey").alias("name")
    views = c.select(F.col("c_custkey").alias("view"), F.floor(F.col("c_custkey") / 3).alias("base"))
    written = o.filter("o_orderdate >= DATE '1998-06-01'").select(F.col("o_custkey").alias("name"))
    return E.frozen(c.select(name), written, c.filter("c_mktsegment = 'FURNITURE' AND c_acctbal > 5000").select(name), views)


def d_majority_join(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 50).alias("y"), "l_returnflag")
    return E.majority_join(x, "x", "y", "l_returnflag")


def d_confidence(spark, d):
    e = table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 30).alias("key"))
    n = e.agg(F.count_distinct("user_id").alias("people"), (F.max("value") > 400).alias("production"), (F.min("value") < 0.5).alias("suspect"))
    return n.select("event_type", "key", E.confidence(F.col("key") == 0, F.col("production"), F.col("suspect"), F.col("people")).alias("confidence"))


def d_bridges(spark, d):
    return E.bridges(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


def e_stability(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    again = v.select("vec_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("run"), "label")
    again = again.select("run", "vec_id", F.when((F.col("vec_id") + F.col("run")) % 5 == 0, F.col("label") + 1).otherwise(F.col("label")).alias("label"))
    out = E.stability(v, again, "vec_id", "label", "run")
    return out.select("label", F.round("stability", 6).alias("stability"))


def e_communities(spark, d):
    """Customers that order with the same priority on the same day."""
    o = table(spark, d, "orders").withColumn("basket", F.concat_ws("/", F.to_date("o_orderdate"), "o_orderpriority"))
    return C.shared_communities(o, "basket", "o_custkey")


def f_computations(spark, d):
    p = table(spark, d, "part").withColumn("jobs", F.col("p_size").cast("long"))
    return E.same_computations(p, ["p_type", "p_brand"], "p_name", "p_size", "jobs")


def f_parameters(spark, d):
    return E.parameters(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


def g_covered(spark, d):
    c = table(spark, d, "customer")
    edges = c.select(F.col("c_custkey").alias("x"), F.floor(F.col("c_custkey") / 3).alias("y"))
    return E.covered(edges, c.filter("c_acctbal > 9000").select(F.col("c_custkey").alias("node")), "x", "y")


def g_alignment(spark, d):
    o = table(spark, d, "orders")
    designed = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("part"), (F.col("o_custkey") % 400).alias("term"))
    used = o.filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("part"), F.floor(F.col("o_totalprice") / 100).alias("group"))
    return E.alignment(designed, used, "part", "term", "group")


def m_access(spark, d):
    p = table(spark, d, "part")
    return E.access(p, p.filter("p_size > 3").select("p_name"), "p_brand", "p_name")


def m_readable_shapes(spark, d):
    o, li, p = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    parts = li.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    return E.readable_shapes(o, parts, p.filter("p_size > 10").select("p_partkey"), "o_orderkey", "p_partkey", "o_orderpriority", "^1-")


def s_tumbling(spark, d):
    return S.tumbling(table(spark, d, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


def s_sessions(spark, d):
    return S.sessions(table(spark, d, "events"), "ts", "user_id", "6 hours")


QUERIES = {
    f.__name__: f
    for f in (
        a_home_vote, a_hash_sample, a_notes, a_source_problems, b_representative, b_review_sample, c_flows, c_weighted_values, c_frozen, d_majority_join, d_confidence, d_bridges,
        e_stability, e_communities, f_computations, f_parameters, g_covered, g_alignment, m_access, m_readable_shapes, s_tumbling, s_sessions,
    )
}

TOP = "row_number() OVER (PARTITION BY {} ORDER BY {}) AS r"
PLACED = "(part, term) AS (SELECT o_orderkey, o_custkey % 400 FROM orders WHERE o_orderstatus = 'F')"
READS = "r AS (SELECT l_orderkey, list(DISTINCT p_brand) FILTER (p_brand IS NOT NULL) AS reads FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"
SQL = {
    "a_home_vote": f"SELECT user_id, event_type, votes FROM (SELECT *, {TOP.format('user_id', 'votes DESC, event_type')} FROM (SELECT user_id, event_type, count(*) AS votes FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2)) WHERE r = 1",
    "a_hash_sample": "SELECT doc_id FROM documents WHERE ('0x' || substr(sha1(text), 1, 8))::BIGINT / 4294967296 < 0.25",
    "a_notes": "SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn, text)) AS notes_sha256 FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY 1",
    "a_source_problems": """
SELECT * FROM (SELECT 'missing turn' AS problem, count(*) FILTER (turn IS NULL) AS n FROM conversations UNION ALL SELECT 'missing text', count(*) FILTER (text IS NULL) FROM conversations
UNION ALL SELECT 'unknown role', count(*) FILTER (role NOT IN ('user', 'assistant')) FROM conversations UNION ALL SELECT 'repeated conv_id', count(conv_id) - count(DISTINCT conv_id) FROM conversations) WHERE n > 0""",
    "b_representative": f"SELECT user_id, event_type FROM (SELECT *, {TOP.format('user_id', 'runs DESC, length(event_type), event_type')} FROM (SELECT user_id, event_type, count(*) FILTER (value > 50) AS runs FROM events GROUP BY 1, 2)) WHERE r = 1",
    "b_review_sample": "SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha1(o_orderkey::VARCHAR), o_orderkey) AS rank FROM orders QUALIFY rank <= 20",
    "c_flows": "SELECT user_id % 20 AS src, user_id % 7 AS dst, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(*) AS jobs, bool_and(value > 1) AS control FROM events GROUP BY 1, 2",
    "c_weighted_values": f"""
WITH e AS (SELECT o_custkey, o_orderpriority AS v, count(*) FILTER (o_orderstatus = 'F') AS w FROM orders GROUP BY 1, 2)
SELECT o_custkey, string_agg(v, ',' ORDER BY r) AS top, string_agg(w::VARCHAR, ',' ORDER BY r) AS weights FROM (SELECT *, {TOP.format('o_custkey', 'w DESC, v')} FROM e) WHERE r <= 3 GROUP BY 1""",
    "c_frozen": """
WITH RECURSIVE a AS (SELECT c_custkey AS node, 0 AS hops FROM customer WHERE c_mktsegment = 'FURNITURE' AND c_acctbal > 5000 UNION SELECT c_custkey // 3, hops + 1 FROM a JOIN customer ON node = c_custkey WHERE hops < 3)
SELECT c_custkey AS name, c_custkey NOT IN (SELECT node FROM a) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= DATE '1998-06-01') AS frozen FROM customer""",
    "d_majority_join": f"""
WITH n AS (SELECT least(l_partkey % 50, l_suppkey % 50) AS a, greatest(l_partkey % 50, l_suppkey % 50) AS b, l_returnflag AS kind, count(*) AS c FROM lineitem GROUP BY 1, 2, 3)
SELECT a, b, kind, n FROM (SELECT a, b, kind, sum(c) OVER (PARTITION BY a, b)::BIGINT AS n, {TOP.format('a, b', 'c DESC, kind')} FROM n) WHERE r = 1""",
    "d_confidence": """
WITH n AS (SELECT event_type, user_id % 30 AS key, count(DISTINCT user_id) AS people, max(value) > 400 AS production, min(value) < 0.5 AS suspect FROM events GROUP BY 1, 2)
SELECT event_type, key, CASE WHEN key = 0 THEN 'self' WHEN production THEN 'production' WHEN suspect THEN 'suspect' WHEN people >= 2 THEN 'corroborated' ELSE 'single' END AS confidence FROM n""",
    "d_bridges": "WITH s AS (SELECT DISTINCT o_custkey AS t, o_orderpriority AS s FROM orders) SELECT x.s AS a, y.s AS b, count(*) AS tables FROM s x JOIN s y ON x.t = y.t AND x.s < y.s GROUP BY 1, 2",
    "e_stability": """
WITH a AS (SELECT run, vec_id, CASE WHEN (vec_id + run) % 5 = 0 THEN label + 1 ELSE label END AS other FROM embeddings, range(1, 5) t(run)),
j AS (SELECT label, run, other, count(*) AS c FROM embeddings JOIN a USING (vec_id) GROUP BY 1, 2, 3),
n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), k AS (SELECT run, other, count(*) AS k FROM a GROUP BY 1, 2),
b AS (SELECT label, run, max(c / (n + k - c)) AS j FROM j JOIN n USING (label) JOIN k USING (run, other) GROUP BY 1, 2)
SELECT label, round(coalesce(sum(j), 0) / 4, 6) AS stability FROM n LEFT JOIN b USING (label) GROUP BY 1""",
    "f_computations": f"""
WITH p AS (SELECT sha256(coalesce(p_type, '') || chr(10) || coalesce(p_brand, '')) AS id, * FROM part),
n AS (SELECT id, string_agg(p_name, ',' ORDER BY r) AS aliases FROM (SELECT *, {TOP.format('id', 'w DESC, p_name')} FROM (SELECT id, p_name, sum(p_size) AS w FROM p GROUP BY 1, 2)) WHERE r <= 5 GROUP BY 1),
g AS (SELECT id, p_size::VARCHAR AS grain FROM (SELECT *, {TOP.format('id', 'w DESC, p_size')} FROM (SELECT id, p_size, sum(p_size) AS w FROM p GROUP BY 1, 2)) WHERE r = 1)
SELECT id, any_value(aliases) AS aliases, any_value(grain) AS grain, sum(p_size)::BIGINT AS jobs FROM p JOIN n USING (id) JOIN g USING (id) GROUP BY 1""",
    "f_parameters": "SELECT o_custkey, o_orderstatus, count(DISTINCT o_orderpriority) AS n_values FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) > 1",
    "g_covered": "WITH RECURSIVE a AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal > 9000 UNION SELECT c_custkey // 3 FROM a JOIN customer ON node = c_custkey) SELECT node FROM a",
    "g_alignment": f"""
WITH d{PLACED}, u AS (SELECT o_orderkey AS part, floor(o_totalprice / 100)::BIGINT AS "group" FROM orders WHERE o_totalprice > 200000),
m AS (SELECT DISTINCT term, "group" FROM d JOIN u USING (part)),
c AS (SELECT *, count(*) OVER (PARTITION BY term) AS gs, count(*) OVER (PARTITION BY "group") AS ts FROM m)
SELECT term, "group", CASE WHEN gs > 1 AND ts > 1 THEN 'both' WHEN gs > 1 THEN 'split' WHEN ts > 1 THEN 'several_terms' ELSE 'agree' END AS finding FROM c
UNION ALL SELECT DISTINCT term, NULL, 'unread' FROM d WHERE term NOT IN (SELECT term FROM m) UNION ALL SELECT DISTINCT NULL, "group", 'undesigned' FROM u WHERE "group" NOT IN (SELECT "group" FROM m)""",
    "m_access": """
WITH p AS (SELECT DISTINCT p_brand, p_name, p_name IN (SELECT p_name FROM part WHERE p_size > 3) AS may FROM part)
SELECT p_brand, count(*) AS n, count(*) FILTER (may) AS n_readable, CASE WHEN bool_and(may) THEN 'all' WHEN bool_or(may) THEN 'some' ELSE 'none' END AS access FROM p GROUP BY 1""",
    "m_readable_shapes": """
SELECT o_orderkey FROM orders WHERE o_orderpriority NOT LIKE '1-%' AND o_orderkey IN
  (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)))""",
    "s_tumbling": "SELECT ts::DATE::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "s_sessions": """
WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true)::INT AS first FROM events),
n AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts, first DESC ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM n GROUP BY user_id, s""",
}
