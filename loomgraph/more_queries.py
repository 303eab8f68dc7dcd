"""Queries over processes, graphs, vectors and scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import graph as G
from loomgraph.operators import process as P
from loomgraph.operators import ranks as R
from loomgraph.sources.tables import table


def steps(spark, d):
    return P.turns(table(spark, d, "conversations"))


def n_lift(spark, d):
    return P.lift(steps(spark, d))


def n_outcomes(spark, d):
    return P.outcomes(steps(spark, d))


def n_empirical_odds(spark, d):
    return P.empirical(steps(spark, d), 5.0, 10).withColumn("odds", F.round("odds", 6))


def n_leave_one_out(spark, d):
    return P.leave_one_out(steps(spark, d), 5.0, 10).withColumn("brier", F.round("brier", 6))


def n_absorbing_chain(spark, d):
    return P.absorbing_chain(steps(spark, d)).withColumn("chance", F.round("chance", 5))


def o_nmi_ari(spark, d):
    return R.agreement(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus").select(F.round("nmi", 6).alias("nmi"), F.round("ari", 6).alias("ari"))


def o_spearman(spark, d):
    return R.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("pearson", 6).alias("pearson"), F.round("spearman", 6).alias("spearman"))


def o_nearest_rank(spark, d):
    return R.nearest_rank(table(spark, d, "events"), ["event_type"], "value", 95.0)


def o_calibration(spark, d):
    told = table(spark, d, "lineitem").select((F.col("l_tax") * 10).alias("told"), (F.col("l_returnflag") == "R").alias("good"))
    out = R.calibration(told.withColumn("told", F.round("told", 4)), "told", "good", 10)
    return out.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("mean_predicted", "share_good", "squares")])


def o_wilson(spark, d):
    out = R.wilson(table(spark, d, "lineitem"), ["l_linestatus", "l_linenumber"], F.col("l_returnflag") == "R")
    return out.select("l_linestatus", "l_linenumber", "n", "n_good", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def o_edges_prf(spark, d):
    o = table(spark, d, "orders")
    return R.edges_prf(o.filter("o_orderstatus = 'O'"), o.filter("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"])


def d_components(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    up = c.select(F.col("c_custkey").alias("up"), F.col("c_mktsegment").alias("s"))
    edges = c.join(up, (F.floor(F.col("c_custkey") / 3) == F.col("up")) & (F.col("c_mktsegment") == F.col("s"))).filter("c_custkey <> up")
    return G.components(edges, "c_custkey", "up")


def j_reach(spark, d):
    c = table(spark, d, "customer").select("c_custkey")
    edges = c.select(F.col("c_custkey").alias("a"), (F.floor(F.col("c_custkey") / 3)).alias("b"))
    return G.reach(edges, c.select(F.col("c_custkey").alias("start")), 3)


def brands(spark, d):
    return table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))


def e_coread(spark, d):
    return G.coread(brands(spark, d), "l_orderkey", "p_brand")


def e_usage_cosine(spark, d):
    return G.usage_cosine(e_coread(spark, d)).withColumn("cosine", F.round("cosine", 6))


def h_is_unique(spark, d):
    out = None
    for name, keys in (("customer", ["c_custkey"]), ("lineitem", ["l_orderkey"]), ("lineitem", ["l_orderkey", "l_linenumber"]), ("nation", ["n_regionkey"])):
        one = G.is_unique(table(spark, d, name), keys).select(F.lit(name).alias("table"), F.lit(",".join(keys)).alias("keys"), "n", "n_distinct", "unique")
        out = one if out is None else out.union(one)
    return out


def j_elect_key(spark, d):
    o = table(spark, d, "orders")
    return G.elect_key(o.select(F.col("o_orderpriority").alias("table"), F.month("o_orderdate").alias("column"), F.col("o_custkey").alias("other")), 2)


def e_nearest(spark, d):
    e = table(spark, d, "embeddings")
    return G.nearest(e, e.filter("vec_id % 100 = 0"), 5)


def n_closest(spark, d):
    return G.closest(table(spark, d, "embeddings"), "label", 3)


def l_masked(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce(T.masked(F.col("text")), F.lit("")), 256).alias("masked_sha256"))


def k_window_start(spark, d):
    day = F.to_date("o_orderdate")
    a, b = T.last_range(day, "quarter")
    return table(spark, d, "orders").select(T.window_start(day, 2).alias("since"), a.alias("first"), b.alias("last")).groupBy("since", "first", "last").agg(F.count("*").alias("n"))


def n_element_id(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.element_id(F.lit("state"), F.col("n_name")).alias("element"))


QUERIES = {
    f.__name__: f
    for f in (
        n_lift, n_outcomes, n_empirical_odds, n_leave_one_out, n_absorbing_chain, o_nmi_ari, o_spearman, o_nearest_rank, o_calibration, o_wilson, o_edges_prf, d_components,
        j_reach, e_coread, e_usage_cosine, h_is_unique, j_elect_key, e_nearest, n_closest, l_masked, k_window_start, n_element_id,
    )
}

TURNS = """
t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'state' ELSE 'action' END AS kind, sha1(coalesce(text, '')) AS digest FROM conversations WHERE role IN ('user', 'assistant')),
s AS (SELECT *, kind || ':' || substr(digest, 1, 1) AS element FROM t),
o AS (SELECT conv_id, count(*) AS n_turns, count(DISTINCT element) AS n_elements, arg_max(element, (turn, kind, digest)) AS last, arg_max(substr(digest, 2, 1) < '8', (turn, kind, digest)) AS good FROM s GROUP BY 1)"""
TOUCHED = f"""{TURNS},
e AS (SELECT element, count(*) AS n, count(*) FILTER (good) AS n_good FROM (SELECT DISTINCT conv_id, element FROM s) JOIN o USING (conv_id) GROUP BY 1)"""
BRANDS = "r AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL)"
PAIRS = f"{BRANDS}, p AS (SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS n FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY 1, 2)"
EDGES = "g AS (SELECT c.c_custkey AS a, u.c_custkey AS b FROM customer c JOIN customer u ON c.c_custkey // 3 = u.c_custkey AND c.c_mktsegment = u.c_mktsegment WHERE c.c_custkey <> u.c_custkey)"


def masked_sql() -> str:
    text = "text"
    for pattern, mask in T.MASKS:
        text = f"regexp_replace({text}, '{pattern.replace(chr(39), chr(39) * 2)}', '{mask}', 'g')"
    return f"SELECT doc_id, sha256(coalesce({text}, '')) AS masked_sha256 FROM documents"


UNIQUE = " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", '{k}' AS keys, count(*) AS n, count(DISTINCT ({k})) AS n_distinct, count(*) > 0 AND count(*) = count(DISTINCT ({k})) AS \"unique\" FROM {t}"
    for t, k in (("customer", "c_custkey"), ("lineitem", "l_orderkey"), ("lineitem", "l_orderkey,l_linenumber"), ("nation", "n_regionkey"))
)
SQL = {
    "n_lift": f"""WITH {TURNS},
w AS (SELECT element AS src, kind, lead(element) OVER v AS nx, lead(kind) OVER v AS nk FROM s WINDOW v AS (PARTITION BY conv_id ORDER BY turn, kind, digest)),
x AS (SELECT src, CASE WHEN kind <> nk THEN nx END AS dst FROM w),
c AS (SELECT src, count(*) AS n, count(*) FILTER (dst IS NULL) AS ends FROM x GROUP BY 1)
SELECT src, dst, count(*) AS num, any_value(c.n) AS count, any_value(ends) AS ends, round(count(*) / any_value(c.n), 6) AS probability FROM x JOIN c USING (src) WHERE dst IS NOT NULL GROUP BY 1, 2""",
    "n_outcomes": f"WITH {TURNS} SELECT * FROM o",
    "n_empirical_odds": f"WITH {TOUCHED}, b AS (SELECT avg(good::INT) AS base FROM o) SELECT element, n, n_good, CASE WHEN n >= 10 THEN round((n_good + 5 * base) / (n + 5), 6) END AS odds FROM e, b",
    "n_leave_one_out": f"""WITH {TOUCHED}, a AS (SELECT count(*) AS al, count(*) FILTER (good) AS ag FROM o),
f AS (SELECT good::INT AS g, CASE WHEN n - 1 >= 10 THEN (n_good - good::INT + 5.0::DOUBLE * (ag - good::INT) / (al - 1)) / (n - 1 + 5.0::DOUBLE) END AS odds FROM o JOIN e ON last = element, a)
SELECT count(*) AS n, count(odds) AS covered, round(avg((odds - g) * (odds - g)), 6) AS brier FROM f""",
    "o_nmi_ari": """
WITH c AS (SELECT o_orderpriority AS a, o_orderstatus AS b, count(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
x AS (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h, sum(n * (n - 1) / 2) AS p, sum(n) AS t FROM c),
y AS (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h, sum(n * (n - 1) / 2) AS p FROM (SELECT sum(n) AS n FROM c GROUP BY a)),
z AS (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h, sum(n * (n - 1) / 2) AS p FROM (SELECT sum(n) AS n FROM c GROUP BY b))
SELECT round(2 * (y.h + z.h - x.h) / (y.h + z.h), 6) AS nmi, round((x.p - y.p * z.p / (t * (t - 1) / 2)) / ((y.p + z.p) / 2 - y.p * z.p / (t * (t - 1) / 2)), 6) AS ari FROM x, y, z""",
    "o_spearman": """
WITH r AS (SELECT l_quantity AS a, l_extendedprice AS b, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS ra,
  rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS rb FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL)
SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r""",
    "o_nearest_rank": """
WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, value FROM r WHERE i = least(greatest(round_even(n * 95.0::DOUBLE / 100 + 0.5, 0), 1), n)""",
    "o_calibration": """
WITH l AS (SELECT round(l_tax * 10, 4) AS p, (l_returnflag = 'R')::INT AS g FROM lineitem)
SELECT least(floor(p * 10), 9)::BIGINT AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted, round(avg(g), 6) AS share_good, round(sum((p - g) * (p - g)), 6) AS squares FROM l GROUP BY 1""",
    "o_wilson": """
WITH l AS (SELECT l_linestatus, l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_good FROM lineitem GROUP BY 1, 2),
q AS (SELECT *, n_good / n AS p, 1.96::DOUBLE AS z FROM l)
SELECT l_linestatus, l_linenumber, n, n_good, round(((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low,
  round(((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM q""",
    "o_edges_prf": """
WITH f AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'), t AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM t) AS truth, (SELECT count(*) FROM f JOIN t USING (o_custkey, o_orderpriority)) AS "both")
SELECT found, truth, "both", "both" / found AS precision, "both" / truth AS recall, 2 * "both" / (found + truth) AS f1 FROM n""",
    "d_components": f"WITH RECURSIVE {EDGES}, u AS (SELECT a, b FROM g UNION SELECT b, a FROM g), r AS (SELECT a AS node, a AS other FROM u UNION SELECT node, b FROM r JOIN u ON other = a) SELECT node, min(other) AS component FROM r GROUP BY 1",
    "j_reach": """
WITH RECURSIVE r AS (SELECT c_custkey AS start, c_custkey AS node, 0 AS hops FROM customer
  UNION SELECT start, c_custkey // 3, hops + 1 FROM r JOIN customer ON node = c_custkey WHERE hops < 3)
SELECT start, node, min(hops) AS hops FROM r GROUP BY 1, 2""",
    "e_coread": f"WITH {PAIRS} SELECT * FROM p",
    "e_usage_cosine": f"WITH {PAIRS}, e AS (SELECT u, sum(n)::DOUBLE AS e FROM (SELECT a AS u, n FROM p UNION ALL SELECT b, n FROM p) GROUP BY 1) SELECT a, b, round(n / sqrt(x.e * y.e), 6) AS cosine FROM p JOIN e x ON x.u = a JOIN e y ON y.u = b",
    "h_is_unique": UNIQUE,
    "j_elect_key": """
WITH d AS (SELECT o_orderpriority AS "table", month(o_orderdate)::INT AS "column", count(DISTINCT o_custkey) AS degree FROM orders GROUP BY 1, 2),
m AS (SELECT *, rank() OVER (PARTITION BY "table" ORDER BY degree DESC) AS r FROM d),
k AS (SELECT * FROM m WHERE r = 1 QUALIFY count(*) OVER (PARTITION BY "table") = 1)
SELECT "table", "column", degree FROM k WHERE degree >= 2""",
    "e_nearest": """
WITH u AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query, n.vec_id AS near, round(list_inner_product(q.e, n.e) / sqrt(list_inner_product(q.e, q.e)) / sqrt(list_inner_product(n.e, n.e)), 6) AS score FROM u q JOIN u n ON q.vec_id <> n.vec_id WHERE q.vec_id % 100 = 0)
SELECT query, near, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, near) AS rank FROM s QUALIFY rank <= 5""",
    "n_closest": """
WITH x AS (SELECT label, i, avg(e) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS e, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY i) AS centre FROM x GROUP BY 1),
s AS (SELECT label, vec_id, round(list_inner_product(embedding::DOUBLE[], centre) / sqrt(list_inner_product(centre, centre)) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS score FROM embeddings JOIN c USING (label))
SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 3""",
    "l_masked": masked_sql(),
    "k_window_start": """
WITH q AS (SELECT date_trunc('quarter', o_orderdate) AS q FROM orders)
SELECT (q - INTERVAL 6 MONTH)::DATE AS since, (q - INTERVAL 3 MONTH)::DATE AS first, (q - INTERVAL 1 DAY)::DATE AS last, count(*) AS n FROM q GROUP BY ALL""",
    "n_element_id": "SELECT n_nationkey, 'state:' || substr(sha1(n_name), 1, 12) AS element FROM nation",
}
