"""Queries over levels of a process graph, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.more_queries import TURNS, steps
from loomgraph.operators import graph as G
from loomgraph.operators import levels as L
from loomgraph.operators import process as P
from loomgraph.sources.tables import table


def n_transition_vectors(spark, d):
    return L.transition_vectors(steps(spark, d)).withColumn("x", F.round("x", 6))


def n_transition_cosine(spark, d):
    return L.alike(L.transition_vectors(steps(spark, d))).withColumn("cosine", F.round("cosine", 6))


def n_parents(spark, d):
    e = table(spark, d, "embeddings").select((F.col("vec_id") % 3).cast("string").alias("kind"), "label", "vec_id")
    return L.parents(e, "kind", 2, "label", "vec_id")


def n_centroids(spark, d):
    e = table(spark, d, "embeddings").withColumn("weight", F.col("vec_id") % 5 + 1)
    return L.centroids(e, "label", "weight", "embedding").withColumn("x", F.round("x", 5))


def n_neighbours(spark, d):
    return G.near_links(table(spark, d, "embeddings"), 4, 0.2, kind="label").withColumn("w", F.round("w", 8))


def n_small_kinds(spark, d):
    e = table(spark, d, "embeddings").withColumn("group", F.when(F.col("vec_id") % 50 == 0, F.concat(F.lit("rare"), (F.col("vec_id") % 4).cast("string"))).otherwise(F.col("label").cast("string")))
    return L.small_to_nearest(e, "group", "vec_id", "embedding", 12)


def n_ancestors(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("element"))
    up = c.filter("element > 1").select(F.col("element").alias("child"), F.floor(F.col("element") / 2).cast("long").alias("parent"), (F.floor(F.col("element") / 2) % 4 + 1).alias("level"))
    return L.ancestors(c.select(F.col("element").cast("long").alias("element")), up, 3, 20)


def n_last_states(spark, d):
    return L.last_states(steps(spark, d), F.lit(4))


def kinds_of(spark, d):
    last = P.outcomes(steps(spark, d))
    return last.select("conv_id", "last", F.concat(F.lit("kind"), (F.col("conv_id") % 3).cast("string")).alias("outcome"))


def n_chain_kinds(spark, d):
    return P.chain_kinds(steps(spark, d), kinds_of(spark, d)).withColumn("chance", F.round("chance", 5))


def n_likely(spark, d):
    chances = P.chain_kinds(steps(spark, d), kinds_of(spark, d)).withColumn("chance", F.round("chance", 5))
    return P.likely(chances, 2)


def located(spark, d):
    """Every state asks for the states with a hash digit near its own."""
    s = steps(spark, d).filter("kind = 'state'").select("element").distinct()
    digit = lambda c: F.conv(F.right(F.col(c), F.lit(1)), 16, 10).cast("int")
    both = s.select(F.col("element").alias("query")).crossJoin(s.select(F.col("element").alias("state")))  # 16 elements
    return both.select("query", "state", F.round(1 - F.abs(digit("query") - digit("state")) / 16, 4).alias("cosine"))


def outlooks(spark, d):
    s = steps(spark, d)
    ended = P.outcomes(s)
    touched = P.touched(s, ended).withColumn("kind", F.split("element", ":")[0])
    per = touched.groupBy("element", "kind").agg(F.count("*").alias("n"), F.count_if("good").alias("good"))
    w = P.W.partitionBy("conv_id").orderBy(*P.ORDER)
    near = s.select("conv_id", "kind", F.col("element").alias("state"), F.lead("element").over(w).alias("action"), F.lead("kind").over(w).alias("k")).filter("kind = 'state' and k = 'action'")
    nexts = near.join(ended.select("conv_id", "good"), "conv_id").groupBy("state", "action").agg(F.count("*").alias("n"), F.count_if("good").alias("good"))
    states = per.filter("kind = 'state'").select(F.col("element").alias("state"), "n", "good")
    actions = per.filter("kind = 'action'").select(F.col("element").alias("action"), "n", "good")
    return L.outlook(located(spark, d), states, nexts, actions, 0.5, 3, 0.1, 10.0, 5.0, 4.0)


def n_outlook(spark, d):
    return outlooks(spark, d)[0].select("query", *[F.round(c, 5).alias(c) for c in ("support", "end_well")])


def n_outlook_actions(spark, d):
    out = outlooks(spark, d)[1]
    return out.select("query", "action", *[F.round(c, 5).alias(c) for c in ("probability", "support", "end_well_after")], "common", "recommended")


QUERIES = {f.__name__: f for f in (n_transition_vectors, n_transition_cosine, n_parents, n_centroids, n_neighbours, n_small_kinds, n_ancestors, n_last_states, n_chain_kinds, n_likely, n_outlook, n_outlook_actions)}

STEPS = f"WITH {TURNS.strip().rstrip(',')}"
PAIRS = """
z AS (SELECT conv_id, turn, kind, element, lead(element) OVER o AS nxt, lead(kind) OVER o AS next_kind FROM s WINDOW o AS (PARTITION BY conv_id ORDER BY turn, kind, digest)),
p AS (SELECT element, nxt, count(*) AS num FROM z WHERE kind <> next_kind GROUP BY 1, 2)"""
VECTORS = f"""{PAIRS},
c AS (SELECT element, 'out' AS side, nxt AS other, num FROM p UNION ALL SELECT nxt, 'in', element, num FROM p),
v AS (SELECT element, side, other, num / sqrt(sum(num * num) OVER (PARTITION BY element)) AS x FROM c)"""
#: A step of the chain changes chances by less and less; so many of them settle the given conversations.
CHAIN = f"""{PAIRS},
l AS (SELECT conv_id, max_by(element, (turn, kind, digest)) AS last, max_by(digest, (turn, kind, digest)) AS dig FROM s GROUP BY 1),
e AS (SELECT * FROM (SELECT *, %s AS hit, %s AS outcome FROM l %s)),
f AS (SELECT outcome, last AS element, count(*) AS fin, sum(hit) AS hits FROM e GROUP BY 1, 2),
b AS (SELECT outcome, avg(hit) AS base FROM e GROUP BY 1),
a AS (SELECT outcome, t.element, base, coalesce(fin, 0) AS fin, coalesce(fin * (hits + 5 * base) / (fin + 5), 0) AS ending, coalesce(fin, 0) + coalesce(o.left_, 0) AS leaving
  FROM (SELECT DISTINCT element FROM s) t CROSS JOIN b LEFT JOIN f USING (outcome, element) LEFT JOIN (SELECT element, sum(num) AS left_ FROM p GROUP BY 1) o ON o.element = t.element),
h AS (SELECT 0 AS i, outcome, element, base::DOUBLE AS chance FROM a
  UNION ALL SELECT i + 1, outcome, element, CASE WHEN max(leaving) > 0 THEN (coalesce(sum(num * chance), 0) + max(ending)) / max(leaving) ELSE max(base) END
  FROM (SELECT n.i, a.outcome, a.element, a.leaving, a.ending, a.base, p.num, h.chance FROM a CROSS JOIN (SELECT max(i) AS i FROM h) n LEFT JOIN p ON p.element = a.element LEFT JOIN h ON h.element = p.nxt AND h.outcome = a.outcome) WHERE i < 400 GROUP BY 1, 2, 3)"""
GOOD, KINDS = CHAIN % ("(dig[2] < '8')::INT", "'good'", ""), CHAIN % ("(conv_id % 3 = k)::INT", "'kind' || k", "CROSS JOIN (SELECT DISTINCT conv_id % 3 AS k FROM l)")
SQL = {
    "n_transition_vectors": f"{STEPS}, {VECTORS} SELECT element, side, other, round(x, 6) AS x FROM v",
    "n_transition_cosine": f"{STEPS}, {VECTORS} SELECT m.element AS a, n.element AS b, round(sum(m.x * n.x), 6) AS cosine FROM v m JOIN v n USING (side, other) WHERE m.element < n.element GROUP BY 1, 2",
    "n_parents": """
WITH g AS (SELECT (vec_id % 3)::VARCHAR AS kind, label, list_sort(list(DISTINCT vec_id::VARCHAR)) AS c FROM embeddings GROUP BY 1, 2 HAVING count(*) > 1)
SELECT kind, kind || ':L2:' || sha1(array_to_string(c, '|'))[1:12] AS parent, unnest(c) AS child FROM g""",
    "n_centroids": """
WITH e AS (SELECT label, vec_id % 5 + 1 AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
m AS (SELECT label, i, sum(x::DOUBLE * w) / sum(w) AS x FROM e GROUP BY 1, 2)
SELECT label, i::INT AS i, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS x FROM m""",
    "n_neighbours": """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT x.vec_id AS q, y.vec_id AS n, round(list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(y.e, y.e)), 6) AS score FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, n) AS r FROM s),
w AS (SELECT least(q, n) AS a, greatest(q, n) AS b, max(greatest((score - 0.2) / 0.8, 1e-6)) AS w FROM k WHERE r <= 4 AND score > 0.2 GROUP BY 1, 2)
SELECT a, b, round(w, 8) AS w FROM w UNION ALL SELECT vec_id, NULL, NULL FROM v WHERE vec_id NOT IN (SELECT a FROM w) AND vec_id NOT IN (SELECT b FROM w)""",
    "n_small_kinds": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN 'rare' || (vec_id % 4) ELSE label::VARCHAR END AS g, embedding FROM embeddings),
m AS (SELECT g, i, avg(x::DOUBLE) AS x FROM (SELECT g, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM e) GROUP BY 1, 2),
c AS (SELECT g, i, x / sqrt(sum(x * x) OVER (PARTITION BY g)) AS x FROM m),
n AS (SELECT g, count(*) AS n FROM e GROUP BY 1),
d AS (SELECT a.g, b.g AS t, round(sum(a.x * b.x), 9) AS cosine FROM c a JOIN c b USING (i) WHERE a.g IN (SELECT g FROM n WHERE n < 12) AND b.g IN (SELECT g FROM n WHERE n >= 12) GROUP BY 1, 2),
r AS (SELECT g, t FROM d QUALIFY row_number() OVER (PARTITION BY g ORDER BY cosine DESC, t) = 1)
SELECT vec_id, coalesce(t, e.g) AS "group" FROM e LEFT JOIN r ON r.g = e.g""",
    "n_ancestors": """
WITH RECURSIVE u AS (SELECT c_custkey::BIGINT AS child, (c_custkey // 2)::BIGINT AS parent FROM customer WHERE c_custkey > 1 AND (c_custkey // 2) % 4 + 1 <= 3),
r AS (SELECT c_custkey::BIGINT AS element, c_custkey::BIGINT AS ancestor, 0 AS i FROM customer UNION ALL SELECT element, parent, i + 1 FROM r JOIN u ON child = ancestor WHERE i < 20)
SELECT element, max_by(ancestor, i) AS ancestor FROM r GROUP BY 1""",
    "n_last_states": f"{STEPS} SELECT conv_id, max(turn) AS turn, max_by(element, (turn, kind, digest)) AS element FROM s WHERE kind = 'state' AND turn <= 4 GROUP BY 1",
    "n_absorbing_chain": f"{STEPS.replace('WITH', 'WITH RECURSIVE')}, {GOOD} SELECT element, round(chance, 5) AS chance FROM h WHERE i = 400",
    "n_chain_kinds": f"{STEPS.replace('WITH', 'WITH RECURSIVE')}, {KINDS} SELECT outcome, element, round(chance, 5) AS chance FROM h WHERE i = 400",
    "n_likely": f"{STEPS.replace('WITH', 'WITH RECURSIVE')}, {KINDS} SELECT element, outcome, round(chance, 5) AS chance, row_number() OVER (PARTITION BY element ORDER BY round(chance, 5) DESC, outcome) AS rank FROM h WHERE i = 400 QUALIFY rank <= 2",
}
OUTLOOK = f"""{STEPS}, {PAIRS},
l AS (SELECT conv_id, max_by(digest, (turn, kind, digest))[2] < '8' AS good FROM s GROUP BY 1),
per AS (SELECT element, kind, count(*) AS n, count(*) FILTER (good) AS g FROM (SELECT DISTINCT conv_id, element, kind FROM s) JOIN l USING (conv_id) GROUP BY 1, 2),
nx AS (SELECT element AS state, nxt AS action, count(*) AS n, count(*) FILTER (good) AS g FROM z JOIN l USING (conv_id) WHERE kind = 'state' AND next_kind = 'action' GROUP BY 1, 2),
q AS (SELECT a.element AS query, b.element AS state, round(1 - abs(('0x' || a.element[-1:])::INT - ('0x' || b.element[-1:])::INT) / 16, 4) AS cosine
  FROM (SELECT element FROM per WHERE kind = 'state') a, (SELECT element FROM per WHERE kind = 'state') b QUALIFY row_number() OVER (PARTITION BY a.element ORDER BY cosine DESC, b.element) <= 3),
w AS (SELECT query, state, exp((cosine - max(cosine) OVER (PARTITION BY query)) / 0.1) AS w FROM q)"""
SQL["n_outlook"] = f"""{OUTLOOK}
SELECT query, round(m, 5) AS support, CASE WHEN m >= 10 THEN round((h + 2.5) / (m + 5), 5) END AS end_well FROM (SELECT query, sum(w * n) AS m, sum(w * g) AS h FROM w JOIN per ON element = state GROUP BY 1)"""
SQL["n_outlook_actions"] = f"""{OUTLOOK},
x AS (SELECT query, action, sum(w * n) AS m, sum(w * g) AS h FROM w JOIN nx USING (state) GROUP BY 1, 2),
y AS (SELECT query, action, m / sum(m) OVER (PARTITION BY query) AS p, m, (h + 4 * (g + 2.5) / (n + 5)) / (m + 4) AS a FROM x JOIN per ON element = action)
SELECT query, action, round(p, 5) AS probability, round(m, 5) AS support, round(a, 5) AS end_well_after,
  CASE WHEN m >= 10 THEN row_number() OVER (PARTITION BY query, m >= 10 ORDER BY m DESC, action) END AS common, CASE WHEN m >= 10 THEN row_number() OVER (PARTITION BY query, m >= 10 ORDER BY a DESC, p DESC, action DESC) END AS recommended FROM y"""
