"""Queries over sources, catalogs and statements' tables; and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomgraph.operators import graph as G
from loomgraph.operators import levels as L
from loomgraph.sources import catalog as C
from loomgraph.sources.shared import shared_dir
from loomgraph.sources.tables import table

FIELDS = {"event": "id", "conversation": "conv_id", "order": "turn", "time": "at", "channel": "channel", "role": "role", "text": "text"}


def events(spark, d):
    """The conversations as a log of events in gzipped JSON, read back."""
    c = table(spark, d, "conversations")
    lines = c.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "conv_id", "turn", F.lit("t").alias("at"), F.when(F.col("turn") % 7 == 5, "note").otherwise("call").alias("channel"), "role", F.coalesce("text", F.lit("")).alias("text"))
    path = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    C.write_ndjson(lines, path)
    read = C.read_ndjson(spark, path, "id string, conv_id long, turn long, at string, channel string, role string, text string")
    return C.read_events(read, FIELDS, {"user": "state", "assistant": "action"}, ("note",))


def a_events(spark, d):
    return events(spark, d)[0].select("event", "conversation", "seq", "kind", F.sha1(F.col("text").cast("binary")).alias("text_sha1"))


def a_skipped(spark, d):
    return events(spark, d)[1]


def a_catalog(spark, d):
    return C.folder_catalog(spark, d, ["region", "nation", "customer"]).select("table", "column", "ordinal")


def physical(spark, d):
    o = table(spark, d, "orders")
    shards = o.select(F.concat(F.lit("d"), F.col("o_orderkey") % 3).alias("dataset"), F.concat(F.lit("sales_"), F.date_format("o_orderdate", "yyyyMM")).alias("name")).distinct()
    others = o.filter("o_orderkey % 50 = 0").select(F.concat(F.lit("d"), F.col("o_orderkey") % 4).alias("dataset"), F.concat(F.lit("stage_"), F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 12)).alias("name"))
    return shards.union(others).union(spark.createDataFrame([("d1", "once_20240101")], "dataset string, name string")).withColumn("kind", F.lit("BASE TABLE"))


def a_families(spark, d):
    return C.shard_families(physical(spark, d))


def a_canonical(spark, d):
    aliases = spark.createDataFrame([("d0", "w.zero"), ("d1", "w.one")], "dataset string, logical string")
    out = C.canonical_tables(physical(spark, d), [(r"_[0-9a-f]{12}$", "_{hex}")], aliases)
    return out.groupBy("table", "kind").agg(F.count("*").alias("n"))


def b_expanded(spark, d):
    """Statements that read a customer, where customers are views of the one with a third of their key."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    views = c.filter("c_custkey > 9").select(F.col("c_custkey").cast("long").alias("view"), F.floor(F.col("c_custkey") / 3).cast("long").alias("table"))
    return C.expanded(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("table")), views, 12)


def b_crosscheck(spark, d):
    li = table(spark, d, "lineitem")
    return C.crosscheck(li.filter("l_linenumber <> 2").select(F.col("l_orderkey").alias("id"), "l_suppkey").withColumnRenamed("l_suppkey", "table"), li.filter("l_linenumber <> 4").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("table")))


def n_first_parents(spark, d):
    """The first level above vectors: kinds of near ones, their size and the length of their centre's first coordinates."""
    e = table(spark, d, "embeddings").withColumn("weight", F.lit(1.0)).withColumn("kind", F.lit("state"))
    (level,) = L.climb(e, "kind", "vec_id", "embedding", "weight", 4, 0.2, 1, 3, 0.95)[:1]
    return level.groupBy("kind").agg(F.count_distinct("parent").alias("parents"), F.count("*").alias("children"))


def e_groups(spark, d):
    """Sizes of the communities of customers who order alike, two members at least."""
    from loomgraph.evidence_queries import e_communities

    return L.group_sizes(e_communities(spark, d), "node", "community").select("community", "n", "bucket")


def h_reachable(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("a"), F.concat(F.lit("r"), "n_regionkey").alias("b"))
    return G.reach(n, n.select(F.col("a").alias("start")), 1).filter("hops = 1")


QUERIES = {f.__name__: f for f in (a_events, a_skipped, a_catalog, a_families, a_canonical, b_expanded, b_crosscheck, n_first_parents, e_groups, h_reachable)}
PHYSICAL = """p AS (SELECT DISTINCT 'd' || (o_orderkey % 3) AS dataset, 'sales_' || strftime(o_orderdate, '%Y%m') AS name FROM orders
  UNION ALL SELECT 'd' || (o_orderkey % 4), 'stage_' || substr(md5(o_orderkey::VARCHAR), 1, 12) FROM orders WHERE o_orderkey % 50 = 0 UNION ALL SELECT 'd1', 'once_20240101'),
f AS (SELECT dataset, regexp_extract(name, '^(.*_)(\\d{8}|\\d{6})$', 1) AS prefix, count(DISTINCT name) AS shards FROM p WHERE regexp_matches(name, '^(.*_)(\\d{8}|\\d{6})$') GROUP BY 1, 2 HAVING count(DISTINCT name) > 1)"""
SQL = {
    "a_events": "SELECT conv_id || '/' || turn AS event, conv_id::BIGINT AS conversation, turn::BIGINT AS seq, CASE role WHEN 'user' THEN 'state' ELSE 'action' END AS kind, sha1(coalesce(text, '')) AS text_sha1 FROM conversations WHERE role IN ('user', 'assistant') AND turn % 7 <> 5",
    "a_skipped": "SELECT CASE WHEN turn % 7 = 5 THEN 'channel note' ELSE 'role ' || coalesce(role, '') END AS why, count(*) AS n FROM conversations WHERE turn % 7 = 5 OR role IS NULL OR role NOT IN ('user', 'assistant') GROUP BY 1",
    "a_catalog": "SELECT table_name AS \"table\", column_name AS \"column\", (ordinal_position - 1)::INT AS ordinal FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer')",
    "a_families": f"WITH {PHYSICAL} SELECT * FROM f",
    "a_canonical": f"""WITH {PHYSICAL},
n AS (SELECT CASE dataset WHEN 'd0' THEN 'w.zero.' ELSE 'w.one.' END AS l, name, prefix FROM p LEFT JOIN f USING (dataset) WHERE dataset IN ('d0', 'd1'))
SELECT l || CASE WHEN starts_with(name, prefix) THEN prefix || '*' ELSE regexp_replace(name, '_[0-9a-f]{{12}}$', '_{{hex}}') END AS "table", CASE WHEN starts_with(name, prefix) THEN 'wildcard' ELSE 'table' END AS kind, count(*) AS n FROM n GROUP BY 1, 2""",
    "b_expanded": """
WITH RECURSIVE r AS (SELECT o_orderkey AS id, o_custkey::BIGINT AS t, 0 AS i FROM orders UNION ALL SELECT id, (t // 3)::BIGINT, i + 1 FROM r JOIN customer ON t = c_custkey WHERE t > 9 AND i < 12)
SELECT id, max_by(t, i) AS "table" FROM r GROUP BY 1""",
    "b_crosscheck": """
WITH a AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS t FROM lineitem WHERE l_linenumber <> 2), b AS (SELECT DISTINCT l_orderkey AS id, l_suppkey AS t FROM lineitem WHERE l_linenumber <> 4),
d AS (SELECT id, t, a.id IS NULL AS m FROM a FULL JOIN b USING (id, t) WHERE a.id IS NULL OR b.id IS NULL)
SELECT id, coalesce(string_agg(t::VARCHAR, ',' ORDER BY t) FILTER (m), '') AS missed, coalesce(string_agg(t::VARCHAR, ',' ORDER BY t) FILTER (NOT m), '') AS extra FROM d GROUP BY 1""",
    "h_reachable": "SELECT DISTINCT 'n' || n_nationkey AS start, 'r' || n_regionkey AS node, 1 AS hops FROM nation",
}
