"""Communities, streams and odd rows of the evidence operators."""

import collections
import datetime
import itertools

from pyspark.sql import functions as F

import numpy as np

from loomgraph.operators import communities as C
from loomgraph.operators import evidence as E
from loomgraph.operators import graph as G
from loomgraph.streaming import usage as S


def test_communities_find_planted_groups(spark):
    inside = [(10 * g + i, 10 * g + j, 1) for g in range(4) for i, j in itertools.combinations(range(6), 2)]
    bridge = [(10 * g, 10 * (g + 1), 1) for g in range(3)]
    edges = spark.createDataFrame([*inside, *bridge, (None, 3, 1), (99, 98, 0)], "a int, b int, n int")
    got = {tuple(r) for r in C.communities(edges).collect()}
    assert got == {(10 * g + i, 10 * g) for g in range(4) for i in range(6)}
    assert got == {tuple(r) for r in C.communities(edges.select("b", "a", "n").toDF("a", "b", "n").orderBy(F.rand())).collect()}
    assert C.communities(edges.limit(0)).count() == 0


def test_communities_gain_modularity_over_none(spark):
    edges = [(i, (i * 7 + j) % 60, 1 + (i + j) % 3) for i in range(60) for j in (1, 2, 5) if i != (i * 7 + j) % 60]
    place = dict(map(tuple, C.communities(spark.createDataFrame(edges, "a int, b int, n int")).collect()))
    assert set(place) == {x for e in edges for x in e[:2]}
    m, k = 2 * sum(w for *_, w in edges), {}
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w

    def score(at):
        mass = {c: sum(k[x] for x in k if at[x] == c) for c in set(at.values())}
        return sum(2 * w for a, b, w in edges if at[a] == at[b]) / m - sum((v / m) ** 2 for v in mass.values())

    assert score(place) > max(0.2, score({x: x for x in k}))


def test_communities_leave_no_node_that_gains_by_a_move(spark):
    edges = [(i, (i * 13 + 7 * j) % 400, 1 + (i * j) % 4) for i in range(400) for j in (1, 2, 3, 5) if i != (i * 13 + 7 * j) % 400]
    place = dict(map(tuple, C.communities(spark.createDataFrame(edges, "a int, b int, n int"), levels=1).collect()))
    total, k, to, mass = 2 * sum(w for *_, w in edges), {}, {}, {}
    for x, y, w in (e for a, b, n in edges for e in ((a, b, n), (b, a, n))):
        k[x] = k.get(x, 0) + w
        to.setdefault(x, {}).setdefault(place[y], 0)
        to[x][place[y]] += w
    for x in k:
        mass[place[x]] = mass.get(place[x], 0) + k[x]
    assert len(k) == 400
    for x, near in to.items():
        stay = near.get(place[x], 0) - k[x] * (mass[place[x]] - k[x]) / total
        assert all(w - k[x] * mass[c] / total <= stay + 1e-6 for c, w in near.items() if c != place[x])


def test_streams_give_what_tables_give(spark, tmp_path):
    begin = datetime.datetime(2024, 1, 1)
    rows = [(begin + datetime.timedelta(minutes=17 * i + (i % 9 == 0) * 90), f"k{i % 3}", float(i), i % 4) for i in range(300)] + [(None, "k0", 1.0, 1)]
    spark.createDataFrame(rows, "ts timestamp, kind string, value double, who int").write.parquet(f"{tmp_path}/in")
    batch = spark.read.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in")
    for name, run in (("days", lambda d: S.tumbling(d, "ts", "kind", "value")), ("visits", lambda d: S.sessions(d, "ts", "who"))):
        q = run(live).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert not q.isActive
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, run(batch).collect()))


def test_odd_rows(spark):
    pairs = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "x"), ("b", None)], "p string, q string")
    assert [tuple(r) for r in E.home_vote(pairs, "p", "q").collect()] == [("a", "x", 1)]
    assert E.home_vote(pairs.limit(0), "p", "q").count() == 0
    assert {tuple(r) for r in E.access(pairs, pairs.filter("q = 'x'"), "p", "q").collect()} == {("a", 2, 1, "some")}
    lines = spark.createDataFrame([(1, "user"), (1, "user"), (2, None), (3, "robot")], "id int, role string")
    found = {tuple(r) for r in E.source_problems(lines, "id", ["role"], "role", ["user"]).collect()}
    assert found == {("missing role", 1), ("unknown role", 1), ("repeated id", 1)}
    assert E.source_problems(lines.limit(0), "id", ["role"], "role", ["user"]).count() == 0
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "x int, y int")
    assert {r[0] for r in E.covered(loop, spark.createDataFrame([(1,), (None,)], "node int"), "x", "y").collect()} == {1, 2, 3}
    shapes = spark.createDataFrame([(1, "secret"), (2, None), (3, "open")], "s int, t string")
    parts = spark.createDataFrame([(1, "p"), (2, "p"), (4, "p")], "s int, part string")
    assert {r[0] for r in E.readable_shapes(shapes, parts, parts.select("part"), "s", "part", "t", "secret").collect()} == {2}


def test_communities_are_the_same_on_the_driver_and_in_joins(spark):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b), int(rng.integers(1, 4))) for g in range(6) for a, b in rng.integers(g * 9, g * 9 + 9, (30, 2))] + [(g * 9, (g * 9 + 9) % 54, 1) for g in range(6)]
    df = spark.createDataFrame(edges, "a int, b int, n int")
    small, large = (sorted(map(tuple, C.communities(df, small=n).collect())) for n in (10**6, 0))
    assert small == large and 4 <= len({c for _, c in small}) <= 10


def test_communities_of_shared_groups_are_those_of_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"g{g}", int(v)) for g in range(160) for v in rng.integers(0, 40, rng.integers(1, 5)) * 8 + g % 8]
    rows += [("g1", None), (None, 3), rows[0], ("alone", 7777), *((f"g{g}", 8 * v + 500) for g in range(9) for v in range(5))]
    df = spark.createDataFrame(rows, "g string, v int")
    wanted = sorted(map(tuple, C.communities(G.coread(df, "g", "v")).collect()))
    assert 2 < len({c for _, c in wanted}) < len(wanted) and 7777 not in dict(wanted)
    for counts, at_once, listed in ((10**6, 10**6, 10**3), (10**6, 50, 0), (0, 50, 0), (0, 10**6, 9)):
        for name, n in (("COUNTS", counts), ("AT_ONCE", at_once), ("LISTED", listed)):
            monkeypatch.setattr(C.Shared, name, n)
        assert sorted(map(tuple, C.shared_communities(df, "g", "v").collect())) == wanted
    assert sorted(map(tuple, C.shared_communities(df, "g", "v", small=0).collect())) == wanted
    assert C.shared_communities(df.limit(0), "g", "v").count() == 0
    few = C.shared_communities(df.filter("v < 100"), "g", "v", gamma=1.5, seed=7, levels=1)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, C.communities(G.coread(df.filter("v < 100"), "g", "v"), gamma=1.5, seed=7, levels=1).collect()))


def test_communities_of_alike_nodes_and_weights_are_those_of_their_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    first = [(int(g), int(v)) for v in range(120) for g in rng.integers(0, 12, 3) * 5 + v % 5]
    rows = [(g, v + 1000 * i) for g, v in first for i in range(1 + v % 7)] + [(g, 9000 + g) for g in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "g int, v int")
    wanted = sorted(map(tuple, C.communities(G.coread(df, "g", "v")).collect()))
    assert 2 < len({c for _, c in wanted}) < 60
    for counts, at_once, listed in ((10**6, 10**6, 10**3), (10**6, 50, 0), (0, 50, 0), (0, 10**6, 9)):
        for name, n in (("COUNTS", counts), ("AT_ONCE", at_once), ("LISTED", listed)):
            monkeypatch.setattr(C.Shared, name, n)
        assert sorted(map(tuple, C.shared_communities(df, "g", "v").collect())) == wanted


def test_alike_customers_are_worked_out_once(monkeypatch):
    rng, met, inner = np.random.default_rng(6), [], C.gathered
    first = sorted({(int(g), int(v)) for v in range(200) for g in rng.integers(0, 50, 4)})
    group, node = (np.array(v) for v in zip(*((g, 30 * v + i) for g, v in first for i in range(30)), strict=True))
    monkeypatch.setattr(C.Shared, "COUNTS", 0)
    monkeypatch.setattr(C, "gathered", lambda key, n: met.append(len(key)) or inner(key, n))
    graph = C.Shared(list(range(6000)), group, node, np.ones(len(node), np.int32), 1.0, 42)
    n, to, _ = graph.offers(np.arange(6000), np.ones(6000, bool))
    assert len(n) == 6000 and (n // 30 == to // 30).all()
    assert sum(met) < (np.bincount(group) ** 2).sum() / 10


def test_nodes_that_surely_stay_are_not_asked_again(monkeypatch):
    rng = np.random.default_rng(9)
    group, node = np.array(sorted({(int(g), v) for v in range(900) for g in rng.integers(0, 40, 4) * 5 + v % 5})).T
    asked, inner = [], C.Shared.best
    monkeypatch.setattr(C.Shared, "LISTED", 0)
    graph = C.Shared(list(range(900)), group, node, np.ones(len(node), np.int32), 1.0, 42)
    at = graph.moves()
    monkeypatch.setattr(C.Shared, "best", lambda *a: asked.append(len(a[1])) or inner(*a))
    for c in (at, at, np.where(np.arange(900) < 3, at[899], at)):
        every = np.ones(900, bool)
        known = graph.offers(c, every)
        fresh = C.Shared(list(range(900)), group, node, np.ones(len(node), np.int32), 1.0, 42)
        before, got = len(asked), fresh.offers(c, every)
        assert all((x == y).all() for x, y in zip(known, got, strict=True))
        assert sum(asked[before:]) > 800
        del asked[before:]
    assert sum(asked) < 900


def test_customers_communities_list_no_pairs(spark, monkeypatch):
    from loomgraph.evidence_queries import e_communities

    monkeypatch.setattr(G, "coread", lambda *a: 1 / 0)
    monkeypatch.setattr(C, "coread", lambda *a: 1 / 0, raising=False)
    assert e_communities(spark, "/root/testdata/sf0.001").count() > 20


def test_group_sizes_list_no_pairs(spark, monkeypatch):
    from loomgraph.evidence_queries import e_communities
    from loomgraph.source_queries import e_groups

    d = "/root/testdata/sf0.001"
    sizes = collections.Counter(collections.Counter(r["community"] for r in e_communities(spark, d).collect()).values())
    monkeypatch.setattr(G, "coread", lambda *a: 1 / 0)
    monkeypatch.setattr(C, "coread", lambda *a: 1 / 0, raising=False)
    assert collections.Counter(r["n"] for r in e_groups(spark, d).collect()) == {n: k for n, k in sizes.items() if n > 1}


def test_group_sizes_of_alike_customers_are_worked_out_once(spark, monkeypatch, tmp_path):
    from loomgraph.source_queries import e_groups

    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").crossJoin(spark.range(20))
    o.withColumn("o_custkey", F.col("o_custkey") + 1000 * F.col("id")).drop("id").write.parquet(f"{tmp_path}/orders.parquet")
    met, inner = [], C.gathered
    monkeypatch.setattr(C.Shared, "COUNTS", 0)
    monkeypatch.setattr(C, "gathered", lambda key, n: met.append(len(key)) or inner(key, n))
    rows = e_groups(spark, str(tmp_path)).collect()
    customers = o.select("o_custkey").distinct().count()
    assert sum(r["n"] for r in rows) == 20 * customers and all(r["n"] % 20 == 0 for r in rows)
    pairs = o.groupBy(F.to_date("o_orderdate"), "o_orderpriority").agg((F.count("*") ** 2).alias("n")).agg(F.sum("n")).first()[0]
    assert sum(met) < pairs
