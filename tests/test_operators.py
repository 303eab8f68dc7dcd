"""Operators that SQL can't express, and odd rows, against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import answers as A
from loomgraph.operators import graph as G
from loomgraph.operators import process as P
from loomgraph.operators import ranks as R

TALK = [(c, t, r, f"{c % 3} {t * r_ % 4}") for c in range(40) for t, (r, r_) in enumerate(itertools.islice(itertools.cycle([("user", 1), ("assistant", 3)]), c % 5 + 1))]


def test_absorbing_chain_solves_its_equations(spark):
    steps = P.turns(spark.createDataFrame(TALK, "conv_id int, turn int, role string, text string"))
    ours = {r["element"]: r["chance"] for r in P.absorbing_chain(steps).collect()}
    rows = sorted((r["conv_id"], r["turn"], r["kind"], r["digest"], r["element"]) for r in steps.collect())
    names = sorted({r[4] for r in rows})
    at = {n: i for i, n in enumerate(names)}
    move, fin, good = np.zeros((len(names),) * 2), np.zeros(len(names)), np.zeros(len(names))
    talks = [list(g) for _, g in itertools.groupby(rows, key=lambda r: r[0])]
    for talk in talks:
        for x, y in itertools.pairwise(talk):
            move[at[x[4]], at[y[4]]] += x[2] != y[2]  # a turn after one of its own kind is no transition
        fin[at[talk[-1][4]]] += 1
        good[at[talk[-1][4]]] += talk[-1][3][1] < "8"
    base = good.sum() / len(talks)
    left = np.diag(move.sum(1) + fin) - move
    want = np.linalg.solve(left, fin * (good + 5 * base) / (fin + 5))
    assert ours.keys() == set(names)
    assert all(abs(ours[n] - want[at[n]]) < 1e-6 for n in names)


def test_absorbing_chain_of_nothing(spark):
    steps = P.turns(spark.createDataFrame([], "conv_id int, turn int, role string, text string"))
    assert P.absorbing_chain(steps).collect() == []


def made(spark, *talks):
    """Steps of conversations, each a text of one letter a turn: upper case for actions, lower case for states; x1 ends good."""
    rows = [(c, i, "action" if x.isupper() else "state", "00" if good else "0f", x) for c, (talk, good) in enumerate(talks) for i, x in enumerate(talk)]
    return spark.createDataFrame(rows, "conv_id int, turn int, kind string, digest string, element string")


@pytest.mark.parametrize("small", [5000, 1])
def test_absorbing_chain_by_hand(spark, small):
    chance = lambda *talks: {r["element"]: round(r["chance"], 6) for r in P.absorbing_chain(made(spark, *talks), prior=0.0, small=small).collect()}
    assert chance(("AsXg", True), ("AsXb", False)) == {"A": 0.5, "s": 0.5, "X": 0.5, "g": 1.0, "b": 0.0}
    assert chance(("AsXsXs", True), ("As", True)) == {"A": 1.0, "s": 1.0, "X": 1.0}
    assert chance(("ABg", True), ("Ab", False)) == {"A": 0.0, "B": 1.0, "g": 1.0, "b": 0.0}  # A to B is no transition


def test_an_unsettled_chain_is_an_error(spark):
    for small in (5000, 1):
        with pytest.raises(ValueError, match="not settled"):
            P.absorbing_chain(made(spark, ("sXsXsXsXsXsX", True), ("sXsXsXsXsXsXs", False)), rounds=1, small=small)


def test_running_totals_with_groups_nulls_and_few_values(spark):
    rows = [(g, v, n) for g in ("a", "b", None) for v, n in ((None, 2), (1.0, 3), (1.5, 1), (9.0, 4))]
    df = spark.createDataFrame(rows, "g string, v double, n long")
    got = {(r["g"], r["v"]): r["below"] for r in R.running(df, "v", "n", ["g"]).collect()}
    assert got == {(g, v): b for g in ("a", "b", None) for v, b in ((None, 0), (1.0, 2), (1.5, 5), (9.0, 6))}
    assert R.running(df.filter("false"), "v", "n").collect() == []


def test_components_of_a_chain_and_null_edges(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (None, 3), (7, 7)]
    got = dict(tuple(r) for r in G.components(spark.createDataFrame(edges, "a int, b int")).collect())
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert G.components(spark.createDataFrame([], "a int, b int")).collect() == []


def test_nearest_in_blocks_is_nearest(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    whole = sorted(tuple(r) for r in G.nearest(df, df.filter("vec_id < 9"), 3).collect())
    monkeypatch.setattr(G, "BLOCK", 2)
    assert sorted(tuple(r) for r in G.nearest(df, df.filter("vec_id < 9"), 3).collect()) == whole
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(9):
        score = m @ m[q]
        score[q] = -2
        assert [r[1] for r in sorted(whole, key=lambda r: r[3]) if r[0] == q] == np.argsort(-score)[:3].tolist()


def test_sets_without_rare_items_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    held = {f"k{i}": {f"i{v}" for v in rng.integers(0, 12, rng.integers(1, 9))} for i in range(70)}
    rows = [(k, v) for k, s in held.items() for v in (*s, None)] + [(None, "i1"), ("k0", sorted(held["k0"])[0])]
    wanted = {(a, b, len(held[a] & held[b]) / len(held[a] | held[b])) for a in held for b in held if a < b}
    monkeypatch.setattr(A, "SETS", 20, raising=False)
    for least in (0.25, 0.5, 1.0):
        df = A.jaccard_pairs(spark.createDataFrame(rows, "k string, v string"), "k", "v", least)
        got = [tuple(r) for r in df.collect()]
        assert sorted(got) == sorted(w for w in wanted if w[2] >= least) and got
        assert "array_intersect" not in df._jdf.queryExecution().toString()
    rare = spark.createDataFrame([(i, v) for i in range(400) for v in (i // 2, -i - 1)], "k int, v int")
    assert sorted(map(tuple, A.jaccard_pairs(rare, "k", "v", 0.3).collect())) == [(i, i + 1, 1 / 3) for i in range(0, 400, 2)]
    assert A.jaccard_pairs(rare.limit(0), "k", "v", 0.3).collect() == []


def test_fingerprints(spark):
    same = ["SELECT a, 1 FROM t -- x\nWHERE b = 'it''s';", "select a,2\nfrom T /* y */ where B='z'"]
    other = ["SELECT a, 1 FROM t WHERE c = 'z'", "SELECT a FROM t", None]
    df = spark.createDataFrame([(q,) for q in same + other], "q string").select(T.fingerprint(F.col("q")).alias("f"))
    got = [r["f"] for r in df.collect()]
    assert got[0] == got[1] and len(set(got)) == 4 and got[-1] is None
