"""Sources, statements, bundles, choices and contexts, by hand and against themselves."""

import json

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import answers as A
from loomgraph.operators import bottom as B
from loomgraph.operators import contexts as K
from loomgraph.operators import levels as L
from loomgraph.plans.sqltext import Names
from loomgraph.sources import catalog as C


def test_events_and_their_problems(spark, tmp_path):
    fields = {k: k for k in ("event", "conversation", "order", "time", "channel", "role", "text")}
    rows = [(1, "a", 0, "t", "call", "user", "hi"), (2, "a", 1, "t", "note", "user", "x"), (3, "a", 2, "t", "call", "system", "y"), (4, "b", 0, "t", "call", "bot", None)]
    lines = spark.createDataFrame(rows, "event int, conversation string, order int, time string, channel string, role string, text string")
    C.write_ndjson(lines, f"{tmp_path}/e")
    back = C.read_ndjson(spark, f"{tmp_path}/e", lines.schema)
    turns, skipped = C.read_events(back, fields, {"user": "state", "bot": "action"}, ("note",))
    assert sorted((r["event"], r["kind"]) for r in turns.collect()) == [(1, "state"), (4, "action")]
    assert {(r["why"], r["n"]) for r in skipped.collect()} == {("channel note", 1), ("role system", 1)}
    for bad, why in ((lines.union(lines), "stands 2 times"), (lines.drop("text"), "no field"), (lines.withColumn("event", F.lit(None).cast("int")), "stands")):
        with pytest.raises(ValueError, match=why):
            C.read_events(bad, fields, {"user": "state"})
    with pytest.raises(ValueError, match="neither"):
        C.read_events(lines, fields, {"user": "thing"})
    assert [(r["seq"], r["kind"]) for r in C.live(spark, [("user", "a"), ("x", "b"), ("bot", "c")], {"user": "state", "bot": "action"}).collect()] == [(0, "state"), (2, "action")]


def test_statements_are_checked_before_they_run(spark):
    spark.range(100).createOrReplaceTempView("hundred")
    assert C.dry_run(spark, "SELECT id FROM hundred")["ok"] and "nothing" in C.dry_run(spark, "SELECT nothing FROM hundred")["error"]
    rows, more = C.run(spark, "SELECT id FROM hundred ORDER BY id", 10**9, 7)
    assert [r[0] for r in rows.collect()] == list(range(7)) and more
    assert not C.run(spark, "SELECT id FROM hundred", 10**9, 100)[1]
    with pytest.raises(ValueError, match="scans"):
        C.run(spark, "SELECT id FROM hundred", 1, 7)
    names = Names({}, [(r"^GX_[0-9A-Z]{4}_", "GX_{id}_")], set(), "p")
    said = "SELECT a -- GX_ABCD_x\nFROM `p.s.GX_ABCD_x` t JOIN s.other o ON t.k = o.k"
    assert C.physical_sql(said, {"p.s.GX_{id}_x": "p.s.GX_WXYZ_x"}, names) == said.replace("`p.s.GX_ABCD_x`", "`p.s.GX_WXYZ_x`")
    made = spark.createDataFrame([("t", "b", "2024-01-01"), ("t", "a", "2024-02-01"), ("u", "c", None)], "table string, name string, created string")
    assert dict(map(tuple, C.newest(made).collect())) == {"t": "a", "u": "c"}


def test_catalog_versions_do_not_depend_on_order(spark):
    df = spark.createDataFrame([("t", "a", "int"), ("t", "b", "int")], "table string, column string, type string")
    assert C.catalog_version(df) == C.catalog_version(df.orderBy(F.desc("column")).repartition(3)) != C.catalog_version(df.limit(1))
    assert C.create_views(spark, {"narrow": (df, {"column": "c"})}) == ["narrow"] and spark.table("narrow").columns == ["c"]


def test_ontology_and_glossary(spark, tmp_path):
    (tmp_path / "o.ttl").write_text('@prefix : <http://x.org/v#> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n:Party a owl:Class ; rdfs:label "Party"@en . # all\n:Client a owl:Class ; rdfs:subClassOf :Party , :Thing ; rdfs:comment "one; who, pays." .\n:Thing a owl:Class .\n')
    classes, above = C.ontology(spark, str(tmp_path / "o.ttl"))
    assert sorted(map(tuple, classes.collect())) == [("ontology:Client", "Client", "one; who, pays."), ("ontology:Party", "Party", ""), ("ontology:Thing", "Thing", "")]
    assert sorted(map(tuple, above.collect())) == [("ontology:Client", "ontology:Party"), ("ontology:Client", "ontology:Thing")]
    with pytest.raises(ValueError, match="blank"):
        C.turtle(":a :b [ :c :d ] .")
    (tmp_path / "g.json").write_text(json.dumps({"glossary": [{"id": "t1", "name": "Term", "definition": "d", "status": "approved", "columns": ["a.b", "a.c"]}], "assets": [{"table": "a", "description": "x", "certified": True, "columns": {"b": "y"}}]}))
    concepts, bindings, told = C.glossary(spark, str(tmp_path / "g.json"))
    assert concepts.first()["id"] == "catalog:t1" and bindings.count() == 2 and sorted(r["name"] for r in told.collect()) == ["a", "a.b"]


def test_bundles(tmp_path):
    one = {"id": "1", "kind": "measure", "name": "Total: Sales", "expression": "SUM(orders.v)", "tables": ["w.s.orders"], "filters": ["orders.f = 1"], "grain": ["orders.d"], "area": "Sales"}
    n = C.write_bundle(str(tmp_path), [one, one | {"id": "2"}, one | {"id": "3", "kind": "population", "name": None, "area": None}], [{"id": "w.s.orders", "text": "x"}])
    assert C.check_bundle(str(tmp_path)) == {"documents": n, "untyped": [], "broken": []}
    said = (tmp_path / "computations/sales/total-sales.md").read_text()
    assert "SELECT orders.d, SUM(orders.v)\nFROM `w.s.orders` AS orders\nWHERE orders.f = 1\nGROUP BY 1" in said
    (tmp_path / "tables/w-s-orders.md").unlink()
    assert len(C.check_bundle(str(tmp_path))["broken"]) == 3
    assert C.settings({"a": {"b": 1, "c": 2}}, {"a": {"b": 5}}) == {"a": {"b": 5, "c": 2}}
    with pytest.raises(KeyError):
        C.settings({"a": 1}, {"x": 2})


def test_round_robin():
    t = lambda groups, used, frozen=False, cols=1: {"groups": groups, "used": used, "frozen": frozen, "cols": range(cols)}
    tables = {"a": t(["g"], 9), "b": t(["g", "h"], 8), "c": t(["h"], 1), "d": t(["h"], 7, True), "e": t(["g"], 2)}
    assert A.round_robin(["g", "h"], tables, 3) == ["a", "b", "e"]
    assert A.round_robin(["h", "g"], tables, 9) == ["b", "a", "c", "e", "d"]


def test_a_batch_of_contexts_is_each_alone(spark):
    model = K.Model((K.Kind("C", "c", "id"), K.Kind("O", "o", "id", "day"), K.Kind("N", "n", "id")), (K.Link("BY", "O", "c", "C"), K.Link("IN", "C", "n", "N")))
    held = {
        "c": spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, n int"),
        "o": spark.createDataFrame([(i, 1 + i % 3, f"2024-01-{1 + i % 20:02d}") for i in range(40)], "id int, c int, day string"),
        "n": spark.createDataFrame([(7,), (8,)], "id int"),
    }
    assert model.problems({t: d.columns for t, d in held.items()}) == [] and len(model.problems({"c": ["id"]})) == 5
    assert model.restricted({"c", "o"}).links == (model.links[0],)
    reads = K.template(model, "C", 2)
    assert [(r.hop, r.link, r.many) for r in reads] == [(1, "BY", True), (1, "IN", False)] and K.digest(reads, 3, 1) != K.digest(reads, 4, 1)

    def of(keys):
        c = K.contexts(model, held.__getitem__, "C", spark.createDataFrame([(k,) for k in keys], "key int"), reads, 3, F.lit("2024-01-03").cast("date"))
        return [sorted(map(tuple, d.collect())) for d in (c.nodes, c.edges, c.reads)]

    alone = [of([k]) for k in (1, 2, 3)]
    assert of([1, 2, 3, 99, None]) == [sorted(sum(x, [])) for x in zip(*alone)]
    assert ("1", "BY", 3, True) in alone[0][2] and ("3", "C", "3", 0) in alone[2][0]


def test_answers_that_say_the_same():
    rows = [("a", 1.0, 0.25), ("b", 2.0, 0.5)]
    assert A.same_answer(rows, [(0.5, "B ", 2.0004), (0.25, "A", 1)]) == "equal"
    assert A.same_answer(rows, [("a", 1, 25), ("b", 2, 50)]) == "scaled"
    assert A.same_answer(rows, [("a", "x", 1), ("a", "y", 0.25), ("b", "x", 2), ("b", "y", 0.5)]) == "melted"
    assert A.same_answer(rows, [("a", 1, 0.25), ("b", 3, 0.5)]) is None and A.same_answer([], []) == "equal"


def test_small_pieces(spark):
    assert A.request_shape({"b": [{"value": 3, "column": "x"}], "a": "2024-01-01", "limit": 5, "c": ""}) == {"a": "?", "b": [{"column": "x"}]}
    assert A.asked_id(" q ", "d", "w", []) == A.asked_id("q", "d", "w", []) != A.asked_id("q", "e", "w", [])
    assert A.first_that_stands([("a", lambda: None), ("b", lambda: 1 / 0), ("c", lambda: 5), ("d", lambda: 6)])[:2] == ("c", 5)
    assert "seven sixty five" in L.amount_forms(7.65) and "seven dollars and sixty five cents" in L.amount_forms(7.65) and "$42" in L.amount_forms(42) and "a hundred seventeen dollars" in L.amount_forms(117)
    assert K.answerable({"anchors": [1], "tables": ["o"], "period": ("2024-01-01", "x")}, {"anchor": 1, "tables": ["o"], "until": None, "since": "2023-01-01", "capped": []}, "2024") is None
    assert "whole" in K.answerable({"anchors": [1], "tables": ["o"], "period": None}, {"anchor": 1, "tables": ["o"], "until": None, "since": "2023-01-01", "capped": ["o"]}, "2024")
    assert K.distinct_labels(["a.dim_orders", "b.dim_orders", "b.fct_sales"]) == {"a.dim_orders": "AOrder", "b.dim_orders": "BOrder", "b.fct_sales": "Sale"}
    v = C.embedded(spark.createDataFrame([("to be or not to be",), (None,)], "t string"), "t", 8).collect()
    assert abs(sum(x * x for x in v[0]["embedding"]) - 1) < 1e-9 and set(v[1]["embedding"]) == {0.0}


def test_fold_never_chains(spark):
    rows = [("s", "a", 9, [1.0, 0.0]), ("s", "b", 5, [0.9, 0.436]), ("s", "c", 4, [0.62, 0.785]), ("x", "d", 1, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "kind string, key string, size int, v array<double>")
    assert {r["key"]: r["kept"] for r in L.fold(df, "kind", "key", "size", "v", 0.85).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_suspects_are_joins_that_production_keeps_apart():
    key = lambda k, l, r, production=False, identity=True: {"key": k, "l": l, "r": r, "production": production, "identity": identity}
    columns = {"t.map": ["t.map.cif", "t.map.ucic"]}
    keys = [key("p1", "t.a.cif", "t.map.cif", True), key("p2", "t.b.ucic", "t.map.ucic", True), key("h1", "t.a.cif", "t.b.ucic"), key("h2", "t.c.cif", "t.b.ucic"), key("h3", "t.c.cif", "t.a.cif")]
    assert B.suspects(keys, [], columns) == {"h1": ["t.map"], "h2": ["t.map"]}
    assert B.suspects(keys[:2] + [key("h4", "t.c.x", "t.d.x")], [("t.c.x", "t.a.cif")], columns) == {}


def test_climb_stops_where_nothing_shrinks(spark):
    rows = [("s", f"{g}{i}", [1.0 if j == g else 0.05 * i for j in range(4)], 1.0) for g in range(4) for i in range(4)]
    df = spark.createDataFrame(rows, "kind string, id string, v array<double>, w double")
    levels = L.climb(df, "kind", "id", "v", "w", 3, 0.5, 5, 2, 0.9)
    assert levels and levels[0].groupBy("parent").count().count() == 4
    assert L.climb(df.limit(2), "kind", "id", "v", "w", 3, 0.5, 5, 2, 0.9) == []


def test_a_log_gives_all_evidence(spark, tmp_path, capsys):
    from loomgraph import build, log_queries

    data = "/root/testdata/sf0.001"
    views = spark.createDataFrame([(log_queries.VIEW,)], "query string")
    found = build.evidence(log_queries.log(spark, data), log_queries.CATALOG, log_queries.service(), views)
    names = build.write({k: found[k] for k in ("refs", "joinkeys", "unit_edges", "health", "groups_of_units")}, str(tmp_path))
    assert names == ["groups_of_units", "health", "joinkeys", "refs", "unit_edges"]
    again = spark.read.parquet(f"{tmp_path}/joinkeys")
    assert sorted(r["key"] for r in again.collect()) == sorted(log_queries.KEYS)
    assert {"w.sales.customer", "w.sales.orders"} <= {r["table"] for r in spark.read.parquet(f"{tmp_path}/refs").collect()}
    build.main([])
    build.main(["h_is_unique", data, "--rows", "2"])
    assert "i_totals" in capsys.readouterr().out
