"""Every registered query of the package's own operators against its SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

from loomgraph.plans.requests import Derived, Dimension, Filter, Join, Layout, Measure, Refused, Request, answer, options, plan, unsaid, with_weeks
from loomgraph.queries import QUERIES, SQL, STAR

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ONE = Measure("n", "orders", "count")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, rel = QUERIES[name](spark, DATA), con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert ours == theirs


def test_routes_never_multiply(spark):
    at = STAR.over(spark, DATA)
    assert [h.right for h in at.route("lineitem", "region")] == ["orders", "customer", "nation", "region"]
    assert at.route("customer", "orders") is None and at.route("orders", "orders") == []


@pytest.mark.parametrize(
    ("req", "why"),
    [
        (Request((ONE, ONE)), "one name"),
        (Request((Measure("n", "orders", "median", "o_totalprice"),)), "no aggregate median"),
        (Request((ONE,), (), (Dimension("d", "orders.o_orderdate", "decade"),)), "no grain"),
        (Request((ONE,), (), (), (Filter("orders.o_orderstatus", "~", "O"),)), "no operator"),
        (Request((ONE,), (), (), (Filter("orders.o_orderstatus", "in", ()),)), "no values"),
        (Request((ONE,), (), (Dimension("d", "orders.o_nothing"),)), "lacks a column"),
        (Request((ONE,), (), (Dimension("d", "nowhere.o_nothing"),)), "no table"),
        (Request((ONE,), (), (Dimension("d", "o_orderdate"),)), "which table"),
        (Request((ONE,), (), (Dimension("d", "lineitem.l_quantity"),)), "without multiplying"),
        (Request((ONE,), (), (), (Filter("orders.o_totalprice", ">", "much"),)), "no number"),
        (Request((ONE,), (Derived("r", "ratio", "n", "m"),)), "isn't asked for"),
        (Request((Measure("n", "orders", "sum", "o_totalprice", (), "o_custkey", "mode"),)), "no way to combine"),
        (Request((ONE,), (), (), (), None, (Filter("m", ">", 1),)), "no measure"),
        (Request((ONE,), (), (), (), None, (), (("m", True),)), "isn't in it"),
        (Request((Measure("n", computation="unheard of"),)), "no measure is called"),
        (Request(), "nothing"),
    ],
)
def test_refusals(spark, req, why):
    with pytest.raises(Refused, match=why):
        answer(spark, DATA, STAR, req)


def test_a_key_held_twice_is_no_dimension(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (1, 10), (2, 10) AS t(f_id, f_d)").write.parquet(f"{tmp_path}/f.parquet")
    spark.sql("SELECT * FROM VALUES (10, 'x'), (10, 'y') AS t(d_id, d_name)").write.parquet(f"{tmp_path}/d.parquet")
    req = Request((Measure("n", "f", "count"),), (), (Dimension("name", "d.d_name"),))
    with pytest.raises(Refused, match="without multiplying"):
        answer(spark, str(tmp_path), Layout([Join("f", "f_d", "d", "d_id")]), req)


def test_outer_joins_keep_rows_without_a_match(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES (1, 10, 5), (2, 99, 6) AS t(f_id, f_d, v)").write.parquet(f"{tmp_path}/f.parquet")
    spark.sql("SELECT * FROM VALUES (10, 'x', 7) AS t(d_id, d_name, v)").write.parquet(f"{tmp_path}/d.parquet")
    req = Request((Measure("n", "f", "count"), Measure("v", "f", "sum", "v")), (), (Dimension("name", "d.d_name"),), (Filter("f.v", ">", 1),))
    for outer, want in ((True, {("x", 1, 5), (None, 1, 6)}), (False, {("x", 1, 5)})):
        assert {tuple(r) for r in answer(spark, str(tmp_path), Layout([Join("f", "f_d", "d", "d_id", outer)]), req).collect()} == want


def test_what_a_request_leaves_unsaid(spark):
    req = Request((Measure("value", computation="open value"), ONE), (), (Dimension("segment", "customer.c_mktsegment"),))
    values = {("customer", "c_mktsegment"): ["BUILDING", "MACHINERY"], ("orders", "o_orderstatus"): ["O", "F"], ("orders", "o_orderpriority"): ["1-URGENT"]}
    notes = unsaid(req, STAR, "How many urgent orders came from building firms? 1-urgent ones, please", values)
    assert [n for n in notes if "BUILDING" in n] and [n for n in notes if "1-URGENT" in n] and len(notes) == 2
    assert "only groups by" in next(n for n in notes if "BUILDING" in n)
    assert unsaid(req, STAR, "building and machinery alike, 1-urgent", {("customer", "c_mktsegment"): values["customer", "c_mktsegment"]}) == []
    weekly = Request((ONE,), (), (Dimension("w", "orders.o_orderdate", "week"),))
    assert with_weeks(weekly, {("orders", "o_orderdate"): "week_monday"}, "by week").dimensions[0].grain == "week_monday"
    assert with_weeks(weekly, {("orders", "o_orderdate"): "week_monday"}, "weeks from Sunday").dimensions[0].grain == "week"
    said = options(STAR.over(spark, DATA))
    assert any(x.startswith("orders: o_orderkey") for x in said) and any("population rich" in x for x in said)
    described = plan(Request((ONE,), (), (Dimension("r", "region.r_name"),)), STAR.over(spark, DATA))
    assert described.used() == ["customer", "nation", "orders", "region"] and "inner join region" in described.described()[0]
