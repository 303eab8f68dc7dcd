"""From a log and a catalog to the evidence tables, one call; and what a shell may ask."""

from __future__ import annotations

import argparse

from pyspark.sql import Column, DataFrame, SparkSession

from loomgraph.operators import bottom as B
from loomgraph.operators import communities as C
from loomgraph.operators import health as H
from loomgraph.plans.lineage import Tables
from loomgraph.sources.shared import stored


def evidence(log: DataFrame, catalog: Tables, service: Column, views: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every table that a log (query, principal, job_type, destination, ts, error, cache_hit, bytes) gives, by name.

    service says which principals are no people; views (query) are definitions from the catalog. Texts are read once,
    shapes traced once; what later tables share is kept in the shared folder until release().
    """
    spark = log.sparkSession
    columns = spark.createDataFrame([(f"{t}.{c}", k) for t, d in catalog.tables.items() for c, k in d.get("columns", {}).items()], "id string, type string")
    known = spark.createDataFrame([(t, d.get("kind", "TABLE").lower(), c, k) for t, d in catalog.tables.items() for c, k in d.get("columns", {}).items()], "table string, kind string, column string, type string")
    out = {"groups": stored(B.groups(log), "groups")}
    out["texts"] = stored(B.shaped(B.texts(out["groups"]), catalog.names, views), "texts")
    out["shapes"] = stored(B.shapes(out["texts"], out["groups"], catalog), "shapes")
    out |= {n: f(out["shapes"]) for n, f in (("refs", B.refs), ("reads", B.reads), ("filters", B.filters), ("writes", B.writes), ("flows", B.flows), ("derived_from", B.derived_from), ("uses_join", B.join_uses))}
    out |= {"ran": stored(B.ran(out["groups"], out["texts"]), "ran"), "loaded": B.loaded(out["groups"])}
    out["filter_values"] = B.filter_values(out["filters"], out["texts"].filter("origin = 'log'"), 10)
    out["write_days"] = B.write_days(out["groups"], out["texts"], out["writes"])
    out["joinkeys"] = stored(B.judged(B.join_keys(out["uses_join"], out["ran"], service), out["flows"], columns), "joinkeys")
    out["variables"] = stored(B.variables(out["joinkeys"]), "variables")
    out["unjoined"] = B.unjoined(columns, out["variables"])
    out["tables"], out["columns"] = B.assets(known, out["refs"], out["reads"])
    out["sandboxes"] = B.sandboxes(out["refs"].select("table"), out["writes"], out["ran"], out["loaded"], service)
    edges = B.unit_edges(B.evidence_sets(out["reads"], out["variables"]), out["flows"], out["variables"])
    units = out["variables"].select("id").distinct().union(out["unjoined"])
    out["unit_edges"] = stored(B.projected(edges, units), "unit_edges")
    out["groups_of_units"] = C.communities(out["unit_edges"].filter("b is not null"), "a", "b", "w")
    out["health"] = H.report(out["shapes"])
    return out


def write(tables: dict[str, DataFrame], path: str) -> list[str]:
    """Write each table as Parquet below path, in place of one that is there; their names."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    return sorted(tables)


def main(argv: list[str] | None = None) -> None:
    """Run a registered query over a folder of tables and show or write its rows; without a query, list them."""
    from loomgraph.queries import QUERIES

    parser = argparse.ArgumentParser(prog="python -m loomgraph.build", description=main.__doc__)
    parser.add_argument("query", nargs="?")
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    parser.add_argument("--to", help="a folder to write all rows to, as Parquet")
    parser.add_argument("--plan", action="store_true", help="show the plan instead")
    said = parser.parse_args(argv)
    if not said.query or not said.folder:
        print("\n".join(sorted(QUERIES)))
        return
    df = QUERIES[said.query](SparkSession.builder.getOrCreate(), said.folder)
    if said.plan:
        df.explain("formatted")
    elif said.to:
        df.write.mode("overwrite").parquet(said.to)
    else:
        df.show(said.rows, truncate=False)


if __name__ == "__main__":
    main()
