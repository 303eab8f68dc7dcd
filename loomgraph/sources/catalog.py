"""Catalogs, logs and glossaries from files; statements checked before they run; bundles of documents."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.plans import sqltext as S
from loomgraph.plans.lineage import Tables

# ---------------------------------------------------------------- records in files


def write_ndjson(rows: DataFrame, path: str) -> None:
    """One JSON object a line, gzipped, in as many files as rows has partitions; null fields are left out."""
    rows.write.mode("overwrite").option("compression", "gzip").json(path)


def read_ndjson(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_events(lines: DataFrame, fields: dict[str, str], kinds: dict[str, str], skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(turns, skipped (why, n)) of lines whose columns `fields` names: event, conversation, order, time, channel, role, text.

    kinds says which role is a state and which an action. Lines of a channel in skip, or of another role, are counted and
    left out. A field that lines lack, a null or repeated event and a kind that is neither are errors; repeated events
    are found by grouping their ids alone.
    """
    if bad := sorted(k for k in kinds.values() if k not in ("state", "action")):
        raise ValueError(f"{bad[0]!r} is neither state nor action")
    if lost := [c for c in fields.values() if c not in lines.columns]:
        raise ValueError(f"lines have no field {lost[0]!r}")
    named = lines.select(*[F.col(c).alias(k) for k, c in fields.items()])
    twice = named.groupBy("event").agg(F.count("*").alias("n")).filter("n > 1 or event is null").limit(1).collect()
    if twice:
        raise ValueError(f"event {twice[0]['event']!r} stands {twice[0]['n']} times")
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(kinds.items()) for x in kv]), F.col("role"))
    why = F.when(F.col("channel").isin(list(skip)), F.concat(F.lit("channel "), "channel")).when(kind.isNull(), F.concat(F.lit("role "), F.coalesce("role", F.lit("")))).alias("why")
    told = named.select("*", kind.alias("kind"), why)
    turns = told.filter("why is null").select("event", "conversation", F.col("order").cast("long").alias("seq"), "time", "channel", "role", "kind", "text")
    return turns, told.filter("why is not null").groupBy("why").agg(F.count("*").alias("n"))


def live(spark: SparkSession, lines: list[tuple[str, str]], kinds: dict[str, str], conversation: str = "live") -> DataFrame:
    """A conversation under way, (role, text) a line, as turns."""
    rows = [(f"{conversation}:{i}", conversation, i, None, "live", role, kinds.get(role), text) for i, (role, text) in enumerate(lines)]
    return spark.createDataFrame(rows, "event string, conversation string, seq long, time string, channel string, role string, kind string, text string").filter("kind is not null")


def capped(rows: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """(the first n rows, whether there were more); one row more is read, not all."""
    held = rows.limit(n + 1)
    return held.limit(n), held.count() > n


# ---------------------------------------------------------------- catalogs


def folder_catalog(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """(table, column, ordinal, type, kind) of the Parquet tables of a folder, from their schemas alone."""
    rows = [(n, c, i, k, "table") for n in names for i, (c, k) in enumerate(spark.read.parquet(f"{folder}/{n}.parquet").dtypes)]
    return spark.createDataFrame(rows, "table string, column string, ordinal int, type string, kind string")


SHARD = r"^(.*_)(\d{8}|\d{6})$"


def shard_families(physical: DataFrame) -> DataFrame:
    """(dataset, prefix, shards): prefixes that two tables or more of a dataset (dataset, name) share before a date."""
    each = physical.select("dataset", "name").distinct().filter(F.col("name").rlike(SHARD)).select("dataset", F.regexp_extract("name", SHARD, 1).alias("prefix"), "name")
    return each.groupBy("dataset", "prefix").agg(F.count("*").alias("shards")).filter("shards > 1")


def canonical_tables(physical: DataFrame, rules: list[tuple[str, str]], aliases: DataFrame) -> DataFrame:
    """(table, dataset, name, kind): physical tables (dataset, name, kind) under the names they are known by.

    aliases (dataset, logical): others are left out. Shards of a family are one wildcard table; rules (pattern, to) take
    out what changes from run to run.
    """
    fam = shard_families(physical).select(F.col("dataset").alias("d"), "prefix")
    out = physical.join(F.broadcast(aliases), "dataset").withColumn("p", F.regexp_extract("name", SHARD, 1))
    out = out.join(fam, (F.col("dataset") == F.col("d")) & (F.col("p") == F.col("prefix")), "left")
    clean: Column = F.col("name")
    for pattern, to in rules:
        clean = F.regexp_replace(clean, pattern, to.replace("\\", "\\\\").replace("$", "\\$"))
    short = F.when(F.col("prefix").isNotNull(), F.concat("prefix", F.lit("*"))).otherwise(clean)
    kind = F.when(F.col("prefix").isNotNull(), "wildcard").when(F.upper("kind") == "BASE TABLE", "table").otherwise(F.lower("kind"))
    return out.select(F.concat_ws(".", "logical", short).alias("table"), "dataset", "name", kind.alias("kind"))


def catalog_version(tables: DataFrame) -> str:
    """A version that is equal for equal catalogs (table, column, type), in any order of rows: a hash of their sorted hashes' sum."""
    one = F.conv(F.substring(F.sha2(F.to_json(F.struct("table", "column", "type")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n, total = tables.select("table", "column", "type").distinct().agg(F.count("*"), F.sum(one)).first()
    return "cat-" + hashlib.sha256(f"{n}/{total}".encode()).hexdigest()[:12]


def create_views(spark: SparkSession, tables: dict[str, tuple[DataFrame, dict[str, str]]]) -> list[str]:
    """A view for each {name: (rows, {column: as})}: only those columns, under those names."""
    for name, (rows, columns) in tables.items():
        rows.select(*[F.col(c).alias(a) for c, a in columns.items()]).createOrReplaceTempView(name)
    return sorted(tables)


# ---------------------------------------------------------------- statements


def dry_run(spark: SparkSession, sql: str) -> dict:
    """{ok, bytes} or {ok, error}: analysed and optimised, not run; bytes as the optimiser estimates what is scanned."""
    try:
        plan = spark.sql(sql)._jdf.queryExecution().optimizedPlan()
    except PySparkException as e:
        return {"ok": False, "error": str(e).split("\n")[0]}
    leaves = plan.collectLeaves()
    return {"ok": True, "bytes": sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))}


def run(spark: SparkSession, sql: str, most_bytes: int, most_rows: int) -> tuple[DataFrame, bool]:
    """(rows, whether there were more) of a query that scans no more than most_bytes; ValueError otherwise, before it runs."""
    told = dry_run(spark, sql)
    if not told["ok"]:
        raise ValueError(told["error"])
    if told["bytes"] > most_bytes:
        raise ValueError(f"it scans {told['bytes']} bytes, more than {most_bytes}")
    return capped(spark.sql(sql), most_rows)


def physical_sql(sql: str, deployed: dict[str, str], names: S.Names) -> str:
    """The text with tables under the names they are deployed by; all else, blanks and comments too, as it was."""
    found, out, at, i = S.tokens(sql), [], 0, 0
    while i < len(found):
        t, j = found[i], i + 1
        if t.kind in ("path", "id"):
            while j + 1 < len(found) and found[j].text == "." and found[j + 1].kind in ("path", "id"):
                j += 2
            whole = ".".join(x.text.strip("`") for x in found[i:j:2])
            if "." in whole and (to := deployed.get(names.canonical(whole))):
                out += [sql[at : t.at], f"`{to}`"]
                at = found[j - 1].at + len(found[j - 1].text)
        i = j
    return "".join([*out, sql[at:]])


def newest(generations: DataFrame) -> DataFrame:
    """(table, physical): of a table's generations (table, name, created) the last made; equal ones by name."""
    return generations.groupBy("table").agg(F.max_by("name", F.struct(F.coalesce(F.col("created").cast("string"), F.lit("")), "name")).alias("physical"))


def explained(spark: SparkSession, sql: str, catalog: Tables) -> list[str]:
    """What is wrong with a text, the nearest reason first: it can't be read, names what isn't there, or the engine refuses it."""
    from loomgraph.plans.lineage import read

    record = read(sql, catalog)
    if record["status"] == "error":
        return [f"unreadable: {record['error']}"]
    if record["unresolved"]:
        return [f"{u['kind']} {u['name']}: {u['reason']}" for u in record["unresolved"]]
    told = dry_run(spark, sql)
    return [] if told["ok"] else [f"refused: {told['error']}"]


def expanded(refs: DataFrame, views: DataFrame, depth: int) -> DataFrame:
    """(id, table): what each statement (id, table) reads once views (view, table) are replaced by what they read, `depth` deep at most."""
    step = views.select(F.col("view").alias("v"), F.col("table").alias("t")).distinct()
    out = refs.select("id", "table").distinct()
    for _ in range(depth):
        out = out.join(step, F.col("table") == F.col("v"), "left").select("id", F.coalesce("t", "table").alias("table")).distinct()
    return out


def crosscheck(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, missed, extra): statements whose tables (id, table) two readers see differently, and the tables that differ."""
    a, b = (d.select("id", "table").distinct().withColumn(s, F.lit(True)) for d, s in ((ours, "x"), (theirs, "y")))
    both = a.join(b, ["id", "table"], "full").filter("x is null or y is null")
    side = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col(c).isNull(), F.col("table")))), ",")
    return both.groupBy("id").agg(side("x").alias("missed"), side("y").alias("extra"))


# ---------------------------------------------------------------- designed terms


def glossary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts (id, name, definition, status), bindings (id, col), descriptions (name, text, certified)) of a JSON catalog.

    The file has `glossary`, terms with the columns they mean, and `assets`, tables with descriptions of them and of
    their columns.
    """
    kind = "struct<glossary:array<struct<id:string,name:string,definition:string,status:string,columns:array<string>>>,assets:array<struct<table:string,description:string,certified:boolean,columns:map<string,string>>>>"
    held = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("j"))
    terms = held.select(F.explode("j.glossary").alias("t"))
    concepts = terms.select(F.concat(F.lit("catalog:"), "t.id").alias("id"), "t.name", "t.definition", "t.status")
    bindings = terms.select(F.concat(F.lit("catalog:"), "t.id").alias("id"), F.explode("t.columns").alias("col"))
    assets = held.select(F.explode("j.assets").alias("a"))
    tables = assets.select(F.col("a.table").alias("name"), F.col("a.description").alias("text"), "a.certified")
    columns = assets.select("a.table", F.explode("a.columns").alias("c", "text")).select(F.concat_ws(".", "table", "c").alias("name"), "text", F.lit(None).cast("boolean").alias("certified"))
    return concepts, bindings, tables.unionByName(columns)


STATEMENT = re.compile(r'"""(?:[^"\\]|\\.|"(?!""))*"""|"(?:[^"\\]|\\.)*"|<[^>]*>|[^\s;,."<>\[\]]+|[;,.\[\]]')


def turtle(text: str) -> list[tuple[str, str, str]]:
    """The triples of a Turtle text: prefixes, `a`, lists by ; and , , names, and literals without their language or type.

    Blank nodes and collections aren't read: ValueError.
    """
    prefixes, out, parts, subject, verb = {}, [], [], None, None
    lines = re.sub(r"(?m)(^|\s)#[^\n]*$", r"\1", text)
    # a dot inside a prefixed name belongs to it; one before a blank ends the statement
    for t in STATEMENT.findall(re.sub(r"\.(?=\s|$)", " . ", lines)):
        if t in "[]" or t in ("(", ")"):
            raise ValueError("blank nodes and collections aren't read")
        parts.append(t)

    def name(t: str) -> str:
        if t.startswith('"'):
            cut = 3 if t.startswith('"""') else 1
            return re.sub(r"\\(.)", r"\1", t[cut:-cut])
        if t.startswith("<"):
            return t[1:-1]
        if t == "a":
            return "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
        p, colon, rest = t.partition(":")
        return prefixes[p] + rest if colon and p in prefixes else t

    i = 0
    while i < len(parts):
        t = parts[i]
        if t.lower() in ("@prefix", "prefix"):
            prefixes[parts[i + 1].rstrip(":")] = parts[i + 2][1:-1]
            i += 4 if i + 3 < len(parts) and parts[i + 3] == "." else 3
        elif t == ".":
            subject = verb = None
            i += 1
        elif t == ";":
            verb = None
            i += 1
        elif t == ",":
            i += 1
        elif subject is None:
            subject, i = name(t), i + 1
        elif verb is None:
            verb, i = name(t), i + 1
        else:
            if not (t.startswith("@") or t.startswith("^^")):
                out.append((subject, verb, name(t)))
            i += 1
    return out


def ontology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(classes (id, name, definition), broader (id, above)) of a Turtle file, which fits a task as its authors do."""
    found = turtle("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    last = lambda x: re.split(r"[#/]", x)[-1]
    said: dict[tuple[str, str], str] = {}
    for s, p, o in found:
        said.setdefault((s, last(p)), o)
    classes = sorted({s for s, p, o in found if last(p) == "type" and last(o) == "Class"})
    rows = [(f"ontology:{last(c)}", said.get((c, "label"), last(c)), said.get((c, "definition"), said.get((c, "comment"), ""))) for c in classes]
    above = [(f"ontology:{last(s)}", f"ontology:{last(o)}") for s, p, o in found if last(p) == "subClassOf" and s in classes]
    return spark.createDataFrame(rows, "id string, name string, definition string"), spark.createDataFrame(above, "id string, above string")


# ---------------------------------------------------------------- bundles of documents


def slug(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-") or "untitled"


def document(meta: dict, body: str) -> str:
    """A document with its properties before it, each as JSON, which YAML reads alike."""
    return "---\n" + "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in meta.items()) + "---\n\n" + body.rstrip() + "\n"


def write_bundle(root: str, computations: list[dict], tables: list[dict]) -> int:
    """Write a document for each computation (by area) and table, and indexes of them; how many documents there are.

    What is written was chosen by people and is small; it is gathered before this is called.
    """
    from loomgraph.operators.answers import runnable

    top, used, paths = Path(root), Counter(), {t["id"]: f"tables/{slug(t['id'])}.md" for t in tables}
    areas: dict[str, list[str]] = {}
    for c in sorted(computations, key=lambda c: c["id"]):
        area = c.get("area") or "Unassigned"
        base = f"computations/{slug(area)}/{slug(c.get('name') or c['expression'])}"
        used[base] += 1
        path = base + (f"-{used[base]}" if used[base] > 1 else "") + ".md"
        body = f"# Computation\n\n```sql\n{runnable(c) if len(c['tables']) == 1 else c['expression']}\n```\n\n# Tables\n\n" + "\n".join(f"- [{t}](/{paths[t]})" for t in c["tables"] if t in paths)
        meta = {"type": "Computation", "title": c.get("name") or c["expression"][:60], "kind": c["kind"], "status": c.get("status", "draft"), "tags": [c["kind"], slug(area)]}
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_text(document(meta, body), encoding="utf-8")
        areas.setdefault(area, []).append(f"* [{meta['title']}](/{path})")
    for t in tables:
        (top / paths[t["id"]]).parent.mkdir(parents=True, exist_ok=True)
        (top / paths[t["id"]]).write_text(document({"type": "Table", "title": t["id"]}, t.get("text", "")), encoding="utf-8")
    for area, lines in areas.items():
        (top / f"computations/{slug(area)}/index.md").write_text("\n".join([f"# {area}", "", *lines]) + "\n", encoding="utf-8")
    (top / "index.md").write_text("\n".join(["# Areas", "", *[f"* [{a}](/computations/{slug(a)}/index.md)" for a in sorted(areas)]]) + "\n", encoding="utf-8")
    return len(computations) + len(tables)


def check_bundle(root: str) -> dict:
    """{documents, untyped, broken}: documents without a type, and links that lead nowhere."""
    top = Path(root)
    files = sorted(top.rglob("*.md"))
    documents = [p for p in files if p.name != "index.md"]
    untyped = [str(p.relative_to(top)) for p in documents if not re.match(r"---\n(?:.*\n)*?type: \S", p.read_text(encoding="utf-8"))]
    broken = [f"{p.relative_to(top)} -> {x}" for p in files for x in re.findall(r"\]\((/[^)#\s]+)\)", p.read_text(encoding="utf-8")) if not (top / x.lstrip("/")).exists()]
    return {"documents": len(documents), "untyped": untyped, "broken": broken}


def settings(defaults: dict, *overrides: dict) -> dict:
    """defaults with each override in turn; parts that are dicts are merged, a key that defaults lack is an error."""
    out = json.loads(json.dumps(defaults))

    def put(at: dict, new: dict, path: str) -> None:
        for k, v in new.items():
            if k not in at:
                raise KeyError(f"no setting {path}{k}")
            if isinstance(at[k], dict) and isinstance(v, dict):
                put(at[k], v, f"{path}{k}.")
            else:
                at[k] = v

    for o in overrides:
        put(out, o, "")
    return out


def embedded(rows: DataFrame, text: str, dims: int = 64) -> DataFrame:
    """rows with `embedding`: counts of hashed words, scaled to length 1; a stand-in for a language model's vectors."""
    spot = lambda w: F.pmod(F.xxhash64(w), F.lit(dims))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    spots = F.transform(words, spot)
    n = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(spots, lambda s: s == i)).cast("double"))
    out = rows.withColumn("__n", n)
    length = F.sqrt(F.aggregate("__n", F.lit(0.0), lambda a, x: a + x * x))
    return out.withColumn("embedding", F.transform("__n", lambda x: F.try_divide(x, length))).withColumn("embedding", F.when(length > 0, F.col("embedding")).otherwise(F.col("__n"))).drop("__n")
