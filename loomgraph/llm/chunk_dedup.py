"""Exact dedup over content-defined chunk recipes.

A text is cut where its content says so, every distinct chunk gets an identifier whose bytes were compared, and a
text becomes the ordered list of its chunk identifiers. Two texts are equal when their lists are; only the lists
travel to be compared, the chunk bytes travel once, combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower, scratch, split_by, stored, table

#: A chunk ends after the first full stop or line end past MIN code points, at MAX otherwise.
MIN, MAX = 512, 4096
#: More unverified digests than this mean that the digest is too short.
MOST_UNVERIFIED = 4096


def chunks(text: Column, least: int = MIN, most: int = MAX) -> Column:
    """The chunks of a text, in order; they concatenate to it. An empty text has none."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most}}}?(?<=[.\n])|.{{{most}}}|.+"), F.lit(0))


def digest(chunk: Column, hex_digits: int = 64) -> Column:
    return F.unhex(F.substring(F.sha2(chunk, 256), 1, hex_digits))


def chunk_store(docs: DataFrame, text: str = "text", hex_digits: int = 64) -> DataFrame:
    """(digest, chunk, uses): every distinct chunk once, compared by its bytes."""
    one = docs.select(F.explode(chunks(ascii_lower(F.col(text)))).alias("chunk"))
    return one.groupBy(digest(F.col("chunk"), hex_digits).alias("digest"), "chunk").agg(F.count("*").alias("uses"))


def unverified(store: DataFrame) -> list[bytearray]:
    """Digests that more than one distinct chunk has. With SHA-256 there is none to be expected."""
    found = store.groupBy("digest").count().filter("count > 1").select("digest").limit(MOST_UNVERIFIED + 1).collect()
    if len(found) > MOST_UNVERIFIED:
        raise ValueError(f"over {MOST_UNVERIFIED} chunk digests collide; use a longer digest")
    return [r[0] for r in found]


def recipes(docs: DataFrame, key: str = "doc_id", text: str = "text", hex_digits: int = 64) -> DataFrame:
    """(key, recipe, text_sha256) for each row. A chunk whose digest is not verified is named by digest and bytes."""
    shared = unverified(chunk_store(docs, text, hex_digits))

    def name(c: Column) -> Column:
        d = digest(c, hex_digits)
        return d if not shared else F.when(F.array_contains(F.array(*map(F.lit, shared)), d), F.concat(d, F.encode(c, "UTF-8"))).otherwise(d)

    norm = docs.select(F.col(key).alias("doc_id"), ascii_lower(F.col(text)).alias("norm"))
    return norm.select("doc_id", F.transform(chunks(F.col("norm")), name).alias("recipe"), F.unhex(F.sha2("norm", 256)).alias("sha"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", hex_digits: int = 64) -> DataFrame:
    """Every row with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Equal: identical after lower-casing A-Z. The largest key of a group stays. Null texts are empty, and all empty
    texts are one group. A null key never beats another; a group of null keys only keeps them (keep_id null). Rows
    that repeat the kept key and text are the same row, and each is marked kept. An empty table gives no rows.
    Other columns of docs, of any name, play no part.
    """
    rows = stored(recipes(docs, key, text, hex_digits), "recipes")
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    many = stored(groups.select(F.lit(True).alias("many"), F.col("recipe").alias("r"), "keep_id", "group_size"), "groups")  # apart, so a hot group's join can be split
    keep = F.when(F.col("many"), F.col("keep_id")).otherwise(F.col("doc_id"))
    return rows.join(many, F.col("recipe") == F.col("r"), "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def kept(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat a kept key and its text, one.

    Null keys and texts are judged as by dedup(); an empty table stays empty. Only rows that go, or repeat one that
    stays, are named, and only rows that may be one of those move.
    """
    sha = F.unhex(F.sha2(ascii_lower(F.col(text)), 256))
    with scratch(docs.sparkSession):
        rows = dedup(docs, key, text).filter("group_size > 1").groupBy("doc_id", F.unhex("text_sha256").alias("sha"))
        named = stored(rows.agg(F.min("kept").alias("kept"), F.count("*").alias("rows")).filter("not kept or rows > 1"), "named", keep=True)
    others, maybe = split_by(docs, [F.col(key)], named, ["doc_id"])
    gone = named.filter("not kept").select(F.col("doc_id").alias("__gone"), F.col("sha").alias("__of")).hint("merge")
    stay = maybe.withColumn("__sha", sha).join(gone, F.col(key).eqNullSafe(F.col("__gone")) & (F.col("__sha") == F.col("__of")), "left_anti")
    return others.unionByName(stay.dropDuplicates([key, "__sha"]).drop("__sha"))


def op10_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
