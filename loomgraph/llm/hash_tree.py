"""Sharding by a hierarchical weighted hash tree.

Regions hold racks and racks hold shards; each shard has a weight and a node weighs what its shards weigh. A key
descends from the root: at every level each child draws -ln(u)/weight with u from a hash of the key and the child,
and the least draw wins. A draw depends on nothing but the key, the child's name and its weight, so a change of one
weight moves keys only into or out of the subtrees whose weights it changes.

Growing mounts the new shard in an expansion region of its own: no other node's weight changes, so the new shard
takes keys and no key moves between old shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.llm.common import table

#: Shards of the tree before any growth; a power of two, halved at each level.
BASE = 8
#: Rows of one shard that one task numbers.
ROWS_A_TASK = 50_000


@dataclass(frozen=True)
class HashTree:
    """leaves: (region, rack, shard, weight), the shard numbered through the whole tree."""

    leaves: tuple[tuple[str, str, int, float], ...]

    @staticmethod
    def of(shards: int, base: int = BASE) -> HashTree:
        """Shards up to base lie in racks of two and regions of two racks, each later one in its own region."""
        if shards < 1:
            raise ValueError("a tree needs one shard at least")
        first = [(f"region{s // 4}", f"rack{s // 2}", s, 1.0) for s in range(min(base, shards))]
        return HashTree(tuple(first + [(f"added{s}", f"rack{s}", s, 1.0) for s in range(base, shards)]))

    def weighed(self, shard: int, weight: float) -> HashTree:
        return HashTree(tuple((r, k, s, weight if s == shard else w) for r, k, s, w in self.leaves))

    def children(self, *path: str) -> dict[str, float]:
        """Weights of the children at path, those without weight left out."""
        out: dict[str, float] = {}
        for r, k, s, w in self.leaves:
            full = (r, k, str(s))
            if full[: len(path)] == path and w > 0:
                out[full[len(path)]] = out.get(full[len(path)], 0.0) + w
        return out


def draw(key: Column, child: str, weight: float) -> Column:
    """An exponential draw with the weight as its rate; 53 bits of the hash make u in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(child)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(weight)


def descend(key: Column, tree: HashTree, *path: str) -> Column:
    """The shard that key falls to below path."""
    weights = tree.children(*path)
    if not weights:
        raise ValueError("no shard below " + "/".join(path) + " has weight")
    names = sorted(weights)
    if len(path) == 2:
        below = {n: F.lit(int(n)) for n in names}
    else:
        below = {n: descend(key, tree, *path, n) for n in names}
    if len(names) == 1:
        return below[names[0]]
    won = F.array_min(F.array(*[F.struct(draw(key, "/".join((*path, n)), weights[n]).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(names)]))["i"]
    out = None
    for i, n in enumerate(names):
        out = F.when(won == i, below[n]) if out is None else out.when(won == i, below[n])
    return out


def place(rows: DataFrame, shards: int, key: str = "doc_id", text: str = "text", base: int = BASE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row; law `key`.

    The key and the shard count decide the shard; a null key is a key like any other. Rows that repeat a key share
    its shard and have slots of their own. Size: UTF-8 bytes plus 1; a null text has none. Slots count the rows of a
    shard from 0 without a gap: blocks of a shard, dealt by hash of key and text, are numbered apart and shifted by the
    rows of the blocks before, so no task holds a whole shard or all rows of a key. An empty table gives no rows; other columns play no part.
    """
    body = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    n = rows.count()
    blocks = max(16, n // (shards * ROWS_A_TASK))
    placed = rows.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        descend(F.col(key), HashTree.of(shards, base)).cast("int").alias("shard"),
        descend(F.col(key), HashTree.of(shards + 1, base)).cast("int").alias("grown_shard"),
    ).withColumn("block", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(blocks)))
    sizes = placed.groupBy("shard", "block").agg(F.count("*").alias("rows"))
    shift = sizes.select("shard", "block", (F.sum("rows").over(W.partitionBy("shard").orderBy("block")) - F.col("rows")).alias("shift"))
    numbered = placed.withColumn("at", F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id", "text_crc32")))
    return numbered.join(shift, ["shard", "block"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("shift") + F.col("at") - 1).cast("long").alias("slot"), "grown_shard"
    )


def write_shards(rows: DataFrame, path: str, shards: int, key: str = "doc_id", base: int = BASE) -> None:
    """Write rows, with all their columns, into one folder a shard.

    A null key is a key like any other, rows that repeat go to one shard, an empty table writes no folder; a column of
    rows named shard is refused.
    """
    if "shard" in rows.columns:
        raise ValueError("rows have a column named shard already")
    rows.withColumn("shard", descend(F.col(key), HashTree.of(shards, base))).write.partitionBy("shard").parquet(path)


def op9_weighted_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(table(spark, sf_dir, "documents"), 8)
