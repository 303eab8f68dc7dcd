"""Substring dedup with repeated-phrase automata.

Of the phrases of PHRASE words in a window of 50 words, one has the least hash; equal windows have the same one, at
the same place. So a window can only recur where its phrase does. Phrases that stand in two documents at least are
confirmed by grouping their very texts. Documents are dealt into shards; each shard compiles an Aho-Corasick automaton over the
confirmed phrases of its documents and streams those through it, whole texts, to locate every occurrence. Windows
whose phrase was located are grouped by 96 bits of XXH3 over their very words, as bytes with one blank between two,
which gives the first document of each. (Two of n different windows meet by chance with probability n * n / 2**97.)

Phrases reach a shard only if one of its documents has them, so automata stay as large as a shard, at any input size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.llm.common import freed, scratch, size_bytes, stored, table
from loomgraph.llm.hashing import Rolling, U, sliding_min, word_hashes

WINDOW, PHRASE = 50, 10
#: Bytes of input files that a shard stands for.
SHARD_BYTES = 8 << 20


class Reader:
    """Words of a text (its bytes between ASCII white space), and the telling phrase of each window."""

    def __init__(self, window: int, phrase: int):
        self.window, self.phrase = window, phrase
        self.phrases = Rolling(0x9E3779B97F4A7C15)

    def read(self, text: str | None) -> tuple[list[bytes], np.ndarray]:
        """words, and the position of the phrase of least hash of each window.

        32 bits of a phrase's hash are compared, above its position: of equal ones the first phrase of the window is
        taken, in every document alike.
        """
        data = (text or "").encode()
        words = data.split()
        h = word_hashes(data) if len(words) >= self.window else np.zeros(0, U)
        g = self.phrases.windows(h, self.phrase)
        at = np.arange(len(g), dtype=U)
        return words, (sliding_min((g >> U(32) << U(32)) | at, self.window - self.phrase + 1) & U(0xFFFFFFFF)).astype(np.int64)


def lined(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The words with one blank before, between and after them, and the places of the blanks."""
    line = b" " + b" ".join(words) + b" "
    return line, np.flatnonzero(np.frombuffer(line, np.uint8) == 32)


def window_hashes(line: bytes, blanks: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """128 bits (n x 2) of the words of the window at each of these positions of lined() words."""
    low, high = (blanks[at] + 1).tolist(), blanks[at + window].tolist()
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(line[a:b]) for a, b in zip(low, high)]), U).reshape(-1, 2)


def phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(doc_id, phrase): the telling phrases of all windows of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(window, phrase)
        for b in batches:
            keys, out = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words, least = reader.read(t.as_py())
                if k is not None and len(least):
                    at = least[np.r_[True, least[1:] != least[:-1]]].tolist()
                    out += [b" ".join(words[p : p + phrase]) for p in at]
                    keys += [k] * len(at)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "phrase"])

    return docs.select("doc_id", "text").mapInArrow(lambda b: freed(run(b)), "doc_id long, phrase string")


def confirmed(docs: DataFrame, shards: int, window: int, phrase: int) -> DataFrame:
    """(shard, phrase): each phrase of two documents or more, for every shard that has it.

    Rows are folded to one a phrase and shard before the rows of a phrase, which shards bound, meet.
    """
    seen = phrases(docs, window, phrase).groupBy("phrase", shard_of(shards).alias("shard")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    of = W.partitionBy("phrase")
    both = seen.withColumn("least", F.min("first").over(of)).withColumn("most", F.max("last").over(of))
    return both.filter("least < most").select("shard", "phrase")


def input_bytes(rows: DataFrame) -> int:
    """The estimate from file sizes, or half the texts' bytes where Spark has none and says a petabyte or more."""
    known = size_bytes(rows)
    return known if known < 1 << 50 else (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2


def shard_of(shards: int):
    return F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")


def automaton(found: list[str]) -> ahocorasick.Automaton:
    """Over bytes, each as one character, so that places are byte offsets."""
    a = ahocorasick.Automaton()
    for p in found:
        key = f" {p.encode().decode('latin-1')} "
        a.add_word(key, len(key))
    a.make_automaton()
    return a


def located(line: bytes, blanks: np.ndarray, found: ahocorasick.Automaton) -> np.ndarray:
    """The word positions at which the automaton's phrases start in lined() words."""
    starts = [end - n + 1 for end, n in found.iter(line.decode("latin-1"))]
    return np.searchsorted(blanks, starts) if starts else np.zeros(0, np.int64)


def windows(docs: DataFrame, found: DataFrame, shards: int, window: int, phrase: int) -> DataFrame:
    """(h, x, doc_id): hash and position of every window of docs whose telling phrase is among found (shard, phrase).

    x holds 32 more bits of the hash above the position.
    """

    def run(_, left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if right.num_rows and left.num_rows:
            reader, spot = Reader(window, phrase), automaton(right.column("phrase").to_pylist())
            for k, t in zip(left.column("doc_id").to_pylist(), left.column("text"), strict=True):
                words, least = reader.read(t.as_py())
                if k is None or not len(least):
                    continue
                line, blanks = lined(words)
                there = np.zeros(len(words), bool)
                there[located(line, blanks, spot)] = True
                pos = np.flatnonzero(there[least])
                if len(pos):
                    h = window_hashes(line, blanks, pos, window)
                    out[0].append(h[:, 0].view(np.int64))
                    out[1].append(((h[:, 1] >> U(32) << U(32)) | pos.astype(U)).view(np.int64))
                    out[2].append(np.full(len(pos), k, np.int64))
        cols = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.Table.from_arrays([pa.array(c) for c in cols], ["h", "x", "doc_id"])

    left = docs.select(shard_of(shards).alias("shard"), "doc_id", "text").groupBy("shard")
    return left.cogroup(found.groupBy("shard")).applyInArrow(run, "h long, x long, doc_id long")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, phrase: int = PHRASE, keep_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (and kept_text, if asked for).

    A word goes if a window of `window` consecutive words covers it whose words also stand, in that order, in a
    document with a smaller id. Ids are whole numbers; a null id is smaller than none and loses nothing. Null texts
    and texts shorter than a window keep all their words. Rows that repeat an id are the same document: they lose
    nothing to each other, and positions that go in one go in all. An empty table gives no rows; other columns play
    no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(rows) // SHARD_BYTES)
    more = F.shiftright("x", 32)
    with scratch(spark):
        found = stored(confirmed(rows, shards, window, phrase), "phrases")
        seen = stored(windows(rows, found, shards, window, phrase), "windows")
        held = seen.groupBy("h", more.alias("more")).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        first = stored(held.filter("first < last").drop("last"), "firsts")
        known = first.withColumnRenamed("h", "k")
        again = seen.join(known, (F.col("h") == F.col("k")) & (more == F.col("more"))).filter(F.col("doc_id") > F.col("first"))
        at = again.select(F.col("doc_id").alias("gone_id"), F.col("x").bitwiseAND(0xFFFFFFFF).cast("int").alias("at"))
        at = at.repartition("gone_id")  # plain rows are half of what partly collected lists would be
        gone = stored(at.groupBy("gone_id").agg(F.collect_list("at").alias("starts")), "gone", keep=True)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 5 if keep_text else 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k, t, s in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                words = (t.as_py() or "").encode().split()
                n = len(words)
                if s.is_valid:
                    at = s.values.to_numpy()
                    edge = np.zeros(n + window + 1, np.int32)
                    np.add.at(edge, np.minimum(at, n), 1)
                    np.add.at(edge, np.minimum(at + window, n), -1)
                    covered = np.cumsum(edge[:n]) > 0
                    words = [w for w, c in zip(words, covered, strict=True) if not c]
                kept = b" ".join(words)
                out.append((k, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode())[: len(names)])
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, types)], names)

    both = rows.join(gone, F.col("doc_id") == F.col("gone_id"), "left").select("doc_id", "text", "starts")
    return both.mapInArrow(lambda b: freed(run(b)), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text)


def op4_repeated_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, p, sha256(array_to_string(w[p : p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, (len(w) - 48)::BIGINT)) AS p FROM d)),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS first FROM s),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS pos FROM f WHERE doc_id > first),
r AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
w AS (SELECT doc_id, pos, word FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d)),
k AS (SELECT w.doc_id, sha256(string_agg(word, ' ' ORDER BY w.pos)) AS kept FROM w LEFT JOIN g ON w.doc_id = g.doc_id AND w.pos = g.pos WHERE g.pos IS NULL GROUP BY w.doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, coalesce(kept, sha256('')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)
"""
