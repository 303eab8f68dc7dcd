"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, a hash-chosen sample of all documents the unlabelled side. With the class
prior p the risk of a scorer g is

    p * E_pos[loss(g, +1)] + max(0, E_unl[loss(g, -1)] - p * E_pos[loss(g, -1)])

and when the bracket falls below zero, its gradient is followed upwards instead, so the scorer cannot drive the
risk of the negatives it never saw below nothing. The loss is logistic, so scores are probabilities under that prior.
The scorer is linear over hashed words and their character pieces, trained with numpy on the driver.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import freed, table

#: Bounds of the training sample: confirmed toxic and unlabelled documents.
POSITIVES, UNLABELLED = 2000, 6000
#: Hashed features, and the score from which a text counts as toxic.
SLOTS, THRESHOLD = 1 << 20, 0.3
#: Words whose weights a worker remembers, if they are no longer than LONG; past it, each STEP characters count as a word.
REMEMBERED, LONG, STEP = 200_000, 64, 8
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(BETWEEN.replace("[", "[^"))


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def pieces(word: str) -> list[int]:
    """Slots of a word: itself, and the four- and five-letter pieces of all of it with its ends marked."""
    w = f"^{word}$"
    parts = {w, *(w[i : i + n] for n in (4, 5) for i in range(max(1, len(w) - n + 1)))}
    return [zlib.crc32(p.encode()) % SLOTS for p in sorted(parts)]


def length(words: Iterable[str]) -> int:
    """How many words these count as: an unbroken run, as of a script without spaces, is as long as a text of its size."""
    return sum(1 + -(-max(0, len(w) - LONG) // STEP) for w in words)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scorer(self):
        weights, bias = self.weights, self.bias

        class Weights(dict):
            def __missing__(self, word: str) -> float:
                w = float(weights[pieces(word)].sum())
                if len(word) <= LONG:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[word] = w
                return w

        known = Weights()

        def score(text: str | None) -> float:
            words = distinct_words(text)
            g = bias + sum(map(known.__getitem__, words)) / max(1, length(words)) ** 0.5
            return float(1 / (1 + np.exp(-np.clip(g, -30, 30))))

        return score


def more_often(positive: np.ndarray, other: np.ndarray, slot: np.ndarray, slot_word: np.ndarray) -> np.ndarray:
    """By slot, the z-score of its log odds in positives against the other side; arguments count documents by word."""
    a, b = (np.bincount(slot, c[slot_word], SLOTS) for c in (positive, other))
    odds = np.log((a + 0.5) / (a.sum() - a + 0.5)) - np.log((b + 0.5) / (b.sum() - b + 0.5))
    return odds / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))


def train(docs: Iterable[tuple[int, set[str]]], prior: float, steps: int = 300, rate: float = 0.05, decay: float = 1e-4, least_z: float = 3.5) -> Model:
    """Minimise the non-negative risk over docs (1 if positive else 0, distinct words) with Adam.

    Only slots that positives use more often, by a z-score of `least_z` at least, get weights.
    Without positives nothing is toxic: the model scores 0 nearly.
    """
    at: dict[str, int] = {}
    slot, sizes, word, n, pos, size = array("i"), array("i"), array("i"), array("i"), array("b"), array("i")
    for positive, words in docs:
        for w in sorted(words):
            if w not in at:
                at[w] = len(at)
                found = pieces(w)
                slot.extend(found)
                sizes.append(len(found))
            word.append(at[w])
        n.append(len(words))
        size.append(length(words))
        pos.append(positive)
    slot, sizes, word, n, pos, size = (np.frombuffer(x, x.typecode) if x else np.zeros(0, int) for x in (slot, sizes, word, n, pos, size))
    many, pos = len(at), pos.astype(bool)
    if prior <= 0 or pos.all() or not pos.any() or not many:
        return Model(np.zeros(SLOTS, np.float32), -30.0)
    slot_word, doc = np.repeat(np.arange(many, dtype=np.int32), sizes), np.repeat(np.arange(len(n), dtype=np.int32), n)
    telling = more_often(np.bincount(word, pos[doc], many), np.bincount(word, ~pos[doc], many), slot, slot_word) >= least_z
    slot, slot_word = slot[telling[slot]], slot_word[telling[slot]]
    used, slot = np.unique(slot, return_inverse=True)
    useful = np.isin(word, slot_word)
    word, doc = word[useful], doc[useful]
    scale = 1 / np.sqrt(np.maximum(size, 1))
    prior = min(prior, 0.99)
    w, b = np.zeros(len(used)), np.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for t in range(1, steps + 1):
        of_word = np.bincount(slot_word, weights=w[slot], minlength=many)
        g = b + scale * np.bincount(doc, weights=of_word[word], minlength=len(n))
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        as_negative = np.logaddexp(0, g)
        up, down = prior / pos.sum(), 1 / (~pos).sum()
        bracket = down * as_negative[~pos].sum() - up * as_negative[pos].sum()
        rest = np.where(pos, -up * p, down * p)
        d = np.where(pos, up * (p - 1), 0.0) + rest if bracket >= 0 else -rest
        of_word = np.bincount(word, weights=(d * scale)[doc], minlength=many)
        dw = np.bincount(slot, weights=of_word[slot_word], minlength=len(used)) + decay * w
        db = d.sum()
        m, v = 0.9 * m + 0.1 * dw, 0.999 * v + 0.001 * dw * dw
        mb, vb = 0.9 * mb + 0.1 * db, 0.999 * vb + 0.001 * db * db
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    weights = np.zeros(SLOTS, np.float32)
    weights[used] = w
    return Model(weights, float(b))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the key as text leaves 2 modulo 4."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on at most `positives` confirmed toxic and `unlabelled` other texts, the first by hash of their keys.

    The prior is the toxic share of all labels that may be learnt. A key with several labels is toxic if any says so;
    null labels say nothing.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter(F.col("y").isNotNull() & F.col("k").isNotNull() & ~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    n, toxic = known.agg(F.count("*"), F.sum((F.col("y") == 1).cast("long"))).first()
    order = F.xxhash64("k")
    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("text"))
    pos = known.filter("y = 1").select("k").orderBy(order, "k").limit(positives)
    unl = texts.select("k").filter("k is not null").distinct().orderBy(order, "k").limit(unlabelled)
    chosen = pos.withColumn("pos", F.lit(1)).union(unl.withColumn("pos", F.lit(0)))
    words = F.array_join(F.array_distinct(F.split(F.lower("text"), BETWEEN)), " ")
    rows = texts.join(F.broadcast(chosen), "k").select("pos", words.alias("words")).orderBy("pos", "words")
    return train(((r["pos"], distinct_words(r["words"])) for r in rows.toLocalIterator()), (toxic or 0) / n if n else 0.0)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, from its whole text alone.

    Null and empty texts have no words and score the bias. Rows that repeat an id are scored each; other columns play
    no part; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # SLOTS numbers, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Model(*shared.value).scorer()
        for b in batches:
            s = [of(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda b: freed(run(b)), f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def not_toxic(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns.

    Null and empty texts score the bias; rows that repeat are judged each alike; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Model(*shared.value).scorer()
        for b in batches:
            yield b.filter(pa.array([of(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(lambda b: freed(run(b)), docs.schema)


def op5_nn_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, learn(docs, table(spark, sf_dir, "labels")))
