"""Near-duplicate classes by DartMinHash.

A document is a weighted set: its distinct shingles, each with a weight (1, or how often it occurs). Each element owns
the region [0, weight) x [0, infinity) of a plane on which hashes throw darts, one on average for each unit of area;
the same element gets the same darts in every document. A dart has a rank (its height) and one of COORDINATES
coordinates; a signature keeps the earliest dart of each coordinate. Two documents agree on a coordinate with the
probability of their weighted Jaccard similarity. Ranks are thrown in blocks from below until every coordinate has a
dart, so a document of n shingles costs about max(n, k ln k) darts, whatever k.

Bands of ROWS coordinates are joined on their hashes. Equal texts are one node. The hub of a bucket is its node that
shares buckets with most others, so the base of a family of copies rather than one of them. Each node meets one hub, not all others; pairs whose
signatures or sizes rule similarity out go before any text moves, the rest are confirmed by the exact Jaccard
similarity of their shingle sets, and links are closed to classes. Buckets that still hold several classes pair each
node with a hub of another class, until a round finds few links; a round merges classes by their labels alone. At last
the signatures of every pair of different classes that still shares a bucket are compared, in blocks of a bucket's
salted groups, and what they leave is confirmed: a pair that shares a band is in one class, or was compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.llm.common import freed, scratch, split_by, stored, table, without
from loomgraph.llm.hashing import Rolling, U, mix, word_hashes

WORDS, SIMILAR = 5, 0.8
#: 26 bands of 5: a pair of similarity 0.8 shares a band with probability 0.99997.
ROWS, BANDS = 5, 26
COORDINATES = ROWS * BANDS
NONE = np.iinfo(np.uint64).max
#: P(a cell of unit area has at most i darts), as 64-bit thresholds.
POISSON = np.minimum(np.cumsum([np.exp(-1) / np.prod(np.arange(1.0, i + 1)) for i in range(12)]) * 2.0**64, 2.0**64 - 4096).astype(U)
#: Cells thrown at once, and shingle sets a worker remembers while confirming pairs.
CELLS, REMEMBERED = 1 << 18, 256
#: Members of a salted group; two groups of a bucket are compared at once. Texts dealt out in one pass, if nodes are fewer;
#: signatures are dealt out eight times as many at once.
GROUP, LEAST_PASS = 256, 100_000
#: How many standard deviations below the similarity a signature's estimate may lie before its pair is ruled out.
MARGIN = 4.5
#: Rounds end when fewer than one of so many pairs is a link; the pass over all pairs finds what is left.
FEW = 50


class Shingles:
    """Hashes of a text's runs of WORDS words, lower-cased; all of a shorter text is one shingle."""

    def __init__(self, words: int = WORDS):
        self.words, self.roll = words, Rolling(0x9E3779B97F4A7C15)

    def of(self, text: str | None) -> tuple[list[str], np.ndarray]:
        w = (text or "").lower().split()
        return w, self.roll.windows(word_hashes(" ".join(w).encode()), min(self.words, len(w))) if w else np.zeros(0, U)


def throw(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """Signatures, n x k, of n documents whose weighted elements are (element, weight, doc). NONE where doc is empty."""
    out = np.full(n * k, NONE, U)
    cells = np.ceil(weight).astype(int)
    part = np.repeat(np.arange(len(element)), cells)
    cell = np.arange(len(part)) - np.repeat(np.cumsum(cells) - cells, cells)
    cover = np.minimum(weight[part] - cell, 1.0)  # how much of its cell an element owns
    seed, who = mix(element[part] ^ mix(cell.astype(U) + U(1))), doc[part]
    low, high = 0, 1
    while len(seed):
        step = max(1, CELLS // (high - low))
        for a in range(0, len(seed), step):
            s = slice(a, a + step)
            span = high - low
            rank = np.tile(np.arange(low, high, dtype=U), len(seed[s]))
            one = mix(np.repeat(seed[s], span) + mix(rank + U(0x51ED270B)))
            darts = np.searchsorted(POISSON, one, side="left")
            at = np.repeat(np.arange(len(one)), darts)
            nth = np.arange(len(at)) - np.repeat(np.cumsum(darts) - darts, darts)
            h = mix(one[at] + (nth.astype(U) + U(1)) * U(0x9E3779B97F4A7C15))
            owner = np.repeat(np.arange(len(seed[s])), span)[at]
            inside = (mix(h ^ U(0x1F83D9AB)) >> U(11)).astype(float) * 2.0**-53 < cover[s][owner]
            h, at, owner = h[inside], at[inside], owner[inside]
            place = ((h >> U(32)) * U(k)) >> U(32)
            earliest = (rank[at] << U(40)) | (mix(h ^ U(0x5BE0CD19)) >> U(24))
            np.minimum.at(out, who[s][owner] * k + place.astype(int), earliest)
        open_ = (out.reshape(n, k) == NONE).any(axis=1)[who]
        seed, who, cover = seed[open_], who[open_], cover[open_]
        low, high = high, 2 * high
    return out.reshape(n, k)


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The hash of each band of `rows` coordinates."""
    n, k = signatures.shape
    out = np.zeros((n, k // rows), U)
    for i in range(rows):
        out = mix(out + mix(signatures[:, i : k // rows * rows : rows] + U(i + 1)))
    return out


def signed(docs: DataFrame, words: int = WORDS, weights: str = "set") -> DataFrame:
    """(doc_id, copy, sig, size, bands) of docs (doc_id, text); all but doc_id null without words.

    copy: 128 bits of its words; sig: one byte a coordinate; size: its distinct shingles; bands: the band hashes.
    """
    if weights not in ("set", "count"):
        raise ValueError("weights: set or count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for whole in batches:
            for a in range(0, whole.num_rows, 512):
                b = whole.slice(a, 512)
                copies, elements, weight = [], [], []
                for t in b.column(1):
                    w, s = shingles.of(t.as_py())
                    copies.append(xxhash.xxh3_128_digest(" ".join(w)) if w else None)
                    one, n = np.unique(s, return_counts=True)
                    elements.append(one)
                    weight.append(np.ones(len(one)) if weights == "set" else n.astype(float))
                size = [len(x) for x in elements]
                doc = np.repeat(np.arange(len(size)), size)
                full = np.array([bool(n) for n in size])
                index = np.cumsum(full) - 1
                thrown = throw(np.concatenate(elements), np.concatenate(weight), index[doc] if len(doc) else doc, int(full.sum()))
                got, low = bands(thrown), thrown.astype(np.uint8)
                keys = [got[index[i]].view(np.int64) if full[i] else None for i in range(len(size))]
                sig = [low[index[i]].tobytes() if full[i] else None for i in range(len(size))]
                cols = [b.column(0), pa.array(copies, pa.binary()), pa.array(sig, pa.binary()), pa.array(size, pa.int32()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "copy", "sig", "size", "bands"])

    return docs.mapInArrow(lambda b: freed(run(b)), "doc_id long, copy binary, sig binary, size int, bands array<long>")


def least_agreement(similar: float, k: int = COORDINATES) -> int:
    """Coordinates that two signatures of that similarity agree on at least, but for MARGIN standard deviations."""
    return max(0, int(np.ceil(k * similar - MARGIN * np.sqrt(k * similar * (1 - similar)))))


def sizes_fit(m, n, similar: float):
    """Whether sets of m and n elements can have that similarity; numbers, arrays or columns."""
    return (m >= similar * n) & (n >= similar * m)


def likely(pairs: DataFrame, reps: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) that sizes and signatures don't rule out."""
    least = least_agreement(similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p, q = (np.frombuffer(b"".join(x.column(c).to_pylist()), np.uint8).reshape(x.num_rows, -1) for c in (2, 3))
            yield x.select([0, 1]).filter(pa.array((p == q).sum(axis=1) >= least, pa.bool_()))

    side = lambda key, sig, size: reps.select(F.col("node").alias(key), F.col("sig").alias(sig), F.col("size").alias(size)).hint("merge")
    both = pairs.join(side("a", "p", "m"), "a").join(side("b", "q", "n"), "b").filter(sizes_fit(F.col("m"), F.col("n"), similar))
    return both.select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, similar: float) -> DataFrame:
    """The pairs (a, b), a stored table, whose shingle sets have the Jaccard similarity `similar` or more; few other texts move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, known = Shingles(words), {}

        def of(key: int, text: str) -> np.ndarray:
            if key not in known:
                if len(known) >= REMEMBERED:
                    known.pop(next(iter(known)))
                known[key] = np.unique(shingles.of(text)[1])
            return known[key]

        for b in batches:
            left, right = b.column(0).to_pylist(), b.column(1).to_pylist()
            linked = []
            for x, y, s, t in zip(left, right, b.column(2), b.column(3), strict=True):
                p, q = of(x, s.as_py()), of(y, t.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True))
                linked.append(both >= similar * (len(p) + len(q) - both))
            yield b.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    _, left = split_by(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("s")), [F.col("a")], pairs.select("a").distinct(), ["a"])
    _, right = split_by(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("t")), [F.col("b")], pairs.select("b").distinct(), ["b"])
    return pairs.hint("merge").join(left, "a").hint("merge").join(right, "b").select("a", "b", "s", "t").mapInArrow(lambda b: freed(run(b)), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): each node's component by its smallest node; least labels spread, and labels jump to their own."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("beyond"))
        new = stored(step.join(jump, "to").select("node", F.least("to", "beyond").alias("label"), "was"), "labels")
        if new.filter("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def hub_pairs(buckets: DataFrame, similar: float) -> DataFrame:
    """(a, b): each node b of buckets (band, key, node, size, deg) with the best of the hubs of its buckets, a."""
    hubs = buckets.groupBy("band", "key").agg(F.max(F.struct("deg", -F.col("node"), "size")).alias("h")).select("band", "key", "h.deg", (-F.col("h.col2")).alias("hub"), F.col("h.size").alias("n"))
    met = buckets.drop("deg").join(hubs, ["band", "key"]).filter((F.col("node") != F.col("hub")) & sizes_fit(F.col("size"), F.col("n"), similar))
    return met.groupBy(F.col("node").alias("b")).agg(F.max(F.struct("deg", -F.col("hub"))).alias("h")).select((-F.col("h.col2")).alias("a"), "b")


def cross_pairs(buckets: DataFrame, labels: DataFrame, turn: int, similar: float) -> DataFrame:
    """(a, b): in buckets that hold several classes, each node with a hub of a class that isn't its own."""
    named = buckets.join(labels, "node")
    classes = named.groupBy("band", "key", "label").agg(F.max(F.struct("deg", -F.col("node"), "size")).alias("h"))
    mixed = classes.groupBy("band", "key").agg(F.count("*").alias("n"), F.max(F.struct("h", "label")).alias("one"), F.max(F.struct(F.xxhash64("label", F.lit(turn)), "h", "label")).alias("two"))
    two = F.struct(F.col("two.h").alias("h"), F.col("two.label").alias("label"))
    hubs = mixed.filter("n > 1").select("band", "key", F.explode(F.array("one", two)).alias("o"))
    met = named.join(hubs, ["band", "key"]).filter((F.col("label") != F.col("o.label")) & sizes_fit(F.col("size"), F.col("o.h.size"), similar))
    hub = -F.col("o.h.col2")
    best = met.groupBy("node").agg(F.max(F.struct(F.xxhash64(hub, F.lit(turn)), hub.alias("hub")))["hub"].alias("hub"))
    return best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


MEMBER = "band int, key long, i string, j string, alone boolean, salt boolean, node long, label long, size int, sig binary"

MEMBER_COLUMNS = [c.split()[0] for c in MEMBER.split(", ")]


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows (MEMBER, and what follows) of each block, of batches sorted by block."""
    held, last = [], None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:4] != last:
                if len(held) > 1:
                    yield held
                held, last = [], row[:4]
            held.append(row)
    if len(held) > 1:
        yield held


def block_pairs(block: list[tuple], similar: float) -> Iterator[tuple[int, np.ndarray]]:
    """(x, ys): each member of a block with the likely ones of the members after it that have another label.

    A pair belongs to the first band that it shares; blocks of other bands leave it out.
    """
    band, alone = block[0][0], block[0][4]
    first, label, size = (np.array([m[c] for m in block]) for c in (5, 7, 8))
    sig = np.frombuffer(b"".join(m[9] for m in block), np.uint8).reshape(len(block), BANDS, ROWS)
    left, agree = np.flatnonzero(first), least_agreement(similar)
    right = left if alone else np.flatnonzero(~first)
    for x in left:
        y = right[right > x] if alone else right
        y = y[(label[y] != label[x]) & sizes_fit(size[x], size[y], similar)]
        same = sig[y] == sig[x]
        y = y[(same.sum(axis=(1, 2)) >= agree) & (same.all(axis=2).argmax(axis=1) == band)]
        if len(y):
            yield x, y


def dealt_out(members: DataFrame) -> DataFrame:
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = ["band", "key", "i", "j"]
    return members.repartition(n, *at).sortWithinPartitions(*at)


def block_members(members: DataFrame, similar: float) -> DataFrame:
    """Those of members (MEMBER) that have a likely partner in their block.

    A block is all rows of a (band, key, i, j): group i of a bucket against its group j; salt says whether a member is
    of group i, alone whether the two are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for block in blocks(batches):
            met = sorted({int(z) for x, y in block_pairs(block, similar) for z in (x, *y)})
            if met:
                schema = schema or pa.schema([("band", pa.int32()), ("key", pa.int64()), ("i", pa.string()), ("j", pa.string()), ("alone", pa.bool_()), ("salt", pa.bool_()), ("node", pa.int64()), ("label", pa.int64()), ("size", pa.int32()), ("sig", pa.binary())])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*(block[m] for m in met), strict=True), schema)], schema=schema)

    return dealt_out(members).select(*MEMBER_COLUMNS).mapInArrow(run, MEMBER)


def block_links(members: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """Links (a, b), a < b, that join the members (MEMBER, a stored table) of each block as all its similar pairs would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for block in blocks(batches):
            sets, label, found = [np.unique(shingles.of(m[10])[1]) for m in block], np.array([m[7] for m in block]), []
            for x, ys in block_pairs(block, similar):
                for y in ys:
                    if label[x] != label[y]:
                        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                        if both >= similar * (len(sets[x]) + len(sets[y]) - both):
                            found.append(sorted((block[x][6], block[y][6])))
                            label[label == label[y]] = label[x]
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], ["a", "b"])

    _, held = split_by(texts.select(F.col("doc_id").alias("n"), "text"), [F.col("n")], members.select("node").distinct(), ["node"])
    whole = members.join(held.dropDuplicates(["n"]).hint("merge"), F.col("node") == F.col("n"))
    return dealt_out(whole).select(*MEMBER_COLUMNS, "text").mapInArrow(run, "a long, b long").distinct()


def settled(labels: DataFrame, buckets: DataFrame, reps: DataFrame, texts: DataFrame, words: int, similar: float) -> DataFrame:
    """labels after all pairs of different labels that share a bucket are compared.

    A bucket's classes of over GROUP members have groups of their own, which never meet each other; the others share
    groups. A pass deals out the signatures of eight times as many members as there are nodes at most, and the texts of those
    alone that have a likely partner, in turns of one text a node at most; later passes leave out buckets that
    have become one class.
    """
    at, named = ["band", "key"], buckets.join(labels, "node")
    each = named.groupBy(*at, "label").agg(F.count("*").alias("n"))
    part = F.struct((F.col("n") > GROUP).alias("big"), F.when(F.col("n") > GROUP, F.col("label")).otherwise(0).alias("of")).alias("part")
    each = stored(each.select(*at, "label", "n", part), "classes")
    mixed = each.groupBy(*at).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    shares = each.groupBy(*at, "part").agg(F.ceil(F.sum("n") / GROUP).cast("int").alias("m"), F.sum("n").alias("n"))
    parts = stored(shares.join(mixed, at).groupBy(*at).agg(F.collect_list(F.struct("part", "m", "n")).alias("parts")), "parts")
    met = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["n"] * F.aggregate("parts", F.lit(0), lambda c, y: c + F.when(x["part"]["big"] & (x["part"] == y["part"]), 0).otherwise(y["m"])))
    most = max(LEAST_PASS, reps.count())
    passes = -(-(parts.agg(F.sum(met)).first()[0] or 0) // (8 * most))
    big = each.filter("part.big").select(*at, F.col("label").alias("first_label"), F.col("part").alias("own"))
    first = labels.withColumnRenamed("label", "first_label")
    for p in range(passes):
        held = parts
        if p:
            named = buckets.join(labels, "node")
            held = parts.join(named.groupBy(*at).agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(*at), at)
        members = buckets.join(held, at).join(first, "node").join(big, [*at, "first_label"], "left")
        members = members.withColumn("own", F.coalesce("own", F.struct(F.lit(False).alias("big"), F.lit(0).cast("long").alias("of"))))
        members = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.filter("parts", lambda x: x["part"] == F.col("own"))[0]["m"]).cast("int"))
        others = F.filter("parts", lambda x: ~F.col("own.big") | (x["part"] != F.col("own")))
        groups = F.flatten(F.transform(others, lambda x: F.transform(F.sequence(F.lit(0), x["m"] - 1), lambda t: F.struct(x["part"].alias("part"), t.alias("salt")))))
        mine = F.struct(F.col("own").alias("part"), F.col("salt"))
        dealt = members.select(*at, "node", mine.alias("me"), F.explode(groups).alias("other"))
        dealt = dealt.select(*at, F.least("me", "other").alias("i"), F.greatest("me", "other").alias("j"), F.col("me").alias("salt"), "node")
        dealt = dealt.filter(F.pmod(F.xxhash64(*at, "i", "j"), F.lit(passes)) == p).join(labels, "node")
        dealt = dealt.join(reps.select("node", "size", "sig").hint("merge"), "node")
        dealt = dealt.withColumn("alone", F.col("i") == F.col("j")).withColumn("salt", F.col("salt") == F.col("i")).withColumns({c: F.to_json(c) for c in "ij"})
        likely_ones = stored(block_members(dealt, similar), "members")
        turns = -(-likely_ones.count() // most)
        for t in range(turns):
            some = likely_ones.filter(F.pmod(F.xxhash64(*at, "i", "j"), F.lit(turns)) == t)
            found = stored(block_links(some, texts, words, similar), "links")
            labels = labels if found.isEmpty() else merged(labels, found)
    return labels


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similar: float = SIMILAR, weights: str = "set") -> DataFrame:
    """Per row: doc_id, class_id, class_size, kept.

    Documents are linked when the sets of their runs of `words` lower-cased words have the Jaccard similarity
    `similar` or more, and a class is what links connect; its id is its smallest doc_id, the one kept. Null and empty
    texts have no shingles and are classes of their own. Ids are whole numbers; a null id is a class of its own with a
    null class_id. Rows that repeat an id are one document. An empty table gives no rows; other columns play no part.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    with scratch(docs.sparkSession):
        named = stored(labelled(rows, words, similar, weights), "classes", keep=True)
    sizes = named.groupBy("class_id").agg(F.count("*").alias("class_size")).withColumnRenamed("class_id", "c").filter("class_size > 1")
    both = named.join(stored(sizes, "sizes", keep=True), F.col("class_id") == F.col("c"), "left")
    return both.select("doc_id", "class_id", F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def labelled(rows: DataFrame, words: int, similar: float, weights: str) -> DataFrame:
    """(doc_id, class_id) of rows (doc_id, text)."""
    sig = stored(signed(rows, words, weights), "signatures")
    held = sig.filter("doc_id is not null and copy is not null")
    reps = stored(held.groupBy("copy").agg(F.min(F.struct("doc_id", "sig", "size", "bands")).alias("m")).select("copy", F.col("m.doc_id").alias("node"), "m.sig", "m.size", "m.bands"), "nodes")
    dealt = reps.select("node", "size", F.posexplode("bands").alias("band", "key"))
    texts = rows.filter("doc_id is not null")
    many = dealt.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stored(dealt.join(many, ["band", "key"]).withColumn("deg", F.sum("n").over(W.partitionBy("node"))).drop("n"), "buckets")
    labels = stored(buckets.select("node", F.col("node").alias("label")).distinct(), "labels")
    pairs = stored(likely(hub_pairs(buckets, similar), reps, similar), "pairs")
    for turn in count(1):
        found = stored(confirmed(pairs, texts, words, similar), "links")
        links = found.count()
        labels = merged(labels, found) if links else labels
        if FEW * links < pairs.count() or not links:
            break
        pairs = stored(likely(cross_pairs(buckets, labels, turn, similar), reps, similar), "pairs")
    labels = settled(labels, buckets, reps, texts, words, similar)
    of = reps.select("copy", "node").join(labels, "node", "left").select("copy", F.coalesce("label", "node").alias("class_id"))
    return sig.select("doc_id", "copy").join(of, "copy", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after the links (a, b) between nodes; only labels that a link touches are closed anew."""
    a, b = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    edges = links.join(a, "a").join(b, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    closed = components(stored(edges, "edges")).select(F.col("node").alias("was"), F.col("label").alias("now"))
    return stored(labels.join(closed, F.col("label") == F.col("was"), "left").select("node", F.coalesce("now", "label").alias("label")), "labels")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without those that a smaller id of their class stands for, with all their columns.

    Texts that share an id are judged apart, each under a number of its own in the order of ids and text hashes.
    """
    named = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("h")).filter("id is not null").distinct()
    if not named.groupBy("id").count().filter("count > 1").isEmpty():
        own = stored(named.orderBy("id", "h").withColumn("__node", F.monotonically_increasing_id()), "numbers", keep=True)
        own = own.withColumnRenamed("id", "__id").withColumnRenamed("h", "__h")
        rows = docs.join(own, (F.col(key) == F.col("__id")) & (F.xxhash64(text) == F.col("__h")), "left")
        gone = classes(rows.select("__node", text), "__node", text).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
        return rows.join(gone, F.col("__node") == F.col("__gone"), "left_anti").select(*docs.columns)
    gone = stored(classes(docs, key, text).filter("not kept").select("doc_id").distinct(), "gone", keep=True)
    return without(docs, [F.col(key).cast("long")], gone, ["doc_id"])


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
