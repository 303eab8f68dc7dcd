"""Communities of a weighted graph by modularity, moved in rounds of joins so that no graph has to fit a task."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import coread
from loomgraph.sources.shared import stored


def _offers(both: DataFrame, at: DataFrame, mine: DataFrame, total: float, gamma: float) -> DataFrame:
    """(n, to, d) for those nodes of mine (node, k, c) that gain d > 0 by a move to the best community of a neighbour."""
    mass = at.groupBy(F.col("c").alias("to")).agg(F.sum("k").alias("mass"))
    near = both.filter("x <> y").join(at.select(F.col("node").alias("y"), F.col("c").alias("to")), "y").groupBy("x", "to").agg(F.sum("w").alias("w"))
    own = mine.select(F.col("node").alias("x"), F.col("c").alias("to"), F.lit(0.0).alias("w"))
    offers = near.unionByName(own).groupBy("x", "to").agg(F.sum("w").alias("w")).join(mine, F.col("x") == F.col("node")).join(mass, "to")
    gain = F.round(F.col("w") - gamma * F.col("k") * (F.col("mass") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)) / total, 9)
    other = F.col("to") != F.col("c")
    best = offers.groupBy(F.col("node").alias("n")).agg(F.min(F.struct((-gain).alias("g"), other.alias("other"), "to")).alias("s"), F.max(F.when(~other, gain)).alias("stay"))
    return best.filter("s.other").select("n", "s.to", (-F.col("s.g") - F.col("stay")).alias("d"))


def _after(at: DataFrame, offers: DataFrame) -> DataFrame:
    """at (node, k, c, moved) after all of these moves at once."""
    both = at.join(offers.select("n", "to"), F.col("node") == F.col("n"), "left")
    return stored(both.select("node", "k", F.coalesce("to", "c").alias("c"), (F.col("moved") | F.col("n").isNotNull()).alias("moved")), "places")


def _apart(at: DataFrame, offers: DataFrame) -> DataFrame:
    """The offers that are the best of both communities they touch: no two touch the same one, so their gains add up."""
    each = offers.join(at.select(F.col("node").alias("n"), "c"), "n").select("n", "c", "to", F.struct("d", "n").alias("s"))
    top = stored(each.select(F.explode(F.array("c", "to")).alias("t"), "s").groupBy("t").agg(F.max("s").alias("top")), "best")
    mine = each.join(top.select(F.col("t").alias("c"), F.col("top").alias("p")), "c").join(top.select(F.col("t").alias("to"), F.col("top").alias("q")), "to")
    return mine.filter("s = p and s = q").select("n", "to")


def _modularity(both: DataFrame, at: DataFrame, total: float, gamma: float) -> float:
    x, y = at.select(F.col("node").alias("x"), F.col("c").alias("cx")), at.select(F.col("node").alias("y"), F.col("c").alias("cy"))
    inside = both.join(x, "x").join(y, "y").filter("cx = cy").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("inside"))
    chance = at.groupBy("c").agg(F.sum("k").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("chance"))
    inside, chance = inside.crossJoin(chance).first()
    return inside / total - gamma * chance / total**2


def _moves(both: DataFrame, total: float, gamma: float, seed: int) -> DataFrame:
    """(node, c): where nodes come to rest. both (x, y, w) holds each edge in both directions, a loop once with twice its weight.

    A hash picks the half of the nodes that may move in the first round of a pair, the others may in the second: all at
    once, neighbours would swap places for ever. A pair that does not raise modularity is replaced by a round of moves
    that touch different communities, which does; so it ends, and only when no node gains by a move.
    """
    at = stored(both.groupBy(F.col("x").alias("node")).agg(F.sum("w").alias("k")).select("node", "k", F.col("node").alias("c"), F.lit(False).alias("moved")), "places")
    best = _modularity(both, at, total, gamma)
    for r in count():
        start = now = at.withColumn("moved", F.lit(False))
        for half in (0, 1):
            mine = now.filter(F.crc32(F.concat_ws("/", F.col("node").cast("string"), F.lit(f"{seed}/{r}")).cast("binary")) % 2 == half)
            now = _after(now, _offers(both, now, mine, total, gamma))
        if now.filter("moved").isEmpty():
            return at.select("node", "c")
        got = _modularity(both, now, total, gamma)
        if got <= best + 1e-12:
            now = _after(start, _apart(start, stored(_offers(both, start, start, total, gamma), "offers")))
            got = _modularity(both, now, total, gamma)
        at, best = now, got


#: Edges, counted in both directions, up to which communities are found on the driver, by the same rounds.
SMALL = 2_000_000


class Small:
    """_moves() in numpy, over a graph of a checked size."""

    def __init__(self, names: list, x: np.ndarray, y: np.ndarray, w: np.ndarray, total: float, gamma: float, seed: int):
        self.x, self.y, self.w = x, y, w
        self.begin(names, np.bincount(x, w, len(names)), total, gamma, seed)

    def begin(self, names: list, k: np.ndarray, total: float, gamma: float, seed: int) -> None:
        self.names, self.k, self.total, self.gamma, self.seed = names, k, total, gamma, seed
        self.crc = np.array([zlib.crc32(f"{v}".encode()) for v in names], np.uint32)

    def offers(self, c: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n, to, d): as _offers()."""
        n = len(self.names)
        mass, use = np.bincount(c, self.k, n), mine[self.x] & (self.x != self.y)
        nodes = np.flatnonzero(mine)
        key = np.r_[self.x[use] * n + c[self.y[use]], nodes * n + c[nodes]]
        pairs, at = np.unique(key, return_inverse=True)
        w = np.bincount(at, np.r_[self.w[use], np.zeros(len(nodes))])
        x, to = pairs // n, pairs % n
        own = to == c[x]
        gain = np.round(w - self.gamma * self.k[x] * (mass[to] - np.where(own, self.k[x], 0.0)) / self.total, 9)
        order = np.lexsort((to, ~own, -gain, x))
        first = order[np.r_[True, x[order][1:] != x[order][:-1]]] if len(order) else order
        stay = np.zeros(n)
        stay[x[own]] = gain[own]
        best = first[~own[first]]
        return x[best], to[best], gain[best] - stay[x[best]]

    def apart(self, c: np.ndarray, n: np.ndarray, to: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Which offers are the best of both communities they touch."""
        rank = np.empty(len(n), int)
        rank[np.lexsort((n, d))] = np.arange(len(n))
        top = np.full(len(self.names), -1)
        np.maximum.at(top, c[n], rank)
        np.maximum.at(top, to, rank)
        return (top[c[n]] == rank) & (top[to] == rank)

    def inside(self, c: np.ndarray) -> float:
        """The weight within communities, in both directions."""
        return self.w[c[self.x] == c[self.y]].sum()

    def folded(self, c: np.ndarray) -> Small:
        """The graph whose nodes are the communities."""
        kept, to = np.unique(c, return_inverse=True)
        edges, at = np.unique(to[self.x] * len(kept) + to[self.y], return_inverse=True)
        return Small([self.names[i] for i in kept], edges // len(kept), edges % len(kept), np.bincount(at, self.w), self.total, self.gamma, self.seed)

    def modularity(self, c: np.ndarray) -> float:
        chance = np.bincount(c, self.k, len(self.names))
        return self.inside(c) / self.total - self.gamma * (chance**2).sum() / self.total**2

    def half(self, r: int) -> np.ndarray:
        """crc32 of name/seed/r, modulo 2: a change of the name's bits changes the last bit whatever the others are, so 32 of them tell all."""
        end = f"/{self.seed}/{r}".encode()
        last = zlib.crc32(end) & 1
        bits = sum(((zlib.crc32(end, 1 << b) & 1) ^ last) << b for b in range(32))
        return (np.bitwise_count(self.crc & np.uint32(bits)) & 1) ^ last

    def moves(self) -> np.ndarray:
        at = np.arange(len(self.names))
        best = self.modularity(at)
        for r in count():
            now = at.copy()
            half = self.half(r)
            for h in (0, 1):
                n, to, _ = self.offers(now, half == h)
                now = now.copy()
                now[n] = to
            if (now == at).all():
                n, to, _ = self.offers(at, np.ones(len(at), bool))
                if not len(n):
                    return at
            got = self.modularity(now)
            if got <= best + 1e-12:
                n, to, d = self.offers(at, np.ones(len(at), bool))
                if not len(n):
                    return at
                good = self.apart(at, n, to, d)
                now = at.copy()
                now[n[good]] = to[good]
                got = self.modularity(now)
            at, best = now, got


class Shared(Small):
    """Small over nodes that share groups; the edges are counted, never listed.

    group, node, n: how many members of a group a node stands for, each pair once, by group. Two nodes' weight is the sum
    of both numbers' product over their groups, a loop's of n * (n - 1), as if all members were nodes that were folded.
    """

    #: Counts held at once, of groups by communities; entries worked on at once by each of so many threads; nodes up to whose square edges are listed.
    COUNTS, AT_ONCE, THREADS, LISTED = 16_000_000, 200_000, 4, 1_000
    #: Counts kept from one use to the next.
    HELD = 1_000_000

    def __init__(self, names: list, group: np.ndarray, node: np.ndarray, n: np.ndarray, gamma: float, seed: int):
        self.size = np.bincount(group, n).astype(np.int64)
        order = np.argsort(node, kind="stable")
        of, part = group[order].astype(np.int32), n[order].astype(np.int32)
        del order
        rows = np.bincount(node, minlength=len(names))
        first = np.cumsum(rows) - rows
        alike = twins(of, part, first, rows)
        same, self.kind = np.unique(alike, return_inverse=True)
        self.rows = rows[same]
        self.first = np.cumsum(self.rows) - self.rows
        kept = spread(first[same], self.rows)
        self.of, self.part = of[kept], part[kept]
        del of, part, kept
        self.nodes, self.alike = np.argsort(self.kind, kind="stable"), np.bincount(self.kind, minlength=len(same))
        self.begins = np.cumsum(self.alike) - self.alike
        self.twice = np.add.reduceat(self.part * self.part.astype(np.int64), self.first)
        self.many = np.argsort(-self.rows, kind="stable")
        self.each = np.add.reduceat(self.part * (self.size[self.of] - 1.0), self.first)
        k = self.each[self.kind]
        self.begin(names, k, float(k.sum()), gamma, seed)
        self.slack, self.seen, self.held = np.full(len(names), -np.inf), None, None

    def counts(self, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(group, community, members) for communities numbered below n, by both."""
        if self.held is None or not np.array_equal(c, self.held[0]):
            bits = int(n).bit_length()
            if len(self.rows) == len(c):
                v, there, alike = np.arange(len(c)), c, np.ones(len(c), np.int32)
            else:
                key, alike = gathered(self.kind << bits | c, np.ones(len(c), np.int32))
                v, there = key >> bits, key & (1 << bits) - 1
            mine = spread(self.first[v], self.rows[v])
            key, members = gathered(self.of[mine].astype(np.int64) << bits | np.repeat(there, self.rows[v]), self.part[mine] * np.repeat(alike, self.rows[v]))
            self.held = c, (key >> bits, key & (1 << bits) - 1, members)
        found = self.held[1]
        if len(found[0]) > self.HELD:
            self.held = None
        return found

    def inside(self, c: np.ndarray) -> float:
        n = self.counts(c, len(self.names))[2]
        return float((n * (n - 1)).sum())

    def folded(self, c: np.ndarray) -> Small:
        kept, to = np.unique(c, return_inverse=True)
        group, of, n = self.counts(to, len(kept))
        names = [self.names[i] for i in kept]
        if len(kept) > self.LISTED:
            return Shared(names, group, of, n, self.gamma, self.seed)
        w, size = np.zeros(len(kept) ** 2, np.int64), np.bincount(group, minlength=len(self.size))
        first = np.cumsum(size) - size
        for lot in lots(size[group], max(self.AT_ONCE, len(w))):
            x, y = np.repeat(lot, size[group[lot]]), spread(first[group[lot]], size[group[lot]])
            w += np.bincount(of[x] * len(kept) + of[y], n[x] * (n[y] - (x == y)), len(w)).astype(np.int64)
        edges = np.flatnonzero(w)
        return Small(names, edges // len(kept), edges % len(kept), w[edges].astype(float), self.total, self.gamma, self.seed)

    def offers(self, c: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self.loosen(c)
        mine = mine & (self.slack <= 1e-8 + 1e-10 * self.k)
        v = self.many[np.bincount(self.kind[mine], minlength=len(self.rows))[self.many] > 0]
        if not len(v):
            return v, v, v * 0.0
        kept, to = np.unique(c, return_inverse=True)
        mass, there = np.bincount(to, self.k, len(kept)), self.counts(c, len(self.names))
        number = np.zeros(len(self.names), np.int64)
        number[kept] = np.arange(len(kept))
        there = there[0], number[there[1]], there[2]
        size = np.bincount(there[0], minlength=len(self.size))
        met = np.add.reduceat(size[self.of], self.first)
        if len(kept) * len(size) <= self.COUNTS and len(kept) * (len(v) * (self.rows.mean() + 10) + 2 * len(size)) <= 50 * met[v].sum():
            count = np.zeros((len(size), len(kept)), np.int64)
            count[there[:2]] = there[2]
            count = count.astype(np.int32) if self.k.max() < 2**31 else count
            each = max(1, 131_072 // len(kept))
            parts, work = np.split(v, range(each, len(v), each)), lambda *a: self.likely(*a, mass, count)
        else:
            parts, work = [v[lot] for lot in lots(met[v], self.AT_ONCE)], lambda *a: self.near(*a, len(kept), size, *there[1:])
        with ThreadPoolExecutor(self.THREADS) as pool:
            found = list(pool.map(lambda v: self.best(v, mine, to, mass, work), parts))
        n, best, d = (np.concatenate(v) for v in zip(*found, strict=True))
        return n, kept[best], d

    def loosen(self, c: np.ndarray) -> None:
        """Lower slack, how far each node at least is from a gain by a move, by all that moves since it was known can have changed."""
        mass = np.bincount(c, self.k, len(c))
        if self.seen is not None:
            moved, more = c != self.seen[0], mass - self.seen[1]
            met = np.bincount(self.kind[moved], minlength=len(self.rows))
            met = np.bincount(self.of, self.part * np.repeat(met, self.rows), len(self.size))
            met = np.add.reduceat(self.part * met[self.of], self.first)
            self.slack -= 2 * met[self.kind] + self.gamma * self.k * (more[c] - more.min(initial=0)) / self.total
            self.slack[moved] = -np.inf
        self.seen = c, mass

    def near(self, v: np.ndarray, j: np.ndarray, own: np.ndarray, k: int, size: np.ndarray, there: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(i, community, weight): all that nodes of kind v[i] have members in; and the weight to own[i] of one of kind v[j[i]]. size: of the groups' communities there, with members."""
        mine = spread(self.first[v], self.rows[v])
        n, i = size[self.of[mine]], np.repeat(np.arange(len(v)), self.rows[v])
        met = spread((np.cumsum(size) - size)[self.of[mine]], n)
        bits = int(k).bit_length()
        key, w = gathered(np.repeat(i << bits, n) | there[met], np.repeat(self.part[mine], n) * members[met])
        return key >> bits, key & (1 << bits) - 1, w, w[np.searchsorted(key, j << bits | own)]

    def likely(self, v: np.ndarray, j: np.ndarray, own: np.ndarray, mass: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """near(), but of the communities only those that rounding could make the best or the second. v: by number of groups, most first."""
        w, i = np.zeros((len(v), len(mass)), count.dtype), np.arange(len(v))
        for r in range(self.rows[v[0]] if len(v) else 0):
            at = self.first[v[: np.searchsorted(-self.rows[v], -r)]] + r
            met = count[self.of[at]]
            w[: len(at)] += met if (self.part[at] == 1).all() else met * self.part[at].astype(count.dtype)[:, None]
        gain = np.multiply.outer(self.each[v] * -self.gamma / self.total, mass)
        gain += w
        gain[w == 0] = -np.inf
        top = gain.argmax(axis=1)
        most = gain[i, top]
        gain[i, top] = -np.inf
        second = gain.max(axis=1, initial=-np.inf)
        gain[i, top] = most
        low = np.where(second > -np.inf, second, most) - 3e-9 - 1e-12 * w.max(initial=0)
        i, there = np.nonzero(gain >= low[:, None])
        return i, there, w[i, there], w[j, own]

    def best(self, v: np.ndarray, mine: np.ndarray, to: np.ndarray, mass: np.ndarray, work: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The offers of those nodes of mine that are of kinds v. Nodes of a kind gain the same by a move, and leave out their own community."""
        x, j = self.nodes[spread(self.begins[v], self.alike[v])], np.repeat(np.arange(len(v)), self.alike[v])
        x, j = x[mine[x]], j[mine[x]]
        own = to[x]
        i, there, w, inside = work(v, j, own)
        gain = np.round(w - self.gamma * self.each[v][i] * mass[there] / self.total, 9)
        stay = np.round(inside - self.twice[v][j] - self.gamma * self.k[x] * (mass[own] - self.k[x]) / self.total, 9)
        begin = starts(i)
        most, top = highest(gain, begin, i)
        gain[top] = -np.inf
        second, other = highest(gain, begin, i)
        alone = there[top][j] == own
        most, best = np.where(alone, second[j], most[j]), there[np.where(alone, other[j], top[j])]
        self.slack[x] = stay - np.maximum(most, 0)
        go = most > stay
        return x[go], best[go], most[go] - stay[go]


def twins(of: np.ndarray, part: np.ndarray, first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each node, one with the same rows (of, part), from first on. Sums of random numbers find it; then the rows are compared."""
    salt = np.random.default_rng(0).integers(1, 2**63, of.max(initial=0) + 1, np.uint64)
    every, alike = np.arange(len(rows)), np.add.reduceat(salt[of] * part.astype(np.uint64), first) if len(of) else rows
    _, least, at = np.unique(alike, return_index=True, return_inverse=True)
    alike = least[at]
    same = rows == rows[alike]
    for lot in lots(rows, 1_000_000):
        lot = lot[same[lot]]
        x, y = spread(first[lot], rows[lot]), spread(first[alike[lot]], rows[lot])
        differ = (of[x] != of[y]) | (part[x] != part[y])
        same[np.repeat(lot, rows[lot])[differ]] = False
    return np.where(same, alike, every)


def highest(x: np.ndarray, begin: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest x of each i, and where it is first; i from 0 on, each beginning at `begin`."""
    if not len(x):
        return x, begin
    most = np.maximum.reduceat(x, begin)
    top = np.flatnonzero(x == most[i])
    return most, top[starts(i[top])]


def starts(x: np.ndarray) -> np.ndarray:
    """Where a sorted array's values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])


def gathered(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys, sorted, each once, and the sum of its n."""
    if (n == n[:1]).all():
        key = np.sort(key)
        first = starts(key)
        return key[first], np.diff(np.r_[first, len(key)]) * n[:1]
    bits = int(n.max()).bit_length()
    if int(key.max()) < 2 ** (63 - bits):
        key = np.sort(key << bits | n)
        n, key = key & (1 << bits) - 1, key >> bits
        first = starts(key)
        return key[first], np.add.reduceat(n, first)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = starts(key)
    return key[first], np.add.reduceat(n, first)


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., n[0] of them; then first[1] and so on."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def lots(n: np.ndarray, at_once: int) -> list[np.ndarray]:
    """Places in n, in turn, in lots that have about at_once in all."""
    end = np.cumsum(n)
    return np.split(np.arange(len(n)), np.searchsorted(end, np.arange(at_once, end[-1], at_once))) if len(n) else []


def levelled(graph: Small, levels: int | None) -> np.ndarray:
    """For each node, the number of its community after all levels."""
    place = np.arange(len(graph.names))
    for _ in count() if levels is None else range(levels):
        c = graph.moves()
        if (c == np.arange(len(c))).all():
            break
        place = np.unique(c, return_inverse=True)[1][place]
        graph = graph.folded(c)
    return place


def named(df: DataFrame, names: list, place: np.ndarray, kind: str) -> DataFrame:
    """(node, community): names, in order, with the least of those of one place."""
    least = np.full(len(names), len(names))
    np.minimum.at(least, place, np.arange(len(names)))
    rows = pa.table({"node": names, "community": [names[i] for i in least[place]]})
    return df.sparkSession.createDataFrame(rows, f"node {kind}, community {kind}")


def small_communities(both: DataFrame, gamma: float, seed: int, levels: int | None) -> DataFrame:
    """communities() of a graph (x, y, w) on the driver."""
    held = both.toPandas()
    names = sorted(set(held["x"]))
    code = {v: i for i, v in enumerate(names)}
    x, y, w = held["x"].map(code).to_numpy(np.int64), held["y"].map(code).to_numpy(np.int64), held["w"].to_numpy(float)
    return named(both, names, levelled(Small(names, x, y, w, float(w.sum()), gamma, seed), levels), both.schema["x"].dataType.simpleString())


#: Rows of groups and nodes up to which communities of what shares groups are found on the driver.
SHARED = 10_000_000


def shared_communities(rows: DataFrame, group: str, node: str, gamma: float = 1.0, seed: int = 42, levels: int | None = None, small: int = SHARED) -> DataFrame:
    """communities(coread(rows, group, node)): the same ones, but up to `small` rows without a row for each pair of a group's nodes."""
    held = rows.select(group, node).dropna().groupBy(group).agg(F.collect_set(node).alias("u")).filter(F.size("u") > 1)
    held = stored(held.select("u"), "groups")
    if not 0 < (held.agg(F.sum(F.size("u"))).first()[0] or 0) <= small:
        return communities(coread(rows, group, node), gamma=gamma, seed=seed, levels=levels)
    lists = held.toArrow().column("u").combine_chunks()
    n = np.asarray(lists.value_lengths()).astype(np.int64)
    every = lists.flatten().dictionary_encode()
    names = sorted(every.dictionary.to_pylist())
    at = pc.index_in(every.dictionary, pa.array(names, every.type.value_type)).to_numpy()[every.indices.to_numpy()]
    del lists, every
    graph = Shared(names, np.repeat(np.arange(len(n)), n), at, np.ones(len(at), np.int32), gamma, seed)
    return named(held, names, levelled(graph, levels), rows.schema[node].dataType.simpleString())


def communities(edges: DataFrame, a: str = "a", b: str = "b", weight: str = "n", gamma: float = 1.0, seed: int = 42, levels: int | None = None, small: int = SMALL) -> DataFrame:
    """(node, community): nodes of weighted edges grouped so that more weight lies inside than chance has; named by their least node.

    Nodes are moved until none gains by it, then each community counts as one node, until none of these moves or
    `levels`, if given, are done. Equal gains go to the own community, then to the least: a seed gives the same groups
    on every run. Edges with a null end or a weight of 0 or less are none. A graph of up to `small` edges is moved on
    the driver, a larger one in rounds of joins; the rounds are the same.
    """
    flat = edges.select(F.col(a).alias("x"), F.col(b).alias("y"), F.col(weight).cast("double").alias("w")).dropna().filter("w > 0")
    both = stored(flat.union(flat.select("y", "x", "w")).groupBy("x", "y").agg(F.sum("w").alias("w")), "graph")
    if 0 < both.limit(small + 1).count() <= small:
        return small_communities(both, gamma, seed, levels)
    total = both.agg(F.sum("w")).first()[0]
    place = both.select(F.col("x").alias("node"), F.col("x").alias("community")).distinct()
    for _ in (count() if levels is None else range(levels)) if total else ():
        moved = _moves(both, total, gamma, seed)
        if moved.filter("node <> c").isEmpty():
            break
        place = stored(place.join(moved.withColumnRenamed("node", "community"), "community").select("node", F.col("c").alias("community")), "communities")
        x, y = moved.select(F.col("node").alias("x"), F.col("c").alias("cx")), moved.select(F.col("node").alias("y"), F.col("c").alias("cy"))
        both = stored(both.join(x, "x").join(y, "y").groupBy(F.col("cx").alias("x"), F.col("cy").alias("y")).agg(F.sum("w").alias("w")), "graph")
    least = place.groupBy("community").agg(F.min("node").alias("least"))
    return place.join(least, "community").select("node", F.col("least").alias("community"))
