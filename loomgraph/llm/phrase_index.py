"""Benchmark decontamination over a positional inverted index.

The index holds training token postings: term, document, position. Which terms need lists, the benchmark decides: each
of its windows is looked up by its two rarest terms, rarity counted over the whole corpus. The list of the rarest,
shifted by the distance of the two, is intersected with the list of the second-rarest; what both hold are candidates,
and the tokens around these, read from the documents that have any, are compared with the window in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.llm.common import ascii_lower, split_by, stored, table, without

#: Words are what stands between these, in lower-cased text and in text as it is.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: Terms or pairs of terms, of about 50 bytes each, that are broadcast at most; more of them are joined by shuffles.
BLOCK = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def windows(items: DataFrame, key: str = "item_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """(item_id, terms): each window of `length` consecutive words of an item once; a shorter item is one window."""
    w = items.select(F.col(key).alias("item_id"), words(F.col(text)).alias("w")).filter("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - length + 1)))
    return w.select("item_id", "w", starts.alias("s")).select("item_id", F.slice("w", F.col("s"), F.lit(length)).alias("terms")).distinct()


def documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, h, w): h tells apart rows that repeat a doc_id with another text."""
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h"), words(F.col(text)).alias("w"))


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, h, pos, term): every word of every row."""
    return documents(docs, key, text).select("doc_id", "h", F.posexplode("w").alias("pos", "term"))


def frequencies(docs: DataFrame, terms: DataFrame, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """(term, n): how often each of terms, a stored table, occurs in the corpus, counted in each task before the shuffle."""
    seen = documents(docs, key, text).select(F.explode("w").alias("term"))
    if terms.count() <= block:
        return seen.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    _, maybe = split_by(seen, [F.col("term")], terms, ["term"])
    return maybe.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term", "left_semi")


def anchors(queries: DataFrame, freq: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each phrase (qid, terms) with its two rarest terms: first, at (offset), second, delta (second's distance).

    Phrases with a term that the corpus lacks have no match and drop out; a phrase of one term has itself as second.
    freq is a stored table.
    """
    each = queries.select("qid", "terms", F.posexplode("terms").alias("at", "term")).join(F.broadcast(freq) if freq.count() <= block else freq, "term", "left")
    ranked = each.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "at"))).alias("r"), F.first("terms").alias("terms"))
    second = F.coalesce(F.get(F.filter("r", lambda x: x["term"] != F.col("r")[0]["term"]), F.lit(0)), F.col("r")[F.size("r") - 1])
    return ranked.filter(F.col("r")[0]["n"] > 0).select(
        "qid", "terms", F.col("r")[0]["term"].alias("first"), F.col("r")[0]["at"].alias("at"), second["term"].alias("second"), (second["at"] - F.col("r")[0]["at"]).alias("delta")
    )


def postings(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(term, doc_id, h, pos): the posting lists of terms (a stored table with a column term), or of all; repeated rows post once."""
    seen = tokens(docs, key, text)
    if terms is not None and terms.count() <= block:
        seen = seen.join(F.broadcast(terms), "term", "left_semi")
    elif terms is not None:
        seen = split_by(seen, [F.col("term")], terms, ["term"])[1].join(terms.hint("merge"), "term", "left_semi")
    return seen.select("term", "doc_id", "h", "pos").distinct()


def intersected(lists: DataFrame, pairs: DataFrame, span: int | None = None, block: int = BLOCK) -> DataFrame:
    """(first, second, delta, doc_id, h, pos): postings of `first` with `second` at distance delta, or nearer than span either way."""
    left = lists.withColumnRenamed("term", "first").join(F.broadcast(pairs) if pairs.count() <= block else pairs, "first")
    right = lists.select(F.col("term").alias("t"), F.col("doc_id").alias("d"), F.col("h").alias("g"), F.col("pos").alias("p"))
    same = (F.col("second") == F.col("t")) & F.col("doc_id").eqNullSafe(F.col("d")) & F.col("h").eqNullSafe(F.col("g"))
    if span is None:
        both = left.withColumn("want", F.col("pos") + F.col("delta")).join(right, same & (F.col("want") == F.col("p")))
    else:
        left = left.withColumn("cell", F.explode(F.array(*[F.expr(f"pos div {span} + {i}") for i in (-1, 0, 1)])))
        both = left.join(right.withColumn("c", F.expr(f"p div {span}")), same & (F.col("cell") == F.col("c"))).filter(F.abs(F.col("pos") - F.col("p")) < span)
    return both.select("first", "second", "delta", "doc_id", "h", "pos").distinct()


def around(docs: DataFrame, hits: DataFrame, reach: int, key: str, text: str) -> DataFrame:
    """hits, a stored table, with `around`, up to `reach` tokens on each side, and `before`, how many of them precede it."""
    at = hits.groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "second", "delta", "pos")).alias("hits"))
    named = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    _, held = split_by(named, [F.col("doc_id"), F.col("h")], hits.select("doc_id", "h").distinct(), ["doc_id", "h"])
    held = held.dropDuplicates(["doc_id", "h"]).select(F.col("doc_id").alias("d"), F.col("h").alias("g"), words(F.col("text")).alias("w"))
    both = at.join(held.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    low = lambda x: F.greatest(F.lit(0), x["pos"] - reach)
    seen = lambda x: F.struct(x.alias("x"), (x["pos"] - low(x)).alias("before"), F.slice("w", low(x) + 1, x["pos"] + reach + 1 - low(x)).alias("around"))
    return both.select("doc_id", "h", F.explode(F.transform("hits", seen)).alias("s")).select("s.x.*", "doc_id", "h", "s.before", "s.around")


def candidates(docs: DataFrame, queries: DataFrame, key: str, text: str, reach: int, block: int, span: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The anchors of queries (qid, terms), and around() of what their lists have in common."""
    terms = stored(queries.select(F.explode("terms").alias("term")).distinct(), "terms")
    found = stored(anchors(queries, stored(frequencies(docs, terms, key, text, block), "frequencies"), block), "anchors")
    delta = F.col("delta") if span is None else F.lit(0)
    pairs = stored(found.select("first", "second", delta.alias("delta")).distinct(), "pairs")
    rare = stored(pairs.select(F.explode(F.array("first", "second")).alias("term")).distinct(), "rare")
    lists = stored(postings(docs, rare, key, text, block), "postings")
    hits = stored(intersected(lists, pairs, span, block), "candidates")
    return found, stored(around(docs, hits, reach, key, text), "around")


def phrase_matches(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", reach: int = WINDOW - 1, block: int = BLOCK) -> DataFrame:
    """(qid, doc_id, h, start, length): every exact occurrence of the phrases (qid, terms) in docs; reach: the longest less one.

    h is the hash of the row's text; rows that repeat an id and a text have one row an occurrence together. Null texts
    and ids, empty tables and phrases are as in decontaminate().
    """
    found, seen = candidates(docs, queries, key, text, reach, block)
    start = F.col("before") - F.col("at")
    hit = seen.join(found, ["first", "second", "delta"]).filter((start >= 0) & (F.slice("around", F.greatest(start, F.lit(0)) + 1, F.size("terms")) == F.col("terms")))
    return hit.select("qid", "doc_id", "h", (F.col("pos") - F.col("at")).alias("start"), F.size("terms").alias("length"))


def proximity_matches(docs: DataFrame, queries: DataFrame, span: int, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(qid, doc_id, pos): places where all terms of a query (qid, terms) stand within `span` consecutive words.

    pos is that of the rarest term; its list is intersected with the second-rarest's, the others are searched in the
    tokens around. Nulls and repeated rows are as in phrase_matches().
    """
    found, seen = candidates(docs, queries, key, text, span - 1, block, span)
    place = lambda s: F.forall("terms", lambda t: F.array_contains(F.slice(F.col("around"), s, F.lit(span)), t))
    near = F.exists(F.sequence(F.lit(1), F.col("before") + 1), place)
    return seen.join(found.select("qid", "terms", "first", "second"), ["first", "second"]).filter(near).select("qid", "doc_id", "pos")


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is `length` consecutive words of an item (all of a shorter one); words inside any occurrence are hit, and
    a document of which a twentieth is hit is contaminated. Null and empty texts have no words, no hits and are clean;
    without items nothing is hit. Items that repeat count once by their id. Rows that repeat a doc_id are judged apart.
    """
    return judged(docs, items, key, text, item, item_text, length).drop("h")


def judged(docs: DataFrame, items: DataFrame, key: str, text: str, item: str = "item_id", item_text: str = "text", length: int = WINDOW) -> DataFrame:
    """What decontaminate() returns, and the hash h of the row's text."""
    held = stored(windows(items, item, item_text, length), "windows")
    phrases = held.select("terms").distinct()
    number = F.row_number().over(W.partitionBy(F.xxhash64("terms")).orderBy("terms"))
    phrases = stored(phrases.select(F.struct(F.xxhash64("terms").alias("a"), number.alias("b")).alias("qid"), "terms"), "phrases")
    owners = stored(held.join(phrases, "terms").select("qid", F.col("item_id").alias("item")), "owners")
    hits = stored(phrase_matches(docs, phrases, key, text, length - 1), "hits")
    places = hits.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("places"))

    def sweep(a: Column, p: Column) -> Column:
        end = p["start"] + p["length"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(p["start"], a["end"]))).alias("n"), F.greatest(a["end"], end).alias("end"))

    covered = F.aggregate("places", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), sweep)["n"]
    named = hits.select("doc_id", "h", "qid").distinct().join(owners, "qid")
    ids = named.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("ids"))
    both = places.select("doc_id", "h", covered.alias("n_hit")).join(ids.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "g"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    both = both.select(F.col("doc_id").alias("hit_id"), F.col("h").alias("hit_h"), "n_hit", "ids")
    all_docs = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("h"), F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), BETWEEN_ANY_CASE), "")).cast("long").alias("n_words"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return all_docs.join(both, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("h") == F.col("hit_h")), "left").select(
        "doc_id",
        "h",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; nulls and repeated rows as in decontaminate()."""
    bad = stored(judged(docs, items, key, text).filter("contaminated").select("doc_id", "h").distinct(), "contaminated")
    return without(docs, [F.col(key), F.xxhash64(text)], bad, ["doc_id", "h"])


def op6_positional_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP6_SQL = r"""
WITH lo AS (SELECT translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, doc_id FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lo),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM i WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM q),
dw AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS p FROM (SELECT doc_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS s FROM d, ns)),
h AS (SELECT doc_id, s, n, item_id FROM dw JOIN q USING (p, n)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
