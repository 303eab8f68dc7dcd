"""A content-addressed WARC archive: payload bytes once by verified digest, exact record headers apart.

write() makes two tables. `payloads` holds the bytes of each distinct payload under its SHA-256; `headers` holds, for
each record, its exact header block and the digest of the payload it stands for. read() joins the two back into the
records. The first record of a payload is a response, the others are revisits that refer to it and carry no body.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import scratch, shared_dir, split_by, stored, table

#: Every record has the date of the crawl; a parameter, since pages have none.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RADIX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(body: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    h = F.sha1(body)
    parts = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), RADIX32, BASE32)


def record_uri(key: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


UNSAFE = {"%": "%25", "\r": "%0D", "\n": "%0A", "\t": "%09", " ": "%20"}
#: The line that says that a target had characters which end a line or a value, and stands in percent codes.
ESCAPED = "X-Target-URI-Escaped"


def unsafe(url: Column) -> Column:
    return F.coalesce(url.rlike(r"[\r\n\t ]"), F.lit(False))


def clean_uri(url: Column) -> Column:
    """The target as a header holds it: as it is, or in percent codes if it is unsafe(); null is empty."""
    out = F.coalesce(url, F.lit(""))
    for c, code in UNSAFE.items():
        out = F.replace(out, F.lit(c), F.lit(code))
    return F.when(unsafe(url), out).otherwise(F.coalesce(url, F.lit("")))


def target(head: str = "header") -> Column:
    """The target that a header was written for, exactly."""
    said = F.regexp_extract(F.col(head), r"\r\nWARC-Target-URI: ([^\r\n]*)\r\n", 1)
    out = said
    for c, code in reversed(UNSAFE.items()):
        out = F.replace(out, F.lit(code), F.lit(c))
    return F.when(F.contains(F.col(head), F.lit(f"\r\n{ESCAPED}: true\r\n")), out).otherwise(said)


def header(key: Column, url: Column, kind: Column, first: Column, sha1: Column, length: Column, date: str) -> Column:
    """The header block, up to and with the empty line that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", record_uri(key)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", clean_uri(url)),
        F.when(unsafe(url), line(ESCAPED, F.lit("true"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        F.when(revisit, F.concat(line("WARC-Refers-To", record_uri(first)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(length.cast("string"))),
        F.lit("\r\n"),
    )


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", date: str = DATE, least: int = 0) -> None:
    """Write pages as an archive below path.

    A null html is an empty payload, a null url an empty target. Of equal payloads of at least `least` bytes the
    record with the smallest key is the response (rows that repeat that key and payload are responses too; a null
    key is larger than any); shorter payloads are all responses. An empty table gives an empty archive; other columns
    play no part. Only digests are grouped; payloads go from the scan to the archive, but for the few rows that may
    not be the one that stores theirs. Payloads of one SHA-256 must agree in SHA-1 and length, or the write fails.
    """
    with scratch(pages.sparkSession):
        body = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
        named = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.sha2(body, 256).alias("digest"), base32_sha1(body).alias("sha1"), F.octet_length(body).alias("length"))
        both = F.struct("sha1", "length")
        firsts = named.groupBy("digest").agg(F.min("key").alias("first"), F.min(both).alias("least"), F.max(both).alias("most"), F.count("*").alias("rows"))
        wrong = F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("digest")))
        firsts = firsts.withColumn("first", F.when(F.col("least") == F.col("most"), F.col("first")).otherwise(wrong.cast(pages.schema[key].dataType)))
        firsts = stored(firsts.select(F.col("digest").alias("of"), "first", "rows"), "digests")
        revisit = (F.col("length") >= least) & F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
        records = named.join(firsts, F.col("digest") == F.col("of")).withColumn("kind", F.when(revisit, "revisit").otherwise("response"))
        parts = [F.col(c) for c in ("key", "url", "kind", "first", "sha1", "length")]
        records.select("key", "digest", header(*parts, date).alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
        bodies = pages.select(F.col(key).alias("key"), F.sha2(body, 256).alias("digest"), body.alias("payload"))
        more = firsts.filter("rows > 1")
        alone, shared = split_by(bodies, [F.col("digest")], more, ["of"])
        first = shared.join(more.hint("merge"), F.col("digest") == F.col("of"), "left").filter("rows is null or key <=> first")
        once = first.select("digest", "payload").dropDuplicates(["digest"])
        alone.select("digest", "payload").unionByName(once).write.option("compression", "zstd").parquet(f"{path}/payloads")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, header, payload, record): every record of the archive, its payload's bytes checked against their digest; one without is an error.

    `record` is the WARC record itself: header, body (none in a revisit), and the two line ends after it.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    wrong = F.raise_error(F.concat(F.lit("the payload is not what its digest says: "), F.col("digest")))
    checked = payloads.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong.cast("binary")).alias("payload"))
    found = spark.read.parquet(f"{path}/headers").join(checked.withColumnRenamed("digest", "of"), F.col("digest") == F.col("of"), "left")
    lost = F.raise_error(F.concat(F.lit("no payload is stored for the digest "), F.col("digest")))
    both = found.withColumn("payload", F.when(F.col("of").isNull(), lost.cast("binary")).otherwise(F.col("payload")))
    head = F.encode("header", "UTF-8")
    body = F.when(field("WARC-Type") == "revisit", F.unhex(F.lit(""))).otherwise(F.col("payload"))
    return both.select("key", "header", "payload", F.concat(head, body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def field(name: str, head: str = "header") -> Column:
    """The value of a header line."""
    return F.regexp_extract(F.col(head), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)


def op8_content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), path)
    page = lambda name: F.regexp_extract(field(name), r"<urn:x-page:(-?[0-9]+)>", 1)
    at = F.col("record")
    end = F.octet_length(F.encode("header", "UTF-8"))
    kind = field("WARC-Type")
    seen = read(spark, path).withColumn("header", F.decode(F.substring(at, F.lit(1), end), "UTF-8"))
    return seen.select(
        page("WARC-Record-ID").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        kind.alias("record_type"),
        F.when(kind == "revisit", page("WARC-Refers-To").cast("long")).alias("refers_to"),
    )


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
s AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p),
b AS (SELECT *, list_transform(range(0, 32), lambda i: (('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) AS v FROM s)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""
