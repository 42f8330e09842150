"""A content-addressed WARC archive.

The archive is two tables. ``payloads`` holds the bytes of each distinct payload once, under
their SHA-256. ``headers`` holds the exact bytes of each record in front of its payload, the
WARC header block and the HTTP header of the response, and which payload it goes with. A WARC
record is rebuilt by joining the two; a revisit record is its headers alone. Duplicates are
found by joins on digests (small rows; their skewed keys are split by adaptive execution), and
payload bytes move once, for the distinct ones.

Payloads are taken as equal if their SHA-256 is. Writing fails if two of one digest differ in
length or in another 128 bits of hashes; ``verify`` compares stored bytes with their digests.

Cases: null html is an empty payload; payloads below ``min_revisit`` bytes are never revisits;
rows that repeat both id and payload are the same page, written as a record for each row, all
with ids of their own, and all of them are responses if one is; a null id comes last and is
named by an empty id; other columns aren't read; a url is percent-encoded where it has bytes
a header line can't hold (a space, a control character or a per cent sign), and is decoded when it
is read; a null url is written, and read, as an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwatch.llm.shared import shared_dir

MIN_REVISIT = 100
CRLF = "\r\n"
#: Names every record of this archive.
URN = "urn:loomwatch:page:"
#: Characters of a url that are written as codes in a header line; the first one is that of the codes.
ESCAPED = "% " + "".join(map(chr, range(32))) + "\x7f"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _safe(url: Column) -> Column:
    """The url without characters that would end a header line, each as a per cent sign and two digits."""
    out = F.coalesce(url, F.lit(""))
    for char in ESCAPED:
        out = F.replace(out, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return out


def _unsafe(url: Column) -> Column:
    for char in reversed(ESCAPED):
        url = F.replace(url, F.lit(f"%{ord(char):02X}"), F.lit(char))
    return url


def _record_id(page: Column, url: Column, digest: Column, no: Column) -> Column:
    """A record's id, of its own also where rows repeat a page's id: the page, a hash of url and payload, and a number of equal rows."""
    of = F.substring(F.sha1(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), digest)), 1, 16)
    return F.concat(F.lit(f"<{URN}"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), of, F.lit(":"), no.cast("string"), F.lit(">"))


def _header(date: str) -> Column:
    """The exact bytes of a record in front of its payload, as text. Of rows (page, url, digest, size, no, kind, first)."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(2 * CRLF))
    revisit = F.concat(
        _line("WARC-Refers-To", _record_id(F.col("first.page"), F.col("first.url"), F.col("digest"), F.lit(1))),
        _line("WARC-Refers-To-Target-URI", _safe(F.col("first.url"))),
        _line("WARC-Refers-To-Date", F.lit(date)),
        _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    )
    is_revisit = F.col("kind") == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.col("kind")),
        _line("WARC-Record-ID", _record_id(F.col("page"), F.col("url"), F.col("digest"), F.col("no"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", _safe(F.col("url"))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(is_revisit, revisit).otherwise(F.lit("")),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", (F.octet_length(http) + F.when(is_revisit, F.lit(0).cast("long")).otherwise(F.col("size"))).cast("string")),
        F.lit(CRLF),
        http,
    )


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``path/payloads`` (digest, payload) and ``path/headers`` (record_id, digest, record_type, header). date: when the pages were fetched."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.select("page", "url", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"), "payload")
    other = F.struct("size", F.xxhash64("payload"), F.xxhash64("payload", F.lit(1)))
    stored = rows.select("digest", "payload", other.alias("o")).groupBy("digest").agg(F.first("payload").alias("payload"), F.min("o").alias("a"), F.max("o").alias("b"))
    stored.select("digest", F.when(F.col("a") == F.col("b"), F.col("payload")).otherwise(F.raise_error(F.lit("two payloads have one SHA-256"))).alias("payload")).write.parquet(f"{path}/payloads")
    # Rows that are alike but for their payload are numbered.
    small = rows.groupBy("page", "url", "digest", "size").agg(F.count(F.lit(1)).alias("rows"))
    last = F.col("page").isNull()
    firsts = small.where(F.col("size") >= min_revisit).groupBy("digest").agg(F.min(F.struct(last.alias("last"), "page", "url")).alias("first"))
    known = small.join(firsts, "digest", "left").select("*", F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("no"))
    kind = F.when(F.col("first").isNull() | F.col("first.page").eqNullSafe(F.col("page")), F.lit("response")).otherwise(F.lit("revisit"))
    known = known.withColumn("kind", kind)
    known.select(_record_id(F.col("page"), F.col("url"), F.col("digest"), F.col("no")).alias("record_id"), "digest", F.col("kind").alias("record_type"), _header(date).cast("binary").alias("header")).write.parquet(f"{path}/headers")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    payloads = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    headers = spark.read.schema("record_id string, digest string, record_type string, header binary").parquet(f"{path}/headers")
    return headers, payloads


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record): the exact bytes of each record: headers, payload and the two ending lines."""
    headers, payloads = _tables(spark, path)
    end = F.lit(2 * CRLF).cast("binary")
    full = headers.where("record_type <> 'revisit'").join(payloads, "digest").select("record_id", F.concat("header", "payload", end).alias("record"))
    return full.unionByName(headers.where("record_type = 'revisit'").select("record_id", F.concat("header", end).alias("record")))


def parse_header(header: Column) -> Column:
    """The fields of the WARC header block, as a map by lower-case name."""
    lines = F.filter(F.split(F.substring_index(header.cast("string"), 2 * CRLF, 1), CRLF), lambda x: F.instr(x, ": ") > 0)
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.lower(F.substring_index(x, ": ", 1)).alias("k"), F.substring(x, F.instr(x, ": ") + 2, F.length(x)).alias("v"))))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, from the archive alone: page (string), url, record_type, refers_to (string), and digest and size of its full payload, recomputed from the stored bytes."""
    headers, payloads = _tables(spark, path)
    fields = parse_header(F.col("header"))
    page = lambda x: F.regexp_extract(x, f"^<{URN}(.*):[0-9a-f]{{16}}:[0-9]+>$", 1)
    parsed = headers.select(fields.alias("f")).select(
        page(F.col("f")["warc-record-id"]).alias("page"),
        _unsafe(F.col("f")["warc-target-uri"]).alias("url"),
        F.col("f")["warc-type"].alias("record_type"),
        page(F.col("f")["warc-refers-to"]).alias("refers_to"),
        F.regexp_replace(F.col("f")["warc-payload-digest"], "^sha256:", "").alias("digest"),
    )
    stored = payloads.select("digest", F.sha2("payload", 256).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    return parsed.join(stored, "digest").drop("digest")


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Payloads whose bytes don't have the digest they are stored under, and records without a payload: none, if all is well."""
    headers, payloads = _tables(spark, path)
    wrong = payloads.where(F.sha2("payload", 256) != F.col("digest")).select("digest", F.lit("payload differs").alias("fault"))
    return wrong.unionByName(headers.join(payloads, "digest", "left_anti").select("digest", F.lit("no payload").alias("fault")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages to an archive and reads the records back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    number = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return read_archive(spark, path).select(number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


QUERIES = {"op7_warc": op7_warc}
SQL = {
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages
), f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)"""
}
