"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Writing: every row is one WARC/1.1 record with its payload; the records end in two
line ends, which the text sink adds. Rows whose payload equals that of a smaller id
become revisit records without a payload.

Reading: the files are cut at every occurrence of the version line, so tasks read
splits of a file independently. Each cut that looks like a record header emits a
candidate edge from its offset to the offset where its successor must start. Pointer
jumping from offset 0 of each file doubles the known part of the chain in every round; only
reachable candidates are records, so a version line inside a payload is rejected, and its
bytes go back to the payload that holds it.

Defined results: a null payload counts as empty; a null id is written without an id and read
back as null; equal rows are alike (each is a response if its id is the smallest); any
text, with version lines in it too, comes back whole; an empty table gives no rows; only the
named columns are read. Archives are gzip files, one task reads each; with ``compression="none"`` a file is
read in splits. Headers hold no control characters: such characters of a URL
are percent-encoded. Files end at ``records_per_file`` records, which bounds what a file's
window sorts; payloads are shuffled once, to find equal ones, and never when they are read, but for those that hold version lines.
A round trip that reads another number of records than it wrote is an error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blank, shared_dir, store

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 bits, ten hex digits or eight base32 digits, at a time."""
    digits = [F.lpad(F.conv(F.substring(F.sha1(payload.cast("binary")), 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*digits)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_revisit_bytes: int = 0,
    records_per_file: int = 20_000,
    compression: str = "gzip",
) -> None:
    """Write one record per row below ``path``; equal payloads of at least ``least_revisit_bytes`` are stored once."""
    rows = pages.select(
        F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("key"), F.col(url_col).alias("url"), blank(F.col(payload_col)).alias("payload")
    ).withColumns({"digest": base32_sha1(F.col("payload")), "n": F.octet_length("payload").cast("long")})
    first = (
        rows.where(F.col("n") >= least_revisit_bytes).groupBy("digest", "n").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    ).select("digest", "n", "first")
    # both sides grow with the pages; a digest that many pages share is a skewed join's, which Spark splits
    rows = rows.join(first.hint("shuffle_merge"), ["digest", "n"], "left")
    again = F.coalesce(F.col("first") < F.col("key"), F.col("key").isNull() & F.col("first").isNotNull())

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    safe = F.regexp_replace(F.regexp_replace("url", "[\\x00-\\x1f\\x7f]", "%20"), " ", "%20")
    body = F.when(again, "").otherwise(F.col("payload"))
    record = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce("id", F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("n").cast("string")),
        line("WARC-Refers-To", F.when(again, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path, compression=compression)


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at version lines: ``file, value``, with the order within one read (``block, row``).

    ``block`` and ``row`` follow how Spark deals out splits, and so hold for one read only. What is
    read again is found by ``file, size`` and ``mark`` (a hash of the bytes): splits end at cuts, so every read has the same cuts.
    """
    return (
        spark.read.option("lineSep", MAGIC)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
        .withColumns({"row": F.monotonically_increasing_id(), "size": F.octet_length("value").cast("long"), "mark": F.xxhash64("value")})
    )


def _record(value: Column) -> dict[str, Column]:
    """What a cut says if it is a record: its header's fields, and size and digest of the bytes after it."""
    head = F.substring_index(value, END, 1)
    body = value.substr(F.length(head) + 1 + len(END), F.greatest(F.lit(0), F.length(value) - F.length(head) - 2 * len(END)))

    def field(name: str) -> Column:
        return F.nullif(F.regexp_extract(head, rf"(?m)^{name}: <?(.*?)>?\r?$", 1), F.lit(""))

    return {
        "record_type": field("WARC-Type"),
        "record_id": F.nullif(F.regexp_replace(field("WARC-Record-ID"), "^urn:page:", ""), F.lit("")),
        "refers_to": F.regexp_replace(field("WARC-Refers-To"), "^urn:page:", ""),
        "digest": F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""),
        "length": field("WARC-Payload-Length").try_cast("long"),
        "payload_bytes": F.octet_length(body).cast("long"),
        "payload_digest": base32_sha1(body),
        "payload": body,
    }


FIELDS = ["record_type", "record_id", "refers_to", "digest", "length", "payload_bytes", "payload_digest"]


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One narrow row per cut: its place (``file, at``), its bytes' ``size`` and ``mark``, where its successor must start, and its ``FIELDS``.

    ``successor`` is null for a cut that has no whole record header. Payload bytes stay where they were read.
    """
    value = F.col("value")
    length = F.regexp_extract(F.substring_index(value, END, 1), r"(?m)^Content-Length: (\d+)\r?$", 1).try_cast("long")
    prefix = F.octet_length(F.substring_index(value, END, 1)).cast("long") + 2 * len(END) + len(MAGIC)
    said = _record(value)
    span = F.when(F.locate(END, value) > 0, prefix + length).alias("span")
    cuts = store(_cuts(spark, path).select("file", "block", "row", "size", "mark", span, *[said[f].alias(f) for f in FIELDS]), "warc-cuts")
    # every cut but the first of a file follows a version line; the first is what precedes the first line: empty
    before = Window.partitionBy("file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(before), F.lit(0).cast("long")) - len(MAGIC)
    placed = cuts.withColumn("at", at).where("at >= 0").withColumn("successor", F.col("at") + F.col("span"))
    return store(placed.drop("span", "block", "row"), "warc-candidates")


def reachable(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """``file, at`` of the candidates on the chain from offset 0, by pointer jumping: round k knows 2^k of them.

    Both sides of each join grow with the archives: they are shuffled by file and offset, never broadcast.
    """
    jump = edges.where("successor is not null").select("file", "at", F.col("successor").alias("to"))
    known = edges.where("at = 0").select("file", "at")
    size = known.count()
    for _ in range(max_rounds):
        new = known.hint("shuffle_merge").join(jump, ["file", "at"]).select("file", F.col("to").alias("at"))
        known = store(known.unionByName(new).distinct(), "warc-known")
        before, size = size, known.count()
        if size == before:
            return known.hint("shuffle_merge").join(edges.select("file", "at"), ["file", "at"], "left_semi")
        onward = jump.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        jump = store(jump.hint("shuffle_merge").join(onward, ["file", "to"]).select("file", "at", F.col("beyond").alias("to")), "warc-jump")
    raise RuntimeError(f"a chain of more than 2^{max_rounds} records")


PLACE = ["file", "size", "mark"]


def _owned(spark: SparkSession, path: str) -> DataFrame:
    """Every cut with the record that it belongs to: ``file, at, owner, pieces, size, mark`` and ``FIELDS``. Stored."""
    cuts = candidates(spark, path)
    real = reachable(cuts.select("file", "at", "successor"))
    marked = cuts.hint("shuffle_merge").join(real.withColumn("record", F.col("at")), ["file", "at"], "left")
    place = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    # a cut that is no record belongs to the last record before it, with its version line
    owned = marked.withColumn("owner", F.last("record", ignorenulls=True).over(place))
    return store(owned.withColumn("pieces", F.count(F.lit(1)).over(Window.partitionBy("file", "owner"))), "warc-owned")


def _texts(spark: SparkSession, path: str, owned: DataFrame) -> DataFrame:
    """``file, owner, pieces, value`` of the records that ``owned`` names, read again; equal cuts of a file are one text."""
    asked = owned.select("file", "at", "owner", "pieces", "size", "mark")
    # equal bytes are one row however often a file has them, as each asked place finds them
    found = _cuts(spark, path).select(*PLACE, "value").join(asked.select(*PLACE).distinct().hint("shuffle_hash"), PLACE, "left_semi").dropDuplicates(PLACE)
    parts = F.array_sort(F.collect_list(F.struct("at", "value")))
    joined = F.array_join(F.transform(parts, lambda x: x["value"]), MAGIC).alias("value")
    return asked.hint("shuffle_merge").join(found, PLACE).groupBy("file", "owner", "pieces").agg(joined, F.count(F.lit(1)).alias("found")).where(
        F.when(F.col("found") == F.col("pieces"), True).otherwise(F.raise_error(F.lit("an archive changed between two reads")).cast("boolean"))
    ).drop("found")


def index_warc(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, pieces`` and ``FIELDS`` of every record of the archives below ``path``.

    A record whose payload holds version lines was cut in several pieces; only those are read
    again and put together. The digests are of the bytes that were read.
    """
    owned = _owned(spark, path)
    columns = ["file", "at", "pieces", *FIELDS]
    whole = owned.where("pieces = 1").select(columns)
    broken = owned.where("pieces > 1")
    if broken.isEmpty():
        return whole
    said = _record(F.col("value"))
    return whole.unionByName(_texts(spark, path, broken).select("file", F.col("owner").alias("at"), "pieces", *[said[f].alias(f) for f in FIELDS]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives below ``path`` with their payloads: ``file, at, payload`` and ``FIELDS``."""
    said = _record(F.col("value"))
    return _texts(spark, path, _owned(spark, path)).select("file", F.col("owner").alias("at"), *[said[f].alias(f) for f in [*FIELDS, "payload"]])


def warc_round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit_bytes: int = 0) -> DataFrame:
    """Write archives, read them back, and give each record's full payload by size and digest.

    A response's size and digest are computed from the bytes that were read. A revisit's are
    those of the response that it refers to, which the join finds by id and digest.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    kind = dict(pages.dtypes)[id_col]
    write_warc(pages, path, id_col, url_col, payload_col, least_revisit_bytes)
    records = index_warc(spark, path).select(
        F.col("record_id").cast(kind).alias(id_col),
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
        F.col("digest").alias("said"),
        "payload_bytes",
        "payload_digest",
    )
    records = store(records, "warc-records")
    written, read = pages.count(), records.count()
    if written != read:
        raise RuntimeError(f"{written} records were written, {read} were read back")
    responses = records.where("record_type = 'response'")
    targets = responses.select(F.col(id_col).alias("refers_to"), F.col("payload_digest").alias("said"), "payload_bytes", "payload_digest").distinct()
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(targets.hint("shuffle_merge"), ["refers_to", "said"])
    columns = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(columns).unionByName(revisits.select(columns))


SQL = """
WITH rows_ AS (
  SELECT page_id, sha1(coalesce(html, '')) AS hex, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), first_ AS (
  SELECT hex, min(page_id) AS first_id FROM rows_ GROUP BY hex
)
SELECT page_id, payload_bytes,
  translate(upper(
    to_base(CAST('0x' || substr(hex, 1, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(hex, 11, 10) AS BIGINT), 32, 8) ||
    to_base(CAST('0x' || substr(hex, 21, 10) AS BIGINT), 32, 8) || to_base(CAST('0x' || substr(hex, 31, 10) AS BIGINT), 32, 8)
  ), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM rows_ JOIN first_ USING (hex)
"""
