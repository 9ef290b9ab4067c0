"""WARC archives: writing, reading back, and turning repeated payloads into revisit records.

Headers alone are shuffled by payload digest: for each digest of at least ``MIN_BYTES`` bytes the record with the largest id is the original and
the others revisit it. Decisions then meet the payloads by record id, and the archives are written anew with fresh headers: a revisit keeps the
HTTP head and drops the payload. Archives are gzip text written by Spark's own committer, so a lost task leaves no half archive; they are split
again at record starts, so no record and no archive is ever held whole beside others. A payload that itself holds a record start is stored in
base64, named in its HTTP head.

Defined cases: a null payload is an empty one; records under ``MIN_BYTES`` bytes are responses; a null id counts as less than any other; records
that share both id and payload are all treated alike (all responses if theirs is the largest id); a null url is left out; line ends in a url are
percent-encoded; other columns are left out of archives, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, shared_dir

MIN_BYTES = 1000
_MARK = "WARC/1.1\r\n"
_GAP = "\r\n\r\n"
_ID = "urn:record:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``record_id, url, payload, payload_bytes, payload_digest`` of each row."""
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return own.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1(F.col("payload").cast("binary"))})


def resolve_revisits(own: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``own`` with ``record_type`` (response or revisit) and ``refers_to``, the original's id."""
    key = F.coalesce("record_id", F.lit(NULL_ID))
    heads = own.where(F.col("payload_bytes") >= min_bytes).select(key.alias("k"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n"))
    originals = heads.groupBy("d", "n").agg(F.max("k").alias("original"), F.min("k").alias("least")).where("least < original").select("d", "n", "original")
    revisits = heads.join(originals, ["d", "n"]).where("k < original").distinct()
    out = own.withColumn("k", key).join(
        revisits.select("k", F.col("d").alias("payload_digest"), F.col("n").alias("payload_bytes"), "original"), ["k", "payload_digest", "payload_bytes"], "left"
    )
    return out.select(*own.columns, F.when(F.col("original").isNull(), "response").otherwise("revisit").alias("record_type"), F.col("original").alias("refers_to"))


def write_warc(resolved: DataFrame, path: str) -> None:
    """Archives of records that ``resolve_revisits`` has judged."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    unsafe = F.col("payload").contains("WARC/1.")
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").when(unsafe, F.base64(F.col("payload").cast("binary"))).otherwise(F.col("payload"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.when(unsafe & ~revisit, "Content-Transfer-Encoding: base64\r\n").otherwise(""),
        line("Content-Length", F.col("payload_bytes").cast("string")),
        F.lit("\r\n"),
    )
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(_MARK),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", uri("record_id")),
        line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        F.coalesce(line("WARC-Target-URI", url), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", uri("refers_to")), F.lit(f"WARC-Profile: {_PROFILE}\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
    )
    made = resolved.select(head.alias("head"), F.concat(http, body).alias("block"))
    record = F.concat("head", line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), "block", F.lit("\r\n\r"))
    made.select(record.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``record_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of each archived record; of a revisit the payload is
    null, and its length and digest are those in its headers."""
    raw = spark.read.option("lineSep", _GAP + _MARK).text(path).where(F.length("value") > 0)
    head = F.substring_index("value", _GAP, 1)
    raw = raw.select(F.concat(F.lit("\r\n"), head, F.lit("\r\n")).alias("head"), F.col("value").cast("binary").alias("bytes"), F.octet_length(head).alias("at"))
    named = lambda part, name: F.nullif(F.regexp_extract(part, rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    length = named("head", "Content-Length").cast("int")
    raw = raw.withColumn("block", F.substring(F.col("bytes"), F.col("at") + 5, length))
    http = F.substring_index(F.col("block").cast("string"), _GAP, 1)
    raw = raw.withColumn("http", F.concat(F.lit("\r\n"), http, F.lit("\r\n"))).withColumn("body", F.substring(F.col("block"), F.octet_length(http) + 5, length))
    kind = named("head", "WARC-Type")
    body = F.when(named("http", "Content-Transfer-Encoding") == "base64", F.unbase64(F.col("body").cast("string"))).otherwise(F.col("body"))
    number = lambda name: F.regexp_extract("head", rf"\r\n{name}: <{_ID}(-?[0-9]*)", 1).try_cast("long")
    out = raw.select(
        number("WARC-Record-ID").alias("record_id"), named("head", "WARC-Target-URI").alias("url"), kind.alias("record_type"), number("WARC-Refers-To").alias("refers_to"),
        named("http", "Content-Length").cast("long").alias("told_bytes"), F.regexp_extract("head", r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]*)", 1).alias("told_digest"),
        F.when(kind == "response", body).alias("payload"),
    )
    return out.select(
        "record_id", "url", "record_type", "refers_to",
        F.coalesce(F.octet_length("payload").cast("long"), "told_bytes").alias("payload_bytes"), F.coalesce(F.sha1("payload"), "told_digest").alias("payload_digest"), "payload",
    )


def archived(pages: DataFrame, path: str | None = None, **columns) -> DataFrame:
    """Writes ``pages`` as deduplicated archives, in a new folder under the shared one if no path is given, and reads them back."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(resolve_revisits(records(pages, **columns)), path)
    return read_warc(pages.sparkSession, path)
