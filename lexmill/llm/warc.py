"""WARC archives: write one transaction per page, read archives back, assemble captures.

A page becomes three records: a request and a metadata record, both concurrent to the third, which is a
response or, where another page has the same payload, a revisit (identical-payload-digest).  Files are
written and read by Spark's text source with CRLF as line end and gzip, so they live wherever Spark
reads; records are cut by Content-Length, whatever their payload holds.

Record ids are unique: they carry the page_id, a hash of URL and payload, and a number among rows that agree in
all three.  Such rows are counted in a narrow table first, and only they are gathered, each kind once, and written
as often as it occurs.  The page_id also has a header of its own.  What a revisit says of its payload is held
against the response that it refers to.

Contract: a null html is an empty payload, a null url an empty target, and a null page_id a capture
without number.  Every row gives one capture; rows that repeat page_id and html are captures of their
own and of the same kind.  Of equal payloads of at least ``LEAST`` bytes the largest page_id is the
response.  A revisit whose response is missing or has another payload is an error.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, slices

#: Payloads of fewer bytes are always stored.
LEAST = 1000
#: Most revisits whose ids are sent to all executors (about 100 bytes each); beyond it they are joined by a shuffle.
MOST_SENT = 200_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "type string, id string, page_id long, concurrent_to string, refers_to string, target_uri string, date string, http_length long, payload_bytes long, payload_sha1 string, declared_sha1 string, payload binary"


def _record(headers: list[tuple[str, Column | str]], block: Column) -> Column:
    """One record; its closing CRLF CRLF lacks the last CRLF, which the caller or the line end adds."""
    lines = [F.concat(F.lit(f"{k}: "), v if isinstance(v, Column) else F.lit(v)) for k, v in headers]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, size, F.lit(""), block), F.lit("\r\n"))


def _rows(pages: DataFrame) -> DataFrame:
    """page_id, url, html, sha1 and key, a hash of URL and payload."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    return rows.withColumn("key", F.lower(F.hex(F.xxhash64("url", "sha1"))))


def _ident(page: Column, key: Column, copy: Column, kind: str) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), key, F.lit(":"), copy.cast("string"), F.lit(f":{kind}>"))


def plan(pages: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """page_id, sha1, and refers_to (a record id) of the pages that revisit another page; and page_id, key, copies of rows that repeat."""
    narrow = cut(_rows(pages).select("page_id", "key", "sha1", F.octet_length("html").alias("n")), "payloads")
    large = narrow.where(F.col("n") >= least)
    owners = large.groupBy("sha1").agg(F.max(F.struct("page_id", "key")).alias("owner"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    revisits = large.join(owners, "sha1").where("page_id is null or page_id <> owner.page_id")
    revisits = revisits.select("page_id", "sha1", _ident(F.col("owner.page_id"), F.col("owner.key"), F.lit(0), "main").alias("refers_to")).distinct()
    repeated = narrow.groupBy("page_id", "key").agg(F.count("*").alias("copies")).where("copies > 1")
    return cut(revisits, "revisits"), cut(repeated, "repeated")


def _numbered(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows with ``copy``: their number among those of one page_id and key."""
    n = repeated.count()
    if not n:
        return rows.withColumn("copy", F.lit(0))
    some = repeated.select(F.col("page_id").alias("__p"), F.col("key").alias("__k"), "copies")
    some = F.broadcast(some) if n <= MOST_SENT else some
    same = rows["page_id"].eqNullSafe(some["__p"]) & (rows["key"] == some["__k"])
    once = rows.join(some, same, "left_anti").withColumn("copy", F.lit(0))
    # equal rows meet as one, gathered on the map side first
    many = rows.join(some, same).groupBy("page_id", "key", "copies").agg(*[F.first(c).alias(c) for c in ("url", "html", "sha1")])
    return once.unionByName(many.withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))).drop("copies"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write (page_id, url, html) as gzip WARC files under ``path``."""
    revisits, repeated = plan(pages, least)
    if revisits.count() <= MOST_SENT:
        revisits = F.broadcast(revisits)
    rows = _numbered(_rows(pages), repeated)
    other = revisits.select(F.col("page_id").alias("__p"), F.col("sha1").alias("__s"), "refers_to")
    rows = rows.join(other, rows["page_id"].eqNullSafe(other["__p"]) & (rows["sha1"] == other["__s"]), "left")
    ident = lambda kind: _ident(F.col("page_id"), F.col("key"), F.col("copy"), kind)
    main, when, url, page = ident("main"), ("WARC-Date", date), ("WARC-Target-URI", F.col("url")), ("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n\r\n"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))
    ask = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_extract("url", r"^[a-z]+://[^/]*(/.*)$", 1), F.lit("")), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.regexp_extract("url", r"^[a-z]+://([^/]*)", 1), F.lit("\r\n\r\n"))
    request = _record([("WARC-Type", "request"), ("WARC-Record-ID", ident("request")), ("WARC-Concurrent-To", main), when, url, page, ("Content-Type", "application/http;msgtype=request")], ask)
    response = _record([("WARC-Type", "response"), ("WARC-Record-ID", main), when, url, page, digest, ("Content-Type", "application/http;msgtype=response")], F.concat(http, F.col("html")))
    revisit = _record(
        [("WARC-Type", "revisit"), ("WARC-Record-ID", main), ("WARC-Profile", PROFILE), ("WARC-Refers-To", F.col("refers_to")), when, url, page, digest, ("Content-Type", "application/http;msgtype=response")], http
    )
    metadata = _record([("WARC-Type", "metadata"), ("WARC-Record-ID", ident("metadata")), ("WARC-Concurrent-To", main), when, url, page, ("Content-Type", "application/warc-fields")], F.lit("fetchTimeMs: 0\r\n"))
    main_record = F.when(F.col("refers_to").isNull(), response).otherwise(revisit)
    text = F.concat(request, F.lit("\r\n"), main_record, F.lit("\r\n"), metadata)
    rows.select(text.alias("value")).write.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\r\n").text(path)


class _Parser:
    """Lines of archives in, records out."""

    def __init__(self) -> None:
        self.state, self.headers, self.block, self.have, self.need = "between", {}, [], 0, 0

    def feed(self, line: bytes) -> tuple[dict[str, str], bytes] | None:
        if self.state == "between":
            if line.startswith(b"WARC/"):
                self.state, self.headers, self.block, self.have = "headers", {}, [], -2
        elif self.state == "headers":
            if line:
                name, _, value = line.decode("utf-8", "replace").partition(":")
                self.headers[name.strip().lower()] = value.strip()
                return None
            self.need = int(self.headers.get("content-length", 0))
            self.state = "block"
            if not self.need:
                return self._done()
        else:
            self.block.append(line)
            self.have += len(line) + 2
            if self.have >= self.need:
                return self._done()
        return None

    def _done(self) -> tuple[dict[str, str], bytes]:
        self.state = "between"
        return self.headers, b"\r\n".join(self.block)[: self.need]


def _row(headers: dict[str, str], block: bytes, payload: bool) -> tuple:
    kind = headers.get("warc-type")
    head, body = b"", block
    if "application/http" in headers.get("content-type", ""):
        head, _, body = block.partition(b"\r\n\r\n")
    stated = re.search(rb"(?im)^content-length:\s*(\d+)", head)
    declared = headers.get("warc-payload-digest", "")
    full = kind != "revisit"
    page = headers.get("x-page-id", "")
    return (
        kind, headers.get("warc-record-id"), int(page) if re.fullmatch(r"-?[0-9]{1,18}|-?9[0-9]{18}", page) else None, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), headers.get("warc-date"), int(stated[1]) if stated else None,
        len(body) if full else None, hashlib.sha1(body).hexdigest() if full else None, declared.partition(":")[2] or None, body if payload and full else None,
    )


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of the gzip archives under ``path``; without ``payload`` only its size and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Parser()
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in RECORD.split(", "))])
        for batch in slices(batches, column="value"):
            rows = [_row(*r, payload) for line in batch.column(0).to_pylist() if (r := parser.feed(line))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * len(schema), schema)], schema=schema)

    return spark.read.option("lineSep", "\r\n").text(path).select(F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata concurrent to it."""
    part = lambda kind: records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("capture_id"), F.struct("id", "target_uri", "date", "payload_bytes", "payload").alias(kind)).dropDuplicates(["capture_id"])
    main = records.where(F.col("type").isin("response", "revisit")).select(
        F.col("id").alias("capture_id"), "page_id", F.struct("type", "id", "refers_to", "target_uri", "date", "http_length", "payload_bytes", "payload_sha1", "declared_sha1", "payload").alias("response")
    )
    return main.join(part("request"), "capture_id", "left").join(part("metadata"), "capture_id", "left")


def resolved(records: DataFrame) -> DataFrame:
    """id, page_id of the response, payload_bytes and payload_sha1 of every revisit, as the response that it refers to has them.

    It is an error if there is none, or if its payload is not what the revisit says.
    """
    revisits = records.where("type = 'revisit'").select("id", "refers_to", "http_length", "declared_sha1")
    responses = records.where("type = 'response'").select(F.col("id").alias("refers_to"), F.col("page_id").alias("owner"), "payload_bytes", "payload_sha1")
    rows = revisits.join(responses, "refers_to", "left")
    same = (F.col("payload_sha1") == F.col("declared_sha1")) & (F.col("payload_bytes") == F.col("http_length"))
    sound = F.when(F.coalesce(same, F.lit(False)), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("no such payload: "), "id")).cast("long"))
    return rows.select(F.col("id").alias("capture_id"), "owner", sound.alias("full_bytes"), F.col("payload_sha1").alias("full_sha1"))


def round_trip(pages: DataFrame, path: str | None = None, least: int = LEAST) -> DataFrame:
    """Write pages, read the archives back, and return per capture what it holds."""
    spark = pages.sparkSession
    path = path or scratch(spark, "pages.warc")
    write_warc(pages, path, least)
    records = cut(read_warc(spark, path, payload=False), "records")
    rows = captures(records).join(resolved(records), "capture_id", "left")
    r = F.col("response")
    return rows.select(
        "page_id", F.coalesce(r["payload_bytes"], "full_bytes").alias("payload_bytes"), F.coalesce(r["payload_sha1"], "full_sha1").alias("payload_digest"), r["type"].alias("record_type"), F.col("owner").alias("refers_to"),
    )


ORACLE = """
SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(encode(h)) AS payload_digest,
       CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(h)) >= 1000 AND page_id <> top THEN top END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
"""
