"""WARC archives with an index that is written first.

Every page becomes one record (response, or revisit of an earlier equal payload) of one archive.
The index (archive, offset, length, URL, digest) follows from the records' byte lengths alone, so
it is written before the archives and without their payloads; the archives are then written by
Spark's text writer, one file an archive, in index order; payloads travel compressed. Reading selects index rows, sorts their
ranges per archive, coalesces neighbours into range reads of bounded size, and cuts the records
out of what was read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import core_conf, scratch, small_batches, written

MIN_PAYLOAD = 100
#: Target size of an archive; there are as many archives as shuffle partitions at least.
ARCHIVE_BYTES = 256 << 20
#: Ranges this near are read together, up to READ_BYTES at once.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
DATE = "2026-01-01T00:00:00Z"
_EOL = "\r\n"


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to of each page.

    Null html is an empty payload. Among equal payloads of MIN_PAYLOAD bytes or more the smallest
    page_id is the response (each of its rows, if it repeats) and the others revisit it; a null
    page_id revisits, or is a response where no other id has the payload. An empty table gives no
    rows; other columns are not looked at, whatever their names.
    """
    html = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"),
                       F.sha2(html.cast("binary"), 256).alias("payload_digest"))
    # only digests that repeat have revisits; they alone take part in the join
    first = (own.filter(F.col("payload_bytes") >= MIN_PAYLOAD).select("page_id", F.unhex("payload_digest").alias("d"))
             .groupBy("d").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .filter("n > 1 AND first IS NOT NULL").select(F.lower(F.hex("d")).alias("payload_digest"), "first"))
    joined = own.join(written(first, "warc-first"), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest",
                         F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("first")).alias("refers_to"))


def _line(name: str, value: Column) -> Column:
    """A header line, absent if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_EOL)), F.lit(""))


def _head() -> Column:
    """The record up to its payload."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(_EOL + _EOL))
    body = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    url = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "%20")
    return F.concat(
        F.lit(f"WARC/1.1{_EOL}"), _line("WARC-Type", F.col("record_type")), _line("WARC-Record-ID", _id(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        _line("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _line("WARC-Refers-To", F.when(revisit, _id(F.col("refers_to")))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", body.cast("string")), F.lit(_EOL), http)


def _travel(recs: DataFrame, n: int, order: list[str]) -> DataFrame:
    """(archive, value) in archive order, an archive a partition: payloads are compressed on the way,
    digests are bytes, and the heads are made where the records are written."""
    here = [*order, "record_type", "refers_to", "payload_bytes"]
    kinds = {c: recs.schema[c].dataType.simpleString() for c in here} | {"payload_digest": "binary"}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=9)
        for b in batches:
            payloads = b.column("payload").cast(pa.binary()).to_pylist()
            packed = [codec.compress(x, asbytes=True) if x else b"" for x in payloads]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("archive", *here)), pa.array([len(x) for x in payloads], pa.int64()), pa.array(packed, pa.binary())],
                                             names=["archive", *here, "size", "packed"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("head", "size", "packed")), strict=True)
            values = [f"{h}{pa.decompress(x, size, codec='zstd', asbytes=True).decode() if size else ''}{_EOL}" for h, size, x in rows]
            yield pa.RecordBatch.from_arrays([b.column("archive"), pa.array(values, pa.string())], names=["archive", "value"])

    small_batches(recs.sparkSession)
    packed = (recs.withColumn("payload_digest", F.unhex("payload_digest")).select("archive", *here, "payload")
              .mapInArrow(pack, "archive int" + "".join(f", {c} {kinds[c]}" for c in here) + ", size long, packed binary"))
    packed = packed.repartitionById(n, "archive").sortWithinPartitions("archive", *order)        # bytes and hex sort alike
    return (packed.withColumn("payload_digest", F.lower(F.hex("payload_digest"))).select("archive", _head().alias("head"), "size", "packed")
            .mapInArrow(unpack, "archive int, value string"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write index and archives under ``folder``; returns the index as read back
    (archive, offset, length, url, page_id, payload_digest)."""
    spark = pages.sparkSession
    recs = records(pages).withColumn("head", _head())
    kept = F.when(F.col("record_type") == "revisit", F.lit("")).otherwise(F.col("html"))
    size = F.octet_length("head") + F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes")) + 4
    total = pages.select(F.sum(F.octet_length("html"))).first()[0] or 0
    n = max(core_conf(spark), -(-total // archive_bytes))
    # equal rows are interchangeable, so the order by these columns fixes the bytes of an archive
    order = ["page_id", "payload_digest", "url"]
    placed = recs.select(
        F.pmod(F.xxhash64(*order), F.lit(n)).cast("int").alias("archive"),
        *order, "record_type", "refers_to", "payload_bytes", kept.alias("payload"), size.cast("long").alias("length"))
    slim = (placed.select("archive", "page_id", F.unhex("payload_digest").alias("payload_digest"), "url", "length")
            .repartitionById(n, "archive").withColumn("payload_digest", F.lower(F.hex("payload_digest"))))
    w = Window.partitionBy("archive").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    index = slim.select("archive", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("offset"), "length", "url", "page_id", "payload_digest")
    index.write.parquet(f"{folder}/index")
    (_travel(placed, n, order).write.partitionBy("archive").option("lineSep", _EOL).text(f"{folder}/archives"))
    return spark.read.parquet(f"{folder}/index")


def _open(uri: str) -> pa.NativeFile:
    """A random-access file of any store that Arrow reaches (file, hdfs, s3, gs, abfs)."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    fs, path = pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return fs.open_input_file(path)


def coalesce_ranges(rows: Iterator[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(path, offset, length) sorted by path and offset -> (path, start, end, its records)."""
    now: tuple | None = None
    for path, at, n in rows:
        if now and now[0] == path and at - now[2] <= gap and at + n - now[1] <= most:
            now[3].append((at, n))
            now = (path, now[1], max(now[2], at + n), now[3])
        else:
            if now:
                yield now
            now = (path, at, at + n, [(at, n)])
    if now:
        yield now


def parse(record: bytes) -> dict:
    """Headers and payload of one record as the writer lays it out."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8").split(_EOL)[1:])
    http, _, payload = block[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rsplit(b": ", 1)[1])
    strip = lambda x: x[len("<urn:page:"):-1] or None if x else None
    kind = fields["WARC-Type"]
    return {"page_id": strip(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": size,
            "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "record_type": kind,
            "refers_to": strip(fields.get("WARC-Refers-To")), "payload": None if kind == "revisit" else payload}


def read_records(spark: SparkSession, folder: str, index: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the index rows, read back from the archives; a response whose payload does
    not have its digest, or a cut-off record, is an error."""
    small_batches(spark)
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{folder}/archives")
             .select("path", F.regexp_extract("path", r"/archive=(\d+)/", 1).cast("int").alias("archive")))
    rows = (index.select("archive", "offset", "length").join(files, "archive")
            .withColumn("part", (F.col("offset") / F.lit(64 << 20)).cast("long"))
            .repartition("archive", "part").sortWithinPartitions("path", "offset").select("path", "offset", "length"))
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = ((p, o, n) for b in batches for p, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True))
        path, file = None, None
        for p, start, end, recs in coalesce_ranges(flat):
            if p != path:
                path, file = p, _open(p)
            data = file.read_at(end - start, start)
            out = []
            for at, n in recs:
                piece = data[at - start:at - start + n]
                r = parse(piece)
                if len(piece) != n or r["payload"] is not None and hashlib.sha256(r["payload"]).hexdigest() != r["payload_digest"]:
                    raise OSError(f"record at {at} of {p} is damaged")
                out.append(r)
            types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(names, types, strict=False)], names=names)

    return rows.mapInArrow(run, "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload)


def op3_warc(pages: DataFrame) -> DataFrame:
    """Write every page, read every record back; one row a page."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    index = write_archives(pages, folder)
    kind = pages.schema["page_id"].dataType
    return read_records(spark, folder, index).select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


#: DuckDB SQL of op3.
ORACLE = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS f FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
