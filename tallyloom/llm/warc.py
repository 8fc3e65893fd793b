"""WARC archives: writing captures, reading records, assembling transactions.

Writing. Each page becomes three records: a request, a response (or a revisit, if an
earlier page has an equal payload of at least ``least`` bytes) and metadata. The
request and the metadata name the response in WARC-Concurrent-To. Archives are
gzip files made by Spark's text sink, so they go to any store that Spark writes;
a page's records lie together and files hold a bounded number of pages.

Reading. Archives come through the binary source; each is unpacked and cut by
Content-Length, so payloads may hold anything, record headers too. Assembly joins
the three records through the concurrent-to identifier into one nested row for each
capture; a revisit gets its payload's size from the record that it refers to.

Null html is an empty payload, null urls are written as an empty target. Pages with
one id are told apart by their place in the files; equal payloads under one id revisit
the first, by url and place. Null ids count as the largest. Extra columns, whatever
their names, are ignored; no page, no file. A page's html is one value in Spark and
must stay below 2 GB.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import PLACE, hot_keys, join_hot, located, stored, temporary
from .textkernel import lean, tune

CRLF = "\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Size classes of pages, in bytes of html, and how many pages of each a file may hold.
SIZES = ((1 << 14, 2000), (1 << 18, 128), (1 << 22, 8), (1 << 31, 1))
#: Marks that are sent to the pages; beyond, a bitmap of at most so many bits tells which pages must meet them.
BROADCAST_ROWS, BITMAP_BITS = 100_000, 1 << 28
_BITMAP = 1 << 15  # bits of one bitmap value, as Spark's aggregate makes them
RECORD = "kind string, record_id string, concurrent_to string, refers_to string, target string, payload_digest string, payload_bytes long, payload binary, fields map<string,string>"


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    """One record as text: the sink adds the last line end."""
    head = [F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}WARC-Record-ID: <"), record_id, F.lit(f">{CRLF}WARC-Date: {DATE}{CRLF}")]
    for name, value in headers:
        head += [F.lit(f"{name}: "), value, F.lit(CRLF)]
    head += [F.lit(f"Content-Type: {content_type}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block, F.lit(CRLF)]
    return F.concat(*head)


def name_of(kind: str, page: Column, number: Column) -> Column:
    """A record id that follows from the page, so that a retried task writes the same."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), F.coalesce(page.cast("string"), F.lit("\\N")), number.cast("string")))
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12))


def _maybe(rows: DataFrame, marks: DataFrame, n: int) -> DataFrame:
    """rows with ``maybe``: false only if no mark has the row's page and payload. The bitmap is BITMAP_BITS at most."""
    hashed = lambda page, digest: F.xxhash64(page, digest)
    count = max(1, min(BITMAP_BITS, 16 * n) // _BITMAP)
    of = lambda h: (F.pmod(F.shiftright(h, 15), F.lit(count)).alias("bitmap"), F.pmod(h, F.lit(_BITMAP)).alias("bit"))
    maps = marks.select(*of(hashed("of", "payload"))).groupBy("bitmap").agg(F.bitmap_construct_agg("bit").alias("bits"))
    at = rows.select("*", *of(hashed("page_id", "digest"))).join(F.broadcast(maps), "bitmap", "left")
    byte = F.conv(F.hex(F.substring("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    isset = byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0
    return at.withColumn("maybe", F.coalesce(isset, F.lit(False))).drop("bitmap", "bit", "bits")


def captures(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, number, url, html, digest, and for revisits the page that they refer to.

    Digests are grouped without the texts. Texts move only to meet the marks of pages
    whose payload occurs again, by (page, digest), so a payload that is everywhere is
    no hot key. Up to BROADCAST_ROWS marks are sent to the texts instead; with more, a
    bitmap keeps the texts that no mark belongs to where they are. Rows that repeat a
    page and payload are told apart by place; the first by url and place has number 0.
    """
    html, url = F.coalesce("html", F.lit("")), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    source = located(pages.select("page_id", "url", "html"))
    place = F.struct(F.col("url"), *PLACE)
    rows = source.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), *PLACE)
    pairs = stored(rows.groupBy("page_id", "digest", (F.octet_length("html") >= least).alias("large")).agg(F.count("*").alias("copies"), F.min(place).alias("at")), "payloads")
    firsts = pairs.where("large").groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull(), "page_id")).alias("first"), F.sum("copies").alias("n")).where("n > 1").select("digest", F.col("first.page_id").alias("first_page"), F.lit(True).alias("again"), "n")
    firsts = stored(firsts, "firsts")
    hot = hot_keys(firsts, "digest", pairs.count())
    marks = join_hot(pairs, firsts.drop("n"), "digest", "left", hot).where("again or copies > 1").select(F.col("page_id").alias("of"), F.col("digest").alias("payload"), "first_page", "again", F.col("at").alias("first_at"))
    marks = stored(marks, "marks")
    n = marks.count()
    same = F.col("page_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("payload"))
    if n <= BROADCAST_ROWS:
        marked = rows.join(F.broadcast(marks), same, "left")
    else:
        asked = _maybe(rows, marks, n)
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in marks.schema.fields]
        marked = asked.where("maybe").drop("maybe").join(marks, same, "left").unionByName(asked.where("not maybe").drop("maybe").select("*", *none))
    first_copy = F.coalesce(F.col("first_at") == place, F.lit(True))
    marked = marked.withColumn("number", F.when(first_copy, "0").otherwise(F.concat_ws(".", *PLACE))).drop("of", "payload", "first_at", *PLACE)
    first = F.col("first_page").eqNullSafe(F.col("page_id")) & (F.col("number") == "0")
    return marked.withColumn("revisit", F.coalesce(F.col("again") & ~first, F.lit(False)))


def write(pages: DataFrame, path: str, least: int = 100) -> None:
    """Write the captures of ``pages`` (page_id, url, html) as gzip WARC files under ``path``.

    Pages go to files by size class, so that no file is larger than about 32 MB or one page.
    """
    every = captures(pages, least)
    size = F.octet_length("html")
    found = {r.k for r in pages.select(_size_class(F.coalesce(F.octet_length("html"), F.lit(0))).alias("k")).distinct().collect()}
    for k in sorted(found) or [0]:
        _write(every.where(_size_class(size) == k), f"{path}/size{k}", SIZES[k][1])


def _size_class(size: Column) -> Column:
    out = F.lit(len(SIZES) - 1)
    for k in reversed(range(len(SIZES) - 1)):
        out = F.when(size <= SIZES[k][0], k).otherwise(out)
    return out


def _write(c: DataFrame, path: str, per_file: int) -> None:
    number = F.concat_ws("-", "digest", "number")
    own, first = name_of("response", F.col("page_id"), number), name_of("response", F.col("first_page"), F.concat_ws("-", "digest", F.lit("0")))
    target, digest = ("WARC-Target-URI", F.col("url")), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    beside = ("WARC-Concurrent-To", F.concat(F.lit("<"), own, F.lit(">")))
    status = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "
    http = F.concat(F.lit(status), F.octet_length("html").cast("string"), F.lit(CRLF * 2))
    response = _record("response", own, [target, digest], "application/http; msgtype=response", F.concat(http, F.col("html")))
    refers = ("WARC-Refers-To", F.concat(F.lit("<"), first, F.lit(">")))
    revisit = _record("revisit", own, [target, digest, refers, ("WARC-Profile", F.lit(PROFILE))], "application/http; msgtype=response", http)
    request = _record("request", name_of("request", F.col("page_id"), number), [target, beside], "application/http; msgtype=request", F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{CRLF}Accept: text/html{CRLF * 2}")))
    noted = F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(CRLF))
    metadata = _record("metadata", name_of("metadata", F.col("page_id"), number), [target, beside], "application/warc-fields", noted)
    # Three records in one value, each ended by an empty line; the sink's separator ends the last.
    together = F.concat(request, F.lit(CRLF), F.when(F.col("revisit"), revisit).otherwise(response), F.lit(CRLF), metadata)
    c.select(together.alias("value")).write.option("compression", "gzip").option("lineSep", CRLF).option("maxRecordsPerFile", per_file).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(headers in lower case, block) of each record of an unpacked archive."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data.startswith(b"\r\n", at):
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if end + 4 + size > len(data):
            raise ValueError("the archive ends inside a record")
        yield headers, view[end + 4 : end + 4 + size]
        at = end + 4 + size


def unpack(data: bytes) -> bytes:
    """The content of gzip members one after another; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out.append(d.decompress(data))
        data = d.unused_data
    return b"".join(out)


def _fields(block: bytes) -> dict[str, str]:
    return {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in block.decode("utf-8").split("\r\n") if x)}


def _read(payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 6 + [pa.int64(), pa.binary(), pa.map_(pa.string(), pa.string())]
        names = ["kind", "record_id", "concurrent_to", "refers_to", "target", "payload_digest", "payload_bytes", "payload", "fields"]
        bare = lambda x: x.strip("<>") if x else None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for h, block in parse(unpack(data.as_py())):
                    kind, payload, digest, n, fields = h["warc-type"], None, None, None, None
                    if kind == "response":
                        body = bytes(block).partition(b"\r\n\r\n")[2]
                        digest, n = hashlib.sha256(body).hexdigest(), len(body)
                        if h.get("warc-payload-digest", digest).rpartition(":")[2] != digest:
                            raise ValueError(f"payload of {h['warc-record-id']} is damaged")
                        payload = body if payloads else None
                    elif kind == "revisit":
                        digest = h["warc-payload-digest"].rpartition(":")[2]
                    elif kind == "metadata":
                        fields = list(_fields(bytes(block)).items())
                    rows.append((kind, bare(h["warc-record-id"]), bare(h.get("warc-concurrent-to")), bare(h.get("warc-refers-to")), h.get("warc-target-uri"), digest, n, payload, fields))
                    size += len(payload or b"") + 400
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return run


def records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row for each record of the archives under ``path``; without ``payloads`` only their sizes and digests."""
    tune(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(lean(_read(payloads)), RECORD)


def transactions(found: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit, with request, metadata and the record referred to.

    The three records of a capture meet under the identifier that they are concurrent
    to, in one shuffle; where they lie together in an archive they are joined before
    it. Requests or metadata whose response is missing give no row; of several of one
    kind, the least id is taken. The result is kept in the shared folder, since
    revisits look up the captures that they refer to; one that most refer to is sent
    to them.
    """
    one = lambda *kinds, cols: F.min_by(F.struct(*cols), F.when(F.col("kind").isin(*kinds), F.col("record_id")))
    joined = found.withColumn("capture", F.when(F.col("kind").isin("response", "revisit"), F.col("record_id")).otherwise(F.col("concurrent_to"))).where("capture is not null")
    joined = joined.groupBy("capture").agg(
        one("response", "revisit", cols=("kind", "target", "payload_digest", "payload_bytes", "payload", "refers_to")).alias("response"),
        one("request", cols=("record_id", "target")).alias("request"),
        one("metadata", cols=("record_id", "target", "fields")).alias("metadata"),
    )
    kept = stored(joined.where("response is not null").withColumnRenamed("capture", "record_id"), "transactions")
    asked = kept.where("response.refers_to is not null").withColumn("refers_to", F.col("response.refers_to"))
    origin = kept.where("response.kind = 'response'").select(F.col("record_id").alias("refers_to"), F.struct(F.col("record_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("metadata.fields").alias("fields")).alias("origin"))
    plain = kept.where("response.refers_to is null").withColumn("origin", F.lit(None).cast(origin.schema["origin"].dataType))
    return plain.unionByName(join_hot(asked, origin, "refers_to", "left").drop("refers_to"))


def query(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    path = temporary(spark, "archives")
    write(pages, path)
    t = transactions(records(spark, path, payloads=False))
    page = lambda fields: F.when(fields["page_id"] != "", fields["page_id"]).cast("long")
    return t.select(
        page(F.col("metadata.fields")).alias("page_id"),
        F.coalesce("response.payload_bytes", "origin.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        page(F.col("origin.fields")).alias("refers_to"),
    )


SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""
