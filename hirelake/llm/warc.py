"""WARC archives: writing page captures, and assembling captures from archives read back.

A capture is a request, a response or revisit, and a metadata record. Request and metadata name
the response or revisit they belong to in WARC-Concurrent-To; a revisit names the response with
the same payload in WARC-Refers-To. Archives are written by Spark's text writer, records with
their own end mark, so tasks that run again leave whole files; `read` takes any WARC 1.x file,
plain or gzip (one or many members), and follows Content-Length, never an end mark.

Archives are dealt by a hash of the row into as many files as `archive_bytes` asks for (and as many
for rows that repeat often); one record may be larger, and one archive is what a task holds at once.

Defined cases: a null payload is empty. Of rows that share a key, or have none, all get their own
records, equal rows too; rows without a key are responses.
Captures that miss a request or metadata record keep nulls there; request or metadata records
without a capture are dropped. A revisit whose response isn't in the archives has a null payload.
Repeated record ids count once. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hirelake.llm.shared import written

#: Payloads under so many bytes are never written as a revisit.
LEAST_SHARED = 1000
ARCHIVE_BYTES = 16 << 20
#: Bytes that are unzipped at once.
FEED = 1 << 16
#: Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http; msgtype="


def _facts(pages: DataFrame, key: str, payload: str) -> DataFrame:
    """key, url, body, its digest and bytes, and a hash (128 bits) of the first two and the digest, of each row; a null url or payload is empty."""
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.coalesce("url", F.lit("")).alias("url"), body.alias("body"))
    rows = rows.withColumns({"digest": F.sha1(F.encode("body", "UTF-8")), "bytes": F.octet_length("body").cast("long")})
    own = F.coalesce(F.col("key").cast("string"), F.lit(""))
    size = F.when(F.col("key").isNull(), F.lit("none")).otherwise(F.length(own).cast("string"))  # tells key and url apart
    return rows.withColumn("row", F.md5(F.encode(F.concat_ws(":", "digest", size, own, "url"), "UTF-8")))


def revisits(facts: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """row and origin (row of the response) of the rows that revisit another's payload, each once.

    No payload leaves its task here: digests alone meet, and a hot digest's rows meet its one row in
    a join whose large side Spark splits. Rows without a key, or with that of the response, are responses.
    """
    rows = facts.where((F.col("bytes") >= least) & F.col("key").isNotNull()).select("key", "digest", "row").distinct()
    last = rows.groupBy("digest").agg(F.max(F.struct("key", "row")).alias("last"))
    return rows.join(last, "digest").where(F.col("key") != F.col("last.key")).select("row", F.col("last.row").alias("origin"))


def _record(kind: str, ident: Column, more: list[tuple[str, Column]], block: Column, mime: str) -> Column:
    """The text of one record without its end mark; header lines whose value is null are left out."""
    head = [("WARC-Type", F.lit(kind)), ("WARC-Record-ID", ident), *more, ("Content-Type", F.lit(mime))]
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in head]
    size = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.lit(f"{VERSION}\r\n"), *[F.coalesce(x, F.lit("")) for x in lines], size, F.lit(END), block)


def ident_of(kind: str, row: Column, number: Column) -> Column:
    """A record id that a task which runs again makes alike."""
    h = F.sha2(F.concat_ws(":", F.lit(kind), row, number.cast("string")), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _numbered(pages: DataFrame, archives: int, key: str, payload: str, archive_bytes: int) -> DataFrame:
    """The facts, origin and number of each row, dealt to partitions; number tells equal rows apart.

    Rows with equal key, url and payload are one row before they are shuffled, and get their count
    there, so numbers don't depend on the order of rows. Copies that are more than an archive are
    dealt in chunks; other payloads are shuffled once.
    """
    every = _facts(pages, key, payload)
    facts = written(every.drop("body"), "facts")
    copies = facts.groupBy("row").agg(F.count("*").alias("copies"), (F.min("bytes") + 1500).alias("size"))
    copies = copies.withColumn("chunk", F.greatest(F.lit(1), F.floor(F.lit(archive_bytes) / F.col("size"))).cast("long")).drop("size")
    origins, each = revisits(facts), every.dropDuplicates(["row"])
    few = each.join(copies.where("copies <= chunk"), "row").join(origins, "row", "left").withColumn("first", F.lit(0).cast("long"))
    many = each.join(copies.where("copies > chunk"), "row").join(origins, "row", "left")
    many = many.withColumn("first", F.explode(F.expr("sequence(0L, copies - 1, chunk)"))).repartition(archives, "row", "first")
    return few.unionByName(many).withColumn("number", F.explode(F.expr("sequence(first, least(first + chunk, copies) - 1)")))


def records(
    pages: DataFrame, archives: int, key: str = "page_id", payload: str = "html", date: str = "2026-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """value: the text of each record, in the session's shuffle partitions, and `archives` more for what repeats often."""
    rows = _numbered(pages, archives, key, payload, archive_bytes)
    k, url = F.col("key"), F.regexp_replace("url", r"[\r\n]", "")
    row = (F.col("row"), F.col("number"))
    own = ident_of("capture", *row)
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", url)]
    host = F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)
    get = F.concat(F.lit("GET "), F.coalesce(F.nullif(F.regexp_replace(url, r"^[^:]*://[^/?#]*", ""), F.lit("")), F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    sha = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    beside = ("WARC-Concurrent-To", own)
    response = _record("response", own, [*common, sha], F.concat(answer, F.col("body")), HTTP_TYPE + "response")
    refers = [("WARC-Refers-To", ident_of("capture", F.col("origin"), F.lit(0))), ("WARC-Profile", F.lit(PROFILE))]
    revisit = _record("revisit", own, [*common, sha, *refers], answer, HTTP_TYPE + "response")
    request = _record("request", ident_of("request", *row), [*common, beside], get, HTTP_TYPE + "request")
    fields = F.concat(F.lit("key: "), F.coalesce(k.cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", ident_of("metadata", *row), [*common, beside], fields, "application/warc-fields")
    every = F.array(request, F.when(F.col("origin").isNull(), response).otherwise(revisit), metadata)
    return rows.select(F.explode(every).alias("value"))


def write(pages: DataFrame, folder: str, key: str = "page_id", payload: str = "html", archive_bytes: int = ARCHIVE_BYTES, compression: str = "gzip") -> int:
    """Writes the archives into a folder; returns how many."""
    total = pages.agg(F.sum(F.coalesce(F.octet_length(payload), F.lit(0)).cast("long") + 1500)).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))
    spark = pages.sparkSession
    ours = {"spark.sql.shuffle.partitions": str(archives), "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # a partition is an archive
    before = {name: spark.conf.get(name) for name in ours}
    try:
        for name, value in ours.items():
            spark.conf.set(name, value)
        texts = records(pages, archives, key, payload, archive_bytes=archive_bytes)
        texts.write.option("lineSep", END).option("compression", compression).text(folder)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return archives


def unzipped(data: bytes) -> Iterator[bytes]:
    """The content piece by piece; of gzip, member after member, each fed from where it begins."""
    view, at, member = memoryview(data), 0, None
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while at < len(view):
        if member is None:
            if view[at] == 0:  # padding
                at += 1
                continue
            member = zlib.decompressobj(31)
        piece = view[at : at + FEED]
        out = member.decompress(piece)
        at += len(piece) - len(member.unused_data)
        if member.eof:
            member = None
        if out:
            yield out
    if member is not None:
        raise ValueError("the last gzip member is cut off")


def parse(data: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in small letters) and block of each record, of a whole archive or of its pieces; holds one record at a time."""
    pieces = iter([data]) if isinstance(data, bytes) else iter(data)
    held, at, gone = bytearray(), 0, 0  # gone: bytes before those held

    def more() -> bool:
        nonlocal at, gone
        piece = next(pieces, None)
        if piece is None:
            return False
        if at > FEED:
            gone += at
            del held[:at]
            at = 0
        held.extend(piece)
        return True

    while True:
        while len(held) - at >= 2 or more():
            if len(held) - at < 2:
                continue
            if held[at : at + 2] != b"\r\n":
                break
            at += 2
        if at >= len(held):
            return
        n = held.find(b"\r\n\r\n", at) - at
        while n < 0:
            seen = max(0, len(held) - at - 3)
            if not more():
                break
            n = held.find(b"\r\n\r\n", at + seen) - at
        if n < 0 or not held.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {gone + at}")
        lines = held[at : at + n].decode("utf-8").split("\r\n")[1:]
        head = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
        size = int(head["content-length"])
        while len(held) - at < n + 4 + size:
            if not more():
                raise ValueError(f"record at byte {gone + at} is cut off")
        with memoryview(held) as view:
            block = bytes(view[at + n + 4 : at + n + 4 + size])
        at += n + 4 + size
        yield head, block


_FIELDS = {
    "record_id": pa.string(), "kind": pa.string(), "concurrent_to": pa.string(), "refers_to": pa.string(), "uri": pa.string(),
    "date": pa.string(), "digest": pa.string(), "bytes": pa.int64(), "sha1": pa.string(), "head": pa.string(), "payload": pa.binary(),
}
_SCHEMA = "record_id string, kind string, concurrent_to string, refers_to string, uri string, date string, digest string, bytes long, sha1 string, head string, payload binary"


def read(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row per record. bytes, sha1 and payload are of what follows the HTTP head, or of the whole block without one.

    A task holds one archive as it is stored (at most 2 GB; standard ones have 1 GB) and one record of what it unzips.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: dict[str, list] = {k: [] for k in _FIELDS}
                held = 0
                for head, block in parse(unzipped(content.as_py())):
                    whole, top = block, b""
                    if head.get("content-type", "").startswith("application/http"):
                        top, _, whole = whole.partition(b"\r\n\r\n")
                    elif head.get("warc-type") == "metadata":
                        top, whole = whole, b""
                    fields = ("warc-record-id", "warc-type", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-date", "warc-payload-digest")
                    for name, value in zip(out, [*map(head.get, fields), len(whole), hashlib.sha1(whole).hexdigest(), top.decode("utf-8", "replace"), whole if with_payload else None], strict=True):
                        out[name].append(value)
                    held += len(whole) if with_payload else 0
                    if len(out["kind"]) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pydict(out, pa.schema(_FIELDS))
                        out, held = {k: [] for k in _FIELDS}, 0
                yield pa.RecordBatch.from_pydict(out, pa.schema(_FIELDS))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(rows, _SCHEMA)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: its own fields, those of its payload, and its request, metadata and origin.

    origin is what a revisit refers to: record_id and metadata head of that response.
    """
    beside = (
        found.where(F.col("kind").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
        .groupBy(F.col("concurrent_to").alias("record_id"))
        .agg(*[F.min(F.when(F.col("kind") == k, F.struct(F.col("record_id"), F.col("head")))).alias(k) for k in ("request", "metadata")])
    )
    captures = found.where(F.col("kind").isin("response", "revisit")).dropDuplicates(["record_id"]).join(beside, "record_id", "left")
    origin = captures.where(F.col("kind") == "response").select(
        F.col("record_id").alias("refers_to"),
        F.struct("record_id", F.col("metadata.head").alias("metadata_head")).alias("origin"),
        F.struct("bytes", "sha1", "payload").alias("o"),
    )
    revisit = F.col("kind") == "revisit"
    digest = F.regexp_replace("digest", "^sha1:", "")
    # only revisits look for an origin: the others' empty references would all meet in one task
    kinds = {f.name: f.dataType for f in origin.schema}
    alone = captures.where(~revisit).withColumns({n: F.lit(None).cast(kinds[n]) for n in ("origin", "o")})
    every = captures.where(revisit).join(origin, "refers_to", "left").unionByName(alone)
    return every.select(
        "record_id", "uri", "date", "kind", "refers_to", "head", "request", "metadata", "origin",
        F.when(revisit, F.col("o.bytes")).otherwise(F.col("bytes")).alias("payload_bytes"),
        F.when(revisit, F.coalesce("o.sha1", digest)).otherwise(F.col("sha1")).alias("payload_digest"),
        F.when(revisit, F.col("o.payload")).otherwise(F.col("payload")).alias("payload"),
    )
