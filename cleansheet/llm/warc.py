"""Web archives: writing, normalising monolithic gzip files, and reading by offset.

`write_archives` packs pages into WARC files, each one gzip stream as careless
tools make them. `normalise` inflates such a stream once, piece by piece, and
rewrites every record as a gzip member of its own, with a sidecar index of
offsets. `read_records` reaches single records through the index.

Files go through Spark's own sinks and sources, so any storage that Spark
reaches will do. The text sink ends a row with its line separator; here that
is an empty gzip member, which leaves a file valid. Files are cut at a bounded
size and are rows on the way; a record is never cut.

Of pages with equal payloads (SHA-1) of at least `min_payload` bytes, those
with the smallest page id are responses and the others revisit it; a null id
comes after all others. A null html is an empty payload, a null or blank url
leaves out the target. Rows that repeat are written as often; if they share
the smallest id, each is a response. Other columns are ignored. An archive
that breaks off, or holds something else than records, is normalised up to
its last whole record and its last part says why in `error`. Archives may be of
any length; a record, and so a payload, has to fit into a cell (2 GiB).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cleansheet.session import scratch_path

from .common import discard, ship, write_table

ARCHIVE_BYTES = 16 << 20  # before compression
PART_BYTES = 4 << 20  # after compression
STEP_BYTES = 1 << 20
FEED_BYTES = 1 << 16
WHOLE_BYTES = 1 << 28  # files up to this length are one cell, longer ones come in pieces
LEVEL = 6
CAPTURED = "2024-01-01T00:00:00Z"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page `refers_to` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {CAPTURED}"]
    if url and url.strip():
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c in "\r\n \t" else c for c in url.strip()))
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(block: bytes) -> tuple[dict[str, str], int]:
    """Header fields by lower-case name, and where the content begins."""
    end = block.index(b"\r\n\r\n")
    lines = block[:end].decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, end + 4


def _to_files(files: DataFrame, path: str, *by: str) -> None:
    """Write each row's `content` as a file of its own below folders named after the `by` columns."""
    files.select(F.col("content").cast("string").alias("value"), *by).write.partitionBy(*by).options(
        lineSep=EMPTY_MEMBER.decode("latin-1"), encoding="ISO-8859-1", maxRecordsPerFile=1).text(path)


def _from_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).drop("path", "modificationTime", "length")


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads compressed for their way through the shuffle, and their sizes."""
    for batch in batches:
        page, url, payload, sha1 = batch.columns
        raw = payload.to_pylist()
        yield pa.RecordBatch.from_arrays(
            [page, url, pa.array([zlib.compress(p, 1) for p in raw], pa.binary()), sha1,
             pa.array([len(p) for p in raw], pa.int64())], ["page", "url", "payload", "sha1", "size"])


def _archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One gzip stream over many records, again and again."""
    task, number = TaskContext.get().partitionId(), 0

    def out(pieces: list[bytes], stream) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{number:06d}"]), pa.array(
            [b"".join([*pieces, stream.flush()])], pa.binary())], ["archive", "content"])

    stream, pieces, size = None, [], 0
    for batch in batches:
        for page, url, payload, sha1, first in zip(*(c.to_pylist() for c in batch.columns)):
            if stream is None:
                stream, pieces, size = zlib.compressobj(LEVEL, wbits=31), [], 0
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            raw = record(page, url, zlib.decompress(payload), digest, first)
            pieces.append(stream.compress(raw))
            size += len(raw)
            if size >= ARCHIVE_BYTES:
                yield out(pieces, stream)
                stream, number = None, number + 1
    if stream is not None:
        yield out(pieces, stream)


def write_archives(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html",
                   min_payload: int = 0) -> None:
    """Write all pages as WARC files below `path`, each a single gzip stream."""
    ship(pages.sparkSession)
    rows = pages.select(
        F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    leaders = rows.where(F.octet_length("payload") >= min_payload).groupBy("sha1").agg(
        F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    refers = F.when(F.col("size") >= min_payload, F.when(
        ~F.col("page").eqNullSafe(F.col("first")), F.col("first")))
    # The same plan at every size: no side is known to stay small.
    small = rows.mapInArrow(_shrink, "page long, url string, payload binary, sha1 string, size long")
    marked = small.join(leaders.hint("merge"), "sha1", "left").select("page", "url", "payload", "sha1", refers.alias("refers_to"))
    _to_files(marked.mapInArrow(_archive, "archive string, content binary"), path, "archive")


def inflate(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The bytes inside a gzip file of any number of members, which comes in chunks, a bounded piece at a time."""
    stream = None
    for pending in chunks:
        while pending:
            if stream is None:
                stream = zlib.decompressobj(31)
            yield stream.decompress(pending, STEP_BYTES)
            pending = stream.unconsumed_tail
            if stream.eof:
                pending, stream = stream.unused_data, None
    while stream is not None:  # output that the size of a piece has held back
        rest = stream.decompress(b"", STEP_BYTES)
        yield rest
        if stream.eof:
            stream = None
        elif not rest:
            raise ValueError("the gzip stream breaks off")


def fed(content: bytes) -> Iterator[bytes]:
    """Small chunks, because what follows a member is copied when it ends."""
    return (content[i : i + FEED_BYTES] for i in range(0, len(content), FEED_BYTES))


def split_records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """Whole WARC records, with their closing line ends; raises ValueError for what is no record."""
    held = bytearray()
    need = 0
    for piece in pieces:
        held += piece
        while len(held) >= max(need, 4):
            end = held.find(b"\r\n\r\n") if need == 0 else need
            if end < 0:
                break
            if need == 0:
                if not held.startswith(b"WARC/"):
                    raise ValueError("no WARC record where one should begin")
                fields, begin = headers(bytes(held[: end + 4]))
                need = begin + int(fields["content-length"]) + 4
                continue
            if held[need - 4 : need] != b"\r\n\r\n":
                raise ValueError("a record is longer than it says")
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("a record breaks off")


_ENTRY = "struct<offset:long,length:long,record_id:string,warc_type:string,target_uri:string>"
_PARTS = f"archive string, part int, content binary, entries array<{_ENTRY}>, error string"


_ENTRY_TYPE = pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()),
                         ("warc_type", pa.string()), ("target_uri", pa.string())])


def _members(name: str, pieces: Iterable[bytes], part_bytes: int) -> Iterator[pa.RecordBatch]:
    """The parts of one archive, given its inflated bytes: a gzip member for each record, and their entries."""
    def out(error: str | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([name]), pa.array([part], pa.int32()), pa.array([b"".join(members)], pa.binary()),
             pa.array([entries], pa.list_(_ENTRY_TYPE)), pa.array([error], pa.string())],
            ["archive", "part", "content", "entries", "error"])

    part, members, entries, offset, error = 0, [], [], 0, None
    try:
        for raw in split_records(pieces):
            member = gzip.compress(raw, LEVEL, mtime=0)
            fields, _ = headers(raw)
            entries.append({
                "offset": offset, "length": len(member), "record_id": fields.get("warc-record-id"),
                "warc_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri")})
            members.append(member)
            offset += len(member)
            if offset >= part_bytes:
                yield out(None)
                part, members, entries, offset = part + 1, [], [], 0
    except (ValueError, KeyError, zlib.error) as fault:
        error = str(fault) or type(fault).__name__
    if members or error or not part:
        yield out(error)


def _rewrite(part_bytes: int):
    """Archives that are cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, name in zip(batch.column(0), batch.column(1).to_pylist()):
                yield from _members(name, inflate(fed(content.as_py())), part_bytes)
    return run


def _rewrite_lines(part_bytes: int):
    """Archives that come as runs of bytes up to a line feed, sorted by file and position."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            name, file, size, raw = (c.to_pylist() for c in batch.columns[:4])
            yield from zip(name, file, size, raw)

    def chunks(rows: Iterable[tuple], size: int | None) -> Iterator[bytes]:
        """Many runs at a time. The reader does not say whether a line feed ends the last one; the length does."""
        held, most = bytearray(), FEED_BYTES
        for *_, raw in rows:
            held += raw
            held += b"\n"
            if len(held) >= most:
                if size is not None:
                    del held[size:]
                    size -= len(held)
                yield bytes(held)
                held = bytearray()
        yield bytes(held if size is None else held[:size])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (name, file, size), rows in groupby(runs(batches), lambda r: r[:3]):
            inflated = file.endswith(".gz")  # by the reader
            pieces = chunks(rows, None) if inflated else inflate(chunks(rows, size))
            yield from _members(name, pieces, part_bytes)
    return run


def normalise(spark: SparkSession, source: str, target: str, index: str, part_bytes: int = PART_BYTES,
              keep_source: bool = True, whole_bytes: int = WHOLE_BYTES) -> None:
    """Rewrite the archives below `source` with one gzip member per record, and write their index.

    Files of at most `whole_bytes` are read as one row each. Longer ones are
    read in splits as runs of bytes, sorted by position, and streamed through
    one task per file, so that no file has to fit into a cell or into memory;
    a name that ends in `.gz` lets the reader inflate the stream itself. Such a
    stream cannot be entered in the middle. The index is a table of (archive,
    part, offset, length, record_id, warc_type, target_uri, error); the files
    lie below `target` in folders by archive and part.
    """
    ship(spark)
    named = F.col("archive").cast("string").alias("archive")
    small = spark.read.format("binaryFile").load(source).where(F.col("length") <= whole_bytes).select("content", named)
    runs = spark.read.option("lineSep", "\n").text(source).where(F.col("_metadata.file_size") > whole_bytes).select(
        named, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"))
    large = runs.repartition("archive", "file").sortWithinPartitions("archive", "file", "block", "place")
    parts, path = write_table(
        small.mapInArrow(_rewrite(part_bytes), _PARTS).unionByName(
            large.mapInArrow(_rewrite_lines(part_bytes), _PARTS)), "archive-parts")
    if not keep_source:
        discard(spark, source)
    _to_files(parts, target, "archive", "part")
    parts.select("archive", "part", "error", F.inline_outer("entries")).write.parquet(index)
    discard(spark, path)


_RECORDS = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, "
            "payload binary")


def _page(value: str | None) -> int | None:
    digits = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _read(with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, entries in zip(batch.column(0), batch.column(1).to_pylist()):
                whole, rows = content.as_py(), []
                for e in entries:
                    raw = gzip.decompress(whole[e["offset"] : e["offset"] + e["length"]])
                    fields, begin = headers(raw)
                    block = raw[begin:-4]
                    http, body = headers(block)
                    payload, kind = block[body:], fields["warc-type"]
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and base32_sha1(payload) != digest:
                        raise ValueError(f"{fields['warc-record-id']}: the payload is not the one that was digested")
                    rows.append((
                        _page(fields["warc-record-id"]), len(payload) if kind == "response" else int(
                            http["content-length"]), digest, kind, _page(fields.get("warc-refers-to")),
                        fields.get("warc-target-uri"), payload if with_payload else None))
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                        [f.split()[0] for f in _RECORDS.split(", ")])
    return run


def read_records(spark: SparkSession, target: str, index: str, with_payload: bool = True) -> DataFrame:
    """One row per record of normalised archives, reached by the offsets in their index.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url,
    payload); a revisit has the size and digest of the payload it leaves out.
    """
    ship(spark)
    entries = spark.read.parquet(index).where("offset is not null").groupBy("archive", "part").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("entries"))
    files = _from_files(spark, target).select(
        "content", F.col("archive").cast("string").alias("archive"), F.col("part").cast("int").alias("part"))
    return files.join(entries.hint("merge"), ["archive", "part"]).select("content", "entries").mapInArrow(
        _read(with_payload), _RECORDS)


def round_trip(pages: DataFrame, **rules) -> DataFrame:
    """Write pages to archives in the scratch folder, normalise those, and read the records back.

    No pages make no files, and no records.
    """
    spark = pages.sparkSession
    source, target, index = (scratch_path(spark, n) for n in ("warc-raw", "warc", "warc-index"))
    if pages.isEmpty():
        return spark.createDataFrame([], _RECORDS).drop("payload")
    write_archives(pages, source, **rules)
    normalise(spark, source, target, index, keep_source=False)
    return read_records(spark, target, index, with_payload=False).drop("payload")
