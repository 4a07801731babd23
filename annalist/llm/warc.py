"""WARC archives in Zstandard: one dictionary per archive, one frame per record.

An archive starts with a skippable frame that holds the dictionary; each record is a frame of
its own, compressed with it, so a reader can decode records one at a time. The reader checks the
version line, the header fields, the block length and the payload digest of each record.

Equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the record with the smallest
page_id is the response, the others are revisits without payload.

Scale: digests are computed in the scan; only (digest, page_id) rows are aggregated, with a
map-side minimum, and copies of a hot payload meet a broadcast row of it; the join back on page_id
spreads evenly, or sends the revisits to the pages where they are few. Each task writes archives of bounded size straight to the shared folder, under a name of
its own attempt; only archives listed by the task that won are read.

Defined results. Null html: empty payload. Null page_id: written with no id, read back as null,
never the response of others. Repeated page_ids: one record each. Very long payloads are one record, held
whole by the task that writes or reads it. Empty table: no archive. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import join_groups, shared_dir, spool

MIN_REVISIT = 100
#: A task starts a new archive after so many bytes, so one archive always fits a task that reads it.
ARCHIVE_BYTES = 32 << 20
#: A reader hands on payloads of so many bytes together.
BATCH_BYTES = 8 << 20
#: So many revisits, of about 200 bytes each in memory, are sent to all executors.
BROADCAST_REVISITS = 100_000
#: The dictionary is trained on at most so many records of the archive, of so many bytes each.
DICT_BYTES, DICT_RECORDS, DICT_RECORD_BYTES = 16 << 10, 96, 8 << 10
LEVEL = 3
_SKIPPABLE = 0x184D2A5D
_HEAD, _HEAD_BYTES = "<II", 8

RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def record_block(page_id, uri, digest, size, refers_to, payload: bytes) -> bytes:
    """One WARC record: version line, headers, empty line, block, two line ends."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(payload))),
        ("X-Payload-Length", str(size)),
    ]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if uri is not None:
        head.append(("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")))
    if refers_to is not None:
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        head.append(("X-Refers-To-Page-ID", str(refers_to)))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of RECORD from one record, after checking headers, lengths and digest."""
    top, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of headers")
    version, *lines = top.decode().split("\r\n")
    if version not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"version line {version!r}")
    head = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"header {line!r}")
        head[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in head:
            raise WarcError(f"no {name}")
    size = int(head["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {size}, but {len(rest) - 4} bytes follow")
    payload, kind = rest[:size], head["warc-type"]
    digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        own = hashlib.sha256(payload).hexdigest()
        if digest and own != digest:
            raise WarcError("payload digest differs")
        digest, length = own, size
    elif kind == "revisit":
        if size or not digest or "x-refers-to-page-id" not in head:
            raise WarcError("revisit without digest or target, or with a payload")
        length = int(head["x-payload-length"])
    else:
        raise WarcError(f"type {kind!r}")
    whole = lambda x: int(head[x]) if x in head else None
    return {
        "page_id": whole("x-page-id"), "payload_bytes": length, "payload_digest": digest, "record_type": kind,
        "refers_to": whole("x-refers-to-page-id"), "target_uri": head.get("warc-target-uri"), "payload": payload,
    }


def train(records: list[bytes]) -> bytes:
    """A dictionary for the archive; empty where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, [r[:DICT_RECORD_BYTES] for r in records[:DICT_RECORDS]]).as_bytes()
    except zstandard.ZstdError:
        return b""


def read_archive(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one frame each; holds a chunk and one record at a time."""
    head = stream.read(_HEAD_BYTES)
    if len(head) < _HEAD_BYTES:
        raise WarcError("no leading frame")
    magic, size = struct.unpack(_HEAD, head)
    if magic != _SKIPPABLE:
        raise WarcError(f"leading frame {magic:#x} holds no dictionary")
    raw = stream.read(size)
    if len(raw) != size:
        raise WarcError("dictionary cut off")
    codec = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    frame, parts, ended = codec.decompressobj(), [], True
    while data := stream.read(chunk):
        while data:
            ended = False
            parts.append(frame.decompress(data))
            if not frame.eof:
                break
            yield b"".join(parts)
            data, parts, ended = frame.unused_data, [], True
            frame = codec.decompressobj()
    if not ended:
        raise WarcError("last frame cut off")


def mark_revisits(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) plus payload (null for revisits), size, digest and refers_to."""
    body = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    own = pages.select("page_id", "url", body.alias("payload")).withColumns(
        {"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)}
    )
    keys = own.filter(F.col("page_id").isNotNull() & (F.col("size") >= MIN_REVISIT)).select("page_id", "digest")
    first = spool(keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "first-pages")
    later = join_groups(keys, first, ["digest"]).filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()
    later = spool(later, "revisits")
    # few revisits go to the pages; otherwise both are shuffled
    later = F.broadcast(later) if later.count() <= BROADCAST_REVISITS else later.hint("merge")
    joined = own.join(later, ["page_id", "digest"], "left")
    return joined.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes archives from the rows of mark_revisits; (path, n_records, n_bytes) of each."""
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())])

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, written, count, waiting = None, "", 0, 0, []
        codec = None

        def open_archive(sample: list[bytes]) -> None:
            nonlocal out, path, written, count, codec
            raw = train(sample)
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            out = fs.open_output_stream(path)
            out.write(struct.pack(_HEAD, _SKIPPABLE, len(raw)) + raw)
            written, count = _HEAD_BYTES + len(raw), 0
            codec = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)

        def put(block: bytes) -> None:
            nonlocal written, count
            frame = codec.compress(block)
            out.write(frame)
            written, count = written + len(frame), count + 1

        def closed() -> pa.RecordBatch:
            nonlocal out
            out.close()
            out = None
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((path, count, written), schema, strict=True)], schema=schema)

        for b in batches:
            columns = [b.column(i) for i in range(b.num_columns)]
            for row in zip(*columns, strict=True):
                page_id, url, payload, size, digest, refers_to = (x.as_py() for x in row)
                block = record_block(page_id, url, digest, size, refers_to, payload or b"")
                if out is None:
                    waiting.append(block)
                    if len(waiting) >= DICT_RECORDS:
                        open_archive(waiting)
                        for x in waiting:
                            put(x)
                        waiting = []
                    continue
                put(block)
                if written >= ARCHIVE_BYTES:
                    yield closed()
        if waiting:
            open_archive(waiting)
            for x in waiting:
                put(x)
        if out is not None:
            yield closed()

    rows = records.select("page_id", "url", "payload", "size", "digest", "refers_to")
    return rows.mapInArrow(archives, "path string, n_records long, n_bytes long")


def read(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the listed archives (path, n_records, ...); the counts must agree."""
    fields = RECORD if payloads else RECORD.rsplit(",", 1)[0]
    names = [x.split()[0] for x in fields.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in fields.split(", ")])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows, seen, size = [], 0, 0
                with fs.open_input_stream(path) as stream:
                    for data in read_archive(stream):
                        record = parse_record(data)
                        rows.append({n: record[n] for n in names})
                        seen += 1
                        size += len(record["payload"]) if payloads else 0
                        if len(rows) >= 1024 or size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if seen != expected:
                    raise WarcError(f"{path}: {seen} records, {expected} expected")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    listed = archives.select("path", "n_records")
    return listed.repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism) * 2, "path").mapInArrow(records, fields)


def round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes all pages as archives in the shared folder and reads them back."""
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archives = spool(write(mark_revisits(pages), folder), "warc-list")
    return read(archives, folder, payloads)
