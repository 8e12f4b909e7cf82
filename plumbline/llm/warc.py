"""WARC archives by way of a chunked record table.

A payload is never one value: it is rows of (record, chunk number, bytes), cut in the JVM on the way out and by the reader on
the way in. The writer streams chunks into the archive with a running digest; the reader yields a row for each chunk
with the digest of all bytes up to its end, so that the last chunk of a record carries that of the payload. Memory is
bounded by a chunk, however large a record is.

Records are responses, or revisits of the record with the same payload and the largest id. Each record is a gzip member
of its own, so archives can be read from any record on.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any, BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import run_folder, stored

#: Bytes of a chunk, and of compressed archive after which a worker begins another file.
CHUNK, FILE_BYTES = 262_144, 64_000_000
#: Payloads of fewer bytes are always written out.
REVISIT_FROM = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:plumbline:page:"


def plan_records(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id``, ``url``, ``payload``, ``n_bytes``, ``digest``, ``refers_to`` (null for a response)."""
    body = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    # Digests only, combined before the shuffle; most payloads are alone, and only the others come to the join.
    same = rows.filter(F.col("n_bytes") >= REVISIT_FROM).groupBy("digest", "n_bytes").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("copies"))
    groups = stored(same.filter("copies > 1").select(F.col("digest").alias("of"), F.col("n_bytes").alias("bytes"), "largest"), "revisit-groups")
    joined = rows.join(groups, (F.col("digest") == F.col("of")) & (F.col("n_bytes") == F.col("bytes")), "left")
    return joined.select("id", "url", "payload", "n_bytes", "digest", F.when(~F.col("id").eqNullSafe(F.col("largest")), F.col("largest")).alias("refers_to"))


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The records' chunks in order; a revisit and an empty payload have one empty chunk."""
    carried = F.when(F.col("refers_to").isNull(), F.col("n_bytes")).otherwise(0)
    last = F.greatest(F.lit(0), F.ceil(carried / chunk) - 1).cast("int")
    rows = records.select("id", "url", "n_bytes", "digest", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return rows.select("id", "url", "n_bytes", "digest", "refers_to", "chunk", F.substring("payload", F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"))


def _header(fields: list[tuple[str, Any]]) -> bytes:
    clean = lambda value: "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in str(value))  # noqa: E731  a line break would begin another field
    return ("WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass")


def record_head(row: dict[str, Any]) -> bytes:
    """All of a record up to its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<{_NAME}{row['id']}>"), ("WARC-Date", DATE), ("WARC-Target-URI", row["url"] or ""),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + (0 if revisit else row["n_bytes"])),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_NAME}{row['refers_to']}>")]
    return _header(fields) + http


def _writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, number, records, size = TaskContext.get().partitionId(), 0, 0, 0
        out = draft = packer = running = row = None

        def end_record() -> int:
            if running is not None and row["refers_to"] is None and running.hexdigest() != row["digest"]:
                raise ValueError(f"the chunks of record {row['id']} are not its payload")
            return out.write(packer.compress(b"\r\n\r\n") + packer.flush())

        def end_file() -> pa.RecordBatch:
            # A second attempt of the task writes the same records under the same name.
            out.close()
            name = f"part-{part:06d}-{number:06d}.warc.gz"
            store.move(draft, f"{root}/{name}")
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["file", "records"])

        for batch in batches:
            for new in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                if new["chunk"] == 0:
                    if running is not None:
                        size += end_record()
                        if size >= FILE_BYTES:
                            yield end_file()
                            number, records, size, out = number + 1, 0, 0, None
                    if out is None:
                        draft = f"{root}/_{part:06d}.{uuid.uuid4().hex}"
                        out = store.open_output_stream(draft, compression=None)
                    row, running, packer, records = new, hashlib.sha1(), zlib.compressobj(1, zlib.DEFLATED, 31), records + 1
                    size += out.write(packer.compress(record_head(new)))
                running.update(new["data"])
                size += out.write(packer.compress(new["data"]))
        if running is not None:
            end_record()
            yield end_file()

    return write


def write_archives(pages: DataFrame, folder: str, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record for each row of ``pages``; returns the manifest (file, records)."""
    chunks = chunk_rows(plan_records(pages, id_column, url, html))
    return stored(chunks.mapInArrow(_writer(folder), "file string, records long"), "archive-manifest")


class _Stream:
    """The bytes of an archive, unpacked member by member; only what is asked for is held."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.held, self.packed, self.unpacker = source, b"", b"", zlib.decompressobj(31)

    def more(self) -> bool:
        while True:
            if self.unpacker.eof:
                self.packed, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
            self.packed = self.packed or self.source.read(65_536)
            if not self.packed:
                return False
            data = self.unpacker.decompress(self.packed, CHUNK)
            self.packed = self.unpacker.unconsumed_tail
            if data:
                self.held += data
                return True

    def head(self) -> dict[str, str] | None:
        """The next block of header lines; its first line is under the empty name."""
        while (end := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                return None
        lines, self.held = self.held[:end].decode("utf-8", "surrogatepass").split("\r\n"), self.held[end + 4 :]
        return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def take(self, size: int) -> bytes:
        while len(self.held) < size and self.more():
            pass
        data, self.held = self.held[:size], self.held[size:]
        return data


def _page(name: str | None) -> int | None:
    text = (name or "").strip("<>").removeprefix(_NAME)
    return int(text) if text.lstrip("-").isdigit() else None


def archive_chunks(source: BinaryIO, chunk: int = CHUNK) -> Iterator[dict[str, Any]]:
    """A row for each chunk of each record, with the digest of the payload up to its end."""
    stream, record = _Stream(source), 0
    while (head := stream.head()) is not None:
        if not head[""].startswith("WARC/"):
            raise ValueError("not a WARC record")
        size = int(head["content-length"])
        http = stream.head() or {}
        declared = int(http.get("content-length", 0))
        left = declared if head["warc-type"] == "response" else 0
        running, number = hashlib.sha1(), 0
        while True:
            data = stream.take(min(chunk, left))
            left -= len(data)
            running.update(data)
            row = {"record": record, "page_id": _page(head["warc-record-id"]), "record_type": head["warc-type"], "refers_to": _page(head.get("warc-refers-to"))}
            yield row | {"declared_bytes": declared, "declared_digest": head["warc-payload-digest"].removeprefix("sha1:"), "chunk": number, "n_bytes": len(data), "digest": running.hexdigest(), "data": data}
            number += 1
            if not left:
                break
            if not data:
                raise ValueError(f"record {head['warc-record-id']} ends early")
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError(f"record {head['warc-record-id']} has {size} bytes by its header, but does not end there")
        record += 1


_LONG, _TEXT = T.LongType(), T.StringType()
_CHUNKS = T.StructType([T.StructField(*x) for x in (
    ("file", _TEXT), ("record", _LONG), ("page_id", _LONG), ("record_type", _TEXT), ("refers_to", _LONG), ("declared_bytes", _LONG), ("declared_digest", _TEXT), ("chunk", _LONG), ("n_bytes", _LONG), ("digest", _TEXT), ("data", T.BinaryType()),
)])


def chunk_table(manifest: DataFrame, folder: str, with_data: bool = True) -> DataFrame:
    """The chunked record table of archives, read as streams by one task for each file."""
    fields = [f for f in _CHUNKS.fields if with_data or f.name != "data"]
    names = [f.name for f in fields]
    schema = pa.schema([(f.name, pa.string() if f.dataType == _TEXT else pa.int64() if f.dataType == _LONG else pa.binary()) for f in fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for file in (f.as_py() for batch in batches for f in batch.column(0)):
            rows, size = [], 0
            with store.open_input_stream(f"{root}/{file}", compression=None) as source:
                for row in archive_chunks(source):
                    rows.append({"file": file} | {k: row[k] for k in names[1:]})
                    size += row["n_bytes"] if with_data else 64
                    if size >= 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    # A number of its own keeps adaptive execution from merging the files, whose names are small, into one task.
    return manifest.select("file").repartition(max(1, manifest.count()), "file").mapInArrow(read, T.StructType(fields))


def records(chunks: DataFrame) -> DataFrame:
    """One row per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    A response is described by its chunks, a revisit by what its header says of the payload that it refers to.
    """
    of = ["file", "record", "page_id", "record_type", "refers_to", "declared_bytes", "declared_digest"]
    rows = chunks.groupBy(*of).agg(F.sum("n_bytes").alias("n_bytes"), F.max(F.struct("chunk", "digest")).alias("last"))
    pick = lambda own, declared: F.when(F.col("record_type") == "response", F.col(own)).otherwise(F.col(declared))
    return rows.select("page_id", pick("n_bytes", "declared_bytes").alias("payload_bytes"), pick("last.digest", "declared_digest").alias("payload_digest"), "record_type", "refers_to")


def round_trip(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to archives in the shared folder and describe the records read back from them.

    A null html is the empty payload; a null url the empty one; control characters in a url are written as percent codes.
    Rows that repeat an id are records of their own; those that repeat the id and payload of a response are responses
    too. A null id is the smallest. An empty table writes no archive and gives no rows. Other columns are not read.
    """
    spark: SparkSession = pages.sparkSession
    folder = run_folder(spark, "archives")
    manifest = write_archives(pages, folder, id_column, url, html)
    return records(chunk_table(manifest, folder, with_data=False)).withColumnRenamed("page_id", id_column)
