"""Token ids in files of fixed-width bits.

A file holds the documents of one stretch of ascending ids. Every token id takes as many bits as the vocabulary needs;
ids are packed in blocks of ``BLOCK`` tokens that begin at whole bytes, and the offsets of the blocks are in the header, so
that any range of tokens is found without reading what stands before it.

    magic 8 bytes | version, bits, block: uint32 | documents, tokens, blocks, part, number: uint64
    document ids: int64 each | id is null: uint8 each | ends of documents in tokens: uint64 each
    offsets of blocks from the start of the file, and the end: uint64 each | packed blocks

All numbers are little-endian; the bits of an id go from the highest to the lowest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.encode import byte_bpe, encoder, portions
from plumbline.llm.text import whole
from plumbline.session import run_folder, stored

MAGIC, VERSION, BLOCK, END = b"PLBTOKN1", 1, 65_536, 0
#: Tokens after which a worker closes a file; a document is never cut.
FILE_TOKENS = 4_000_000
_HEAD = struct.Struct("<8sIIIQQQQQ")


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as a bit string, each in ``bits`` bits, filled to whole bytes."""
    return np.packbits(np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]).tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = flat
    return np.packbits(wide, axis=1).view(">u4").ravel().astype("<u4")


def file_bytes(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, bits: int, part: int, number: int) -> bytes:
    """A file's content; ``ends`` are the ends of the documents in ``ids``."""
    blocks = [pack_bits(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    begin = _HEAD.size + 17 * len(doc_ids) + 8 * (len(blocks) + 1)
    offsets = np.cumsum([begin, *map(len, blocks)]).astype("<u8")
    head = _HEAD.pack(MAGIC, VERSION, bits, BLOCK, len(doc_ids), len(ids), len(blocks), part, number)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids)
    return b"".join([head, known, np.asarray(ends, "<u8").tobytes(), offsets.tobytes(), *blocks])


class TokenFile:
    """Reads a file's content; any range of tokens touches only the blocks it lies in."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        magic, version, self.bits, self.block, n_docs, self.tokens, n_blocks, self.part, self.number = _HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = _HEAD.size
        ids, nulls = np.frombuffer(data, "<i8", n_docs, at), np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [None if null else int(d) for d, null in zip(ids, nulls, strict=True)]
        self.ends = np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 17 * n_docs)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Token ids from ``start`` up to ``stop``."""
        if stop <= start:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        parts = [unpack_bits(self.data[self.offsets[b] : self.offsets[b + 1]], self.bits, min(self.block, self.tokens - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]

    def document(self, row: int) -> np.ndarray:
        return self.read(int(self.ends[row - 1]) if row else 0, int(self.ends[row]))


def _writer(path: str, folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def save(name: str, data: bytes) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        # Another attempt of the task writes the same bytes under the same name; a file is never seen half-written.
        draft = f"{root}/_{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            out.write(data)
        store.move(draft, f"{root}/{name}")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, known = TaskContext.get().partitionId(), 0, encoder(path)
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        total = 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, ids, ends, total, number
            save(f"part-{part:06d}-{number:06d}.bits", file_bytes(doc_ids, np.concatenate(ends), np.concatenate(ids), bits_for(known.size), part, number))
            row = pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, number, len(doc_ids), total)], ["part", "number", "documents", "tokens"])
            doc_ids, ids, ends, total, number = [], [], [], 0, number + 1
            return row

        for batch in portions(batches):
            got, starts = known.encode(batch.column(1), END)
            doc_ids += batch.column(0).to_pylist()
            ids.append(got)
            ends.append(starts[1:] + total)
            total += len(got)
            if total >= FILE_TOKENS:
                yield close()
        if doc_ids:
            yield close()

    return write


def write_tokens(docs: DataFrame, folder: str, id_column: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` to files in ``folder`` in ascending id order; returns the manifest (part, number, documents, tokens).

    A document is its ids and an end id; a null or empty text is the end id alone. Null ids come first. Rows that repeat
    an id follow each other, ordered by a hash of their texts. An empty table writes no file. Other columns are not read.
    """
    body = docs.select(F.col(id_column).cast("long").alias("id"), whole(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = body.repartitionByRange(parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return stored(ordered.mapInArrow(_writer(tokenizer or byte_bpe(), folder), "part long, number long, documents long, tokens long"), "token-manifest")


_READ = T.StructType([T.StructField(c, T.LongType()) for c in ("part", "number", "id", "start", "n_tokens", "ids_crc32")])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            f = TokenFile(data.as_py())
            begins = np.concatenate([[0], f.ends[:-1]])
            crcs = []
            for first in range(0, len(f.ends), 512):  # neighbouring documents are unpacked together
                last = min(first + 512, len(f.ends))
                ids = memoryview(f.read(int(begins[first]), int(f.ends[last - 1])).tobytes())
                crcs += [zlib.crc32(ids[4 * (a - begins[first]) : 4 * (b - begins[first])]) for a, b in zip(begins[first:last], f.ends[first:last], strict=True)]
            columns = [pa.array([f.part] * len(crcs), pa.int64()), pa.array([f.number] * len(crcs), pa.int64()), pa.array(f.doc_ids, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int64()) for x in (begins, f.ends - begins, crcs)]], _READ.names)


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document of the files: ``id``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids_crc32``."""
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("of_part"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(before.orderBy("part")), F.lit(0)).alias("parts_before"))  # a row for each part
    files = manifest.withColumn("files_before", F.coalesce(F.sum("tokens").over(before.partitionBy("part").orderBy("number")), F.lit(0)))
    firsts = files.join(parts, "part").select("part", "number", (F.col("parts_before") + F.col("files_before")).alias("first"))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bits").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = found.select("content").mapInArrow(_read, _READ)
    return rows.join(firsts, ["part", "number"]).select("id", (F.col("first") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, id_column: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Write the documents' ids to files of the shared folder and read them back."""
    folder = run_folder(docs.sparkSession, "token-files")
    manifest = write_tokens(docs, folder, id_column, text, tokenizer)
    if manifest.isEmpty():
        return docs.sparkSession.createDataFrame([], f"{id_column} long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(docs.sparkSession, folder, manifest).withColumnRenamed("id", id_column)
