"""Fill-in-middle transformation by displacement scatter, and its inverse by gather.

The texts of a batch lie in one array of bytes. A scan of the array finds where units start, and with them where each
text is cut into prefix, middle and suffix. All bytes of such a segment move by the same distance, so a difference array
with a step at each segment's start, summed up, gives every byte its shift, and one scatter writes all outputs. Going
back, the marks are found in the outputs, a difference array over the restored bytes says where each one comes from, and
one gather reads them. Shifts are summed up in blocks of bytes, so a long text needs no array of numbers of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.encode import portions
from plumbline.llm.text import whole

PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]
#: The marks' middle letters; a mark is that letter between angle brackets.
PREFIX, SUFFIX, MIDDLE = b"PSM"
#: Of 100 texts, those that stay plain, and of 100 others, those that begin with their suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes whose shifts are summed up at once, and bytes of text of a batch.
BLOCK, AT_ONCE = 1 << 20, 4_000_000
_DRAWS = ["first_draw", "second_draw", "plain_draw", "form_draw"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text's bytes begin (one more number than texts)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    begins = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[begins[0] : begins[-1]], begins - begins[0]


def strings(data: np.ndarray, begins: np.ndarray) -> pa.Array:
    """The inverse of ``buffers``."""
    own = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(np.ascontiguousarray(begins, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return own.cast(pa.string())


def unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where units start: a run of letters A-Z is one, any other code point is one of its own."""
    letter = ((data | 0x20) - ord("a")) < 26
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[begins[:-1][begins[:-1] < begins[1:]]] = True
    return np.flatnonzero(starts)


def marks(data: np.ndarray) -> np.ndarray:
    """Where marks begin."""
    at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">"))) if len(data) > 2 else np.zeros(0, np.int64)
    return at[np.isin(data[at + 1], np.frombuffer(b"PSM", np.uint8))]


def characters(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The code points of each stretch of bytes."""
    heads = np.append((data & 0xC0) != 0x80, False)
    bounds = np.stack([begins, ends], axis=1).ravel()
    return np.where(begins < ends, np.add.reduceat(heads, bounds, dtype=np.int64)[::2], 0) if len(begins) else np.zeros(0, np.int64)


def shifts(at: np.ndarray, by: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Blocks of bytes with the shift of each: ``by`` is the shift from ``at`` on; of equal places the last one holds."""
    steps = np.diff(by, prepend=0)
    first, held = 0, 0
    for begin in range(0, size, BLOCK):
        end = min(begin + BLOCK, size)
        last = int(np.searchsorted(at, end))
        block = np.zeros(end - begin, np.int64)
        np.add.at(block, at[first:last] - begin, steps[first:last])
        block[0] += held
        np.cumsum(block, out=block)
        first, held = last, int(block[-1])
        yield begin, end, block


def scattered(data: np.ndarray, begins: np.ndarray, cuts: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outputs of all texts in a row, and where each one begins. ``cuts``: where middle and suffix begin."""
    begin, end, (middle, suffix) = begins[:-1], begins[1:], cuts
    marked = form != PLAIN
    n_prefix, n_suffix = middle - begin, end - suffix
    out_begins = np.concatenate([[0], np.cumsum(end - begin + 9 * marked)])
    own = out_begins[:-1]
    to_prefix = np.where(form == PSM, 3, np.where(form == SPM, n_suffix + 6, 0))
    to_suffix = np.where(form == PSM, n_prefix + 6, 3)
    to_middle = n_prefix + n_suffix + 9
    at = np.stack([begin, middle, suffix], axis=1).ravel()
    by = np.stack([own + to_prefix - begin, np.where(marked, own + to_middle - middle, own - begin), np.where(marked, own + to_suffix - suffix, own - begin)], axis=1).ravel()
    out = np.empty(out_begins[-1], np.uint8)
    for a, b, shift in shifts(at, by, len(data)):
        out[np.arange(a, b) + shift] = data[a:b]
    for letter, place in ((PREFIX, own + to_prefix), (SUFFIX, own + to_suffix), (MIDDLE, own + to_middle)):
        for k, byte in enumerate((ord("<"), letter, ord(">"))):
            out[place[marked] - 3 + k] = byte
    return out, out_begins


def gathered(out: np.ndarray, out_begins: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts of outputs again, from the outputs and their forms alone."""
    found = marks(out)
    of = np.searchsorted(out_begins, found, "right") - 1
    found, of = found[form[of] != PLAIN], of[form[of] != PLAIN]
    marked = np.flatnonzero(form != PLAIN)
    if len(found) != 3 * len(marked) or (of.reshape(-1, 3) != marked[:, None]).any():
        raise ValueError("an output must have each of its three marks once")
    first, second, third = found.reshape(-1, 3).T
    begin, end = out_begins[:-1], out_begins[1:]
    begins = np.concatenate([[0], np.cumsum(end - begin - 9 * (form != PLAIN))])
    prefix, middle, suffix = begin.copy(), end.copy(), end.copy()
    n_prefix = end - begin
    n_middle = np.zeros_like(begin)
    spm = form[marked] == SPM
    prefix[marked], suffix[marked], middle[marked] = np.where(spm, second, first) + 3, np.where(spm, first, second) + 3, third + 3
    n_prefix[marked] = np.where(spm, third, second) - prefix[marked]
    n_middle[marked] = end[marked] - middle[marked]
    own = begins[:-1]
    at = np.stack([own, own + n_prefix, own + n_prefix + n_middle], axis=1).ravel()
    by = np.stack([prefix, middle, suffix], axis=1).ravel() - at
    data = np.empty(begins[-1], np.uint8)
    for a, b, shift in shifts(at, by, len(data)):
        data[a:b] = out[np.arange(a, b) + shift]
    return data, begins


def transformed(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    data, begins = buffers(batch.column("text"))
    starts = unit_starts(data, begins)
    upto = np.searchsorted(starts, begins)
    n = np.diff(upto)
    draws = [batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in _DRAWS]
    places = np.sort(np.stack([draws[0] % (n + 1), draws[1] % (n + 1)]), axis=0)
    # A text's end is the start of the next one's first unit, or lies past all units.
    cuts = np.append(starts, len(data))[upto[:-1] + places]
    cuts = np.where(places == n, begins[1:], cuts)
    plain = (begins[:-1] == begins[1:]) | (draws[2] % 100 >= 100 - PLAIN_PERCENT)
    plain[np.searchsorted(begins, marks_within(data, begins), "right") - 1] = True
    form = np.where(plain, PLAIN, np.where(draws[3] % 100 < SPM_PERCENT, SPM, PSM))
    out, out_begins = scattered(data, begins, cuts, form)
    count = lambda a, b: pa.array(characters(data, a, b), mask=plain)
    columns = [batch.column("id"), pa.array(n), pa.array(FORMS).take(pa.array(form)), count(begins[:-1], cuts[0]), count(cuts[0], cuts[1]), strings(out, out_begins)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def marks_within(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Marks that lie in one text as a whole."""
    at = marks(data)
    return at[np.searchsorted(begins, at, "right") == np.searchsorted(begins, at + 2, "right")]


def draws(identifier: Column, seed: int) -> list[Column]:
    """Four numbers below 2 ** 32, drawn from an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(_DRAWS)]


def transform(docs: DataFrame, seed: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``n`` units, ``form``, ``prefix_chars``, ``middle_chars``, ``output``.

    Draws depend on the id and the seed only, so rows that repeat an id are cut alike; a null id draws as the empty text.
    Null and empty texts have no units and stay plain, as do texts that hold a mark; the two lengths are null then.
    Other columns are not read, and an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), whole(f"`{text}`").alias("text"), *draws(F.col(f"`{id_column}`"), seed))
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, at_once=AT_ONCE):
            arrow = pa.schema([batch.schema.field("id"), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
            yield transformed(batch, arrow)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def restore(outputs: DataFrame, output: str = "output", form: str = "form", into: str = "restored") -> DataFrame:
    """``outputs``, all columns, and the exact texts that its outputs were made of, in a column ``into``."""
    rows = outputs.select(F.struct(*[F.col(f"`{c}`") for c in outputs.columns if c != output]).alias("row"), F.col(f"`{output}`").alias("output"), F.col(f"`{form}`").alias("form"))
    schema = T.StructType([*rows.schema.fields, T.StructField("restored", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "output", AT_ONCE):
            codes = pc.index_in(batch.column("form"), pa.array(FORMS)).to_numpy(zero_copy_only=False)
            restored = strings(*gathered(*buffers(batch.column("output")), codes))
            yield pa.RecordBatch.from_arrays([*batch.columns, restored], names=[*batch.schema.names, "restored"])

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col("output") if c == output else F.col(f"row.`{c}`") for c in outputs.columns], F.col("restored").alias(into))


def digests(docs: DataFrame, seed: int = 1, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``transform`` and ``restore`` with SHA-256 digests in place of the texts."""
    both = restore(transform(docs, seed, id_column, text))
    return both.select(F.col(f"`{id_column}`"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
