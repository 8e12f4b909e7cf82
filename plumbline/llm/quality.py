"""Quality rules as weak supervision.

Each rule votes good or bad on a document, or abstains. An expectation-maximisation fit over the counts of all vote
patterns of the corpus estimates how each rule votes on good and on bad documents, and a document's verdict is the
posterior probability that it is good. There are at most ``3 ** len(RULES)`` patterns, so the driver sees a table of
bounded size whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.encode import portions
from plumbline.llm.text import whole
from plumbline.session import stored

BAD, ABSTAIN, GOOD = 0, 1, 2
#: Blanks between words, and the symbols that count as such.
BLANKS, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
#: ASCII other than letters; bytes beyond ASCII count as parts of letters.
NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
MIN_WORDS, MAX_REPEATS_PERCENT = 50, 50

#: name -> (share or size of a document, bad from, good up to). Between the two the rule abstains. A rule that looks for
#: one defect never votes good (None): that a text lacks this defect says little about its quality.
RULES: dict[str, tuple[Callable[[dict[str, np.ndarray]], np.ndarray], float, float | None]] = {
    "other_than_letters": (lambda m: 1 - m["n_letters"] / m["chars_1"], 0.20, 0.07),
    "word_length": (lambda m: abs(m["word_chars"] / m["words_1"] - 6.0), 4.0, 2.5),
    "symbols_per_word": (lambda m: m["n_symbols"] / m["words_1"], 0.10, None),
    "repeated_words": (lambda m: m["n_repeat_words"] / m["words_1"], 0.35, None),
    "repeated_lines": (lambda m: m["n_dup_lines"] / m["lines_1"], 0.40, None),
    "upper_case": (lambda m: m["n_upper"] / m["chars_1"], 0.25, None),
    "shouts": (lambda m: m["n_shouts"] / m["words_1"], 0.10, None),
    "bare_marks": (lambda m: m["n_marks"] / m["words_1"], 0.10, None),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: P(bad), P(abstain), P(good) of a rule on a bad and on a good document, before the corpus is seen.
START = {"one defect": np.array([[0.40, 0.60, 1e-6], [0.01, 0.99, 1e-6]]), "both ways": np.array([[0.45, 0.25, 0.30], [0.02, 0.18, 0.80]])}
SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in MEASURES] + [T.StructField("votes", T.IntegerType())])


def repeat_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text has twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    a = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    pairs = a[:-1] * len(number) + a[1:]
    if len(number) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * len(number) + a[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def measure(texts: list[str]) -> dict[str, np.ndarray]:
    rows = []
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        chars = len(text) - sum(raw.count(bytes([b])) for b in BLANKS)
        upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        rows.append((
            len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), duplicate_lines(raw), repeat_words(words), raw.count(b"\n") + 1,
            upper, raw.count(b"!!") + raw.count(b"??"), len(raw.translate(None, NOT_LETTERS)) - (len(raw) - len(text)), sum(raw.count(b" " + m + b" ") for m in (b"|", b"-", b"*", b"#")),
        ))
    names = [*MEASURES, "n_lines", "n_upper", "n_shouts", "n_letters", "n_marks"]
    table = np.array(rows, np.int64).reshape(-1, len(names))
    m = {name: table[:, i] for i, name in enumerate(names)}
    return m | {"words_1": np.maximum(m["n_words"], 1), "chars_1": np.maximum(m["word_chars"], 1), "lines_1": np.maximum(m["n_lines"], 1)}


def vote_codes(m: dict[str, np.ndarray]) -> np.ndarray:
    """One number per document with a base-3 digit per rule. A text without words gets no good vote."""
    code = np.zeros(len(m["n_words"]), np.int64)
    for value, bad, good in RULES.values():
        x = value(m)
        vote = np.where(x >= bad, BAD, np.where((x <= (-np.inf if good is None else good)) & (m["n_words"] > 0), GOOD, ABSTAIN))
        code = code * 3 + vote
    return code


def measured(rows: DataFrame) -> DataFrame:
    """``rows(x, text)`` as ``x`` and ``measures``, in portions of a bounded number of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            m = measure(batch.column(1).to_pylist())
            columns = [pa.array(m[c]) for c in MEASURES] + [pa.array(vote_codes(m).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.StructArray.from_arrays(columns, names=SCHEMA.names)], names=[batch.schema.names[0], "measures"])
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, T.StructType([rows.schema.fields[0], T.StructField("measures", SCHEMA)]))


def unpacked(codes: np.ndarray) -> np.ndarray:
    """Vote codes as a table of votes, a column per rule."""
    return np.stack([codes // 3**k % 3 for k in range(len(RULES) - 1, -1, -1)], axis=1) if len(codes) else np.zeros((0, len(RULES)), np.int64)


def fit(codes: np.ndarray, counts: np.ndarray, rounds: int = 100, prior_good: float = 0.8, strength: float = 0.02) -> np.ndarray:
    """The posterior that a document with such votes is good, by expectation-maximisation.

    ``P(vote | class)`` starts at, and is pulled towards, the shares in ``START``; the pull weighs ``strength`` of all
    documents, so that the classes cannot change places.
    """
    if not len(codes):
        return np.zeros(0)
    votes, total = unpacked(codes), counts.sum()
    start = np.stack([START["one defect" if good is None else "both ways"] for _, _, good in RULES.values()], axis=1)
    given = start
    share, rule = prior_good, np.arange(len(RULES))
    for _ in range(rounds):
        like = np.log(given[:, rule, votes]).sum(axis=2) + np.log([1 - share, share])[:, None]
        good = 1 / (1 + np.exp(np.clip(like[0] - like[1], -700, 700)))
        weight = np.stack([(1 - good) * counts, good * counts])
        seen = np.stack([[[(weight[c] * (votes[:, r] == v)).sum() for v in range(3)] for r in rule] for c in range(2)])
        pull = strength * total * start + 1e-3
        given = (seen + pull) / (seen + pull).sum(axis=2, keepdims=True)
        share = (weight[1].sum() + strength * total * prior_good + 1) / (total * (1 + strength) + 2)
    return good


def judge(rows: DataFrame, corpus: DataFrame) -> DataFrame:
    """Adds ``posterior``, ``base_failed`` and ``kept`` to rows that carry the struct ``measures``, by those of the corpus."""
    spark = rows.sparkSession
    seen = corpus.groupBy(F.col("measures.votes").alias("votes")).count().toPandas()  # at most 3 ** len(RULES) rows
    good = fit(seen["votes"].to_numpy(np.int64), seen["count"].to_numpy(np.float64))
    known = spark.createDataFrame([(int(v), float(p)) for v, p in zip(seen["votes"], good, strict=True)], "__votes int, posterior double")
    out = rows.join(F.broadcast(known), F.col("measures.votes") == F.col("__votes"), "left").drop("__votes")
    n, repeats = F.col("measures.n_words"), F.col("measures.n_repeat_words")
    out = out.withColumn("base_failed", (n < MIN_WORDS) | (100 * repeats > MAX_REPEATS_PERCENT * n))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def quality(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, measures, ``base_failed``, ``posterior``, ``kept``.

    Null and empty texts have no words and fail the base rule. Rows are judged one by one: rows that repeat get the same
    result each, a null id is kept as it is, and an empty table gives no rows.
    """
    rows = measured(docs.select(F.col(id_column).alias("id"), whole(text).alias("text")))
    rows = stored(rows, "quality-measures")
    judged = judge(rows, rows)
    return judged.select(F.col("id").alias(id_column), *[F.col(f"measures.{c}").alias(c) for c in MEASURES], "base_failed", "kept", "posterior")


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rejected documents. Columns may have any names.

    Rows are judged as in ``quality``: nulls, empty texts and repeated rows have the same result here. An empty table
    stays empty. Texts are measured once for the fit, which sees votes only, and once for the verdict: to keep the rows
    between the two would take a copy of the corpus.
    """
    packed = measured(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole(f"`{text}`").alias("text")))
    votes = measured(docs.select(F.lit(0).alias("x"), whole(f"`{text}`").alias("text")))
    return judge(packed, votes).filter("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
