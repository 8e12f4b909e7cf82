"""Language identification with a string kernel.

Two texts are compared by the blended-spectrum presence kernel: the number of character n-grams (one to three
characters) that both have, over the root of the product of the numbers that each has. A bounded sample of labelled texts
gives the landmarks of a Nyström map, and a kernel ridge regression for each language against the rest is fitted on it.
Texts are scored in batches: presence of the landmarks' n-grams times the landmark matrix, times the weights.

Characters are letters in lower case over an alphabet of 64 codes; all that is not a letter is one code, a blank.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.text import in_slice, whole

UNKNOWN = "und"
CODES, LENGTHS = 64, (1, 2, 3)
#: Where the n-grams of each length begin in the space of all, and its size.
BEGINS = np.cumsum([0, *(CODES**n for n in LENGTHS)])
#: Labelled texts of a language that are learned from, and those of them that are landmarks, over all languages.
SAMPLE, LANDMARKS = 120, 160
RIDGE, SHARPNESS = 0.01, 6.0


def _code(point: int) -> int:
    """0 for what is no letter, 1 to 26 for a to z, beyond that a number of its own or one shared with other letters."""
    char = chr(point)
    if not char.isalpha():
        return 0
    low = char.lower()[0]
    return ord(low) - 96 if "a" <= low <= "z" else 27 + (ord(low) - 0xDF if 0xDF <= ord(low) <= 0xFF else ord(low)) % (CODES - 27)


_TABLE = np.array([0 if unicodedata.category(chr(p)) == "Cs" else _code(p) for p in range(0x10000)], np.uint8)


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) and points.max() > 0xFFFF:
        return np.array([_TABLE[p] if p <= 0xFFFF else _code(int(p)) for p in points], np.int32)
    return _TABLE[points].astype(np.int32)


def mark(text: str, present: np.ndarray) -> bool:
    """Set the n-grams of a text in a table of all of them; whether the text has a letter."""
    present[:] = False
    c = codes(text)
    if not c.any():
        return False
    gram = c
    for n, begin in zip(LENGTHS, BEGINS, strict=False):
        if n > 1:
            gram = gram[:-1] * CODES + c[n - 1 :]
        present[begin + gram] = True
    for n, begin in zip(LENGTHS, BEGINS, strict=False):
        present[begin] = False  # blanks only
    return True


_GRAMS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("grams", T.ArrayType(T.IntegerType()))])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    present = np.zeros(BEGINS[-1], bool)
    for batch in batches:
        langs, texts = (c.to_pylist() for c in batch.columns)
        rows = [(lang, np.flatnonzero(present).tolist()) for lang, text in zip(langs, texts, strict=True) if mark(text, present)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.array([x for _, x in rows], pa.list_(pa.int32()))], ["lang", "grams"])


class Model(NamedTuple):
    languages: list[str]
    grams: np.ndarray  # the n-grams that any landmark has
    landmarks: np.ndarray  # presence of those, scaled, a column per landmark
    weights: np.ndarray  # a column per language, the last row is the constant

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A row of scores for each text, and whether it has a letter."""
        present, lettered = np.zeros(BEGINS[-1], bool), np.zeros(len(texts), bool)
        found, sizes = np.zeros((len(texts), len(self.grams)), np.float32), np.ones(len(texts))
        for i, text in enumerate(texts):
            lettered[i] = mark(text, present)
            found[i] = present[self.grams]
            sizes[i] = max(1, np.count_nonzero(present))
        kernel = found @ self.landmarks / np.sqrt(sizes)[:, None].astype(np.float32)
        return kernel @ self.weights[:-1] + self.weights[-1], lettered


def fit(rows: list[tuple[str, list[int]]]) -> Model | None:
    """Nyström kernel ridge regression on (language, n-grams) rows, which are ordered so that languages alternate."""
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    chosen = rows[:LANDMARKS]
    grams = np.unique(np.concatenate([np.asarray(g) for _, g in chosen]))
    table = np.zeros((len(rows), len(grams)), np.float32)
    for i, (_, g) in enumerate(rows):
        table[i, np.searchsorted(grams, np.intersect1d(g, grams))] = 1
    sizes = np.sqrt([len(g) for _, g in rows]).astype(np.float32)
    landmarks = (table[: len(chosen)] / sizes[: len(chosen), None]).T
    kernel = (table @ landmarks / sizes[:, None]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[: len(chosen)])
    good = values > 1e-6 * values.max()
    to_features = vectors[:, good] / np.sqrt(values[good])
    features = np.hstack([kernel @ to_features, np.ones((len(rows), 1))])
    aims = np.array([[1.0 if lang == x else -1.0 for x in languages] for lang, _ in rows])
    weight = 1 / np.array([sum(lang == other for other, _ in rows) for lang, _ in rows])  # languages count alike
    penalty = RIDGE * np.eye(features.shape[1])
    penalty[-1, -1] = 1e-6
    solved = np.linalg.solve(features.T @ (features * weight[:, None]) + penalty / len(languages), features.T @ (aims * weight[:, None]))
    return Model(languages, grams, landmarks, np.vstack([to_features @ solved[:-1], solved[-1:]]).astype(np.float32))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id") -> Model | None:
    """A model of ``docs``: of each language, the ``SAMPLE`` texts whose ids come first in a drawn order.

    Rows without a language or without a letter teach nothing; with none left there is no model. The sample is bounded by
    ``SAMPLE`` texts a language, of which only the n-grams come to the driver.
    """
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.md5(F.coalesce(F.col(order).cast("string"), F.lit("")).cast("binary")).alias("drawn"), whole(text).alias("text"))
    lettered = rows.filter(F.col("text").rlike(r"\p{L}"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("drawn", F.xxhash64("text")))
    # Only the first of each partition of the input reach the window: Spark limits the groups before the shuffle.
    sample = lettered.withColumn("nth", nth).filter(F.col("nth") <= SAMPLE).orderBy("nth", "lang").select("lang", "text")
    return fit([(r["lang"], r["grams"]) for r in sample.mapInArrow(_grams, _GRAMS).collect()])


_VERDICT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` in place of columns of those names.

    A null text, a text without a letter, and every text where there is no model, is ``und`` with score 0. The score is
    the share of the predicted language among the exponentials of all languages' scores. Rows are judged one by one.
    """

    @F.arrow_udf(_VERDICT)
    def verdict(texts: pa.Array) -> pa.Array:
        names, shares = [], []
        for start in range(0, len(texts), 128):
            part = [x or "" for x in texts.slice(start, 128).to_pylist()]
            if model is None:
                names += [UNKNOWN] * len(part)
                shares += [0.0] * len(part)
                continue
            scores, lettered = model.scores(part)
            likes = np.exp(SHARPNESS * (scores - scores.max(axis=1, keepdims=True)).astype(np.float64))
            best = scores.argmax(axis=1)
            share = likes[np.arange(len(part)), best] / likes.sum(axis=1)
            names += [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
            shares += np.where(lettered, share, 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], ["lang_pred", "score"])

    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(F.struct(*others).alias("row"), verdict(whole(text)).alias("verdict")).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("lang_pred", "score")], "verdict.*")


def held_out_languages(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", parts: int = 4, held: int = 2) -> DataFrame:
    """One row per document: id, ``held_out``, ``lang_pred``, ``score``; learned from the documents that are not held out.

    Which are held out is drawn from ids (a null id counts as the empty text). An empty table gives no rows.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"), (in_slice(F.col(id_column), parts) == held).alias("held_out"))
    model = learn(rows.filter(~F.col("held_out")), order="id")
    return identify(rows.select("id", "text", "held_out"), model).select(F.col("id").alias(id_column), "held_out", "lang_pred", "score")
