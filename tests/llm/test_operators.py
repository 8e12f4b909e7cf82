"""Each operator against a plain version, on small tables."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import zlib
from collections import Counter
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm import attention, bitpack, encode, exact, langid, licenses, lmscore, mixing, neardup, packing, quality, warc
from plumbline.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference
from tests.llm import cases
from tests.llm.cases import FOLDER


def table(spark: SparkSession, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def ids_of(texts: list[str | None], end: int) -> list[list[int]]:
    tokenizer = encode.encoder(encode.byte_bpe()).tokenizer
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_twin(spark: SparkSession, name: str) -> None:
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


def test_all_are_registered() -> None:
    numbers = {n.split("_")[0] for n in QUERIES}
    assert numbers == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_license_spans(spark: SparkSession) -> None:
    notice = licenses.NOTICES["bsd"][0]
    words = notice.split()
    noisy = " ".join(words[:10] + ["really"] + words[11:])
    longer = " ".join(words[:10] + ["really"] + words[10:])
    rows = [(1, "x " + notice), (2, noisy), (3, " ".join(words[:6])), (4, "gnu general public license mit license apache license. Apache-License"), (5, "gnu general license"), (6, longer)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["labels"], got[1]["score"], got[1]["base_labels"]) == ("bsd", 1.0, "")
    assert (got[6]["labels"], got[6]["score"]) == ("bsd", 1.0)
    assert got[2]["labels"] == "bsd" and licenses.LEAST_COVER <= got[2]["score"] < 1
    assert got[3]["labels"] == "" and 0 < got[3]["score"] < licenses.LEAST_COVER
    assert (got[4]["base_labels"], got[4]["n_base"], got[4]["first_word"], got[4]["last_word"]) == ("apache,gpl,mit", 4, 0, 8)
    assert got[5]["n_base"] == 0


def test_license_cover_counts_words(spark: SparkSession) -> None:
    """A notice with a word left out keeps its label, and repeated rows keep theirs."""
    rows = [(1, "Licensed under Apache License, Version 2.0")] * 3 + [(2, "under apache")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r["labels"] for r in got if r["doc_id"] == 1] == ["apache,apache-2.0"] * 3 and len(got) == 4


def test_near_groups_of_edited_copies(spark: SparkSession) -> None:
    """A chain of edits, a star of edits and a passage that unrelated documents share."""
    rng, docs = random.Random(5), []
    base = cases.prose(9, 90).split()
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(90)] = f"w{rng.randrange(10**6)}"
        docs.append((i, " ".join(copy)))
    chain = cases.prose(10, 120).split()
    for i in range(150, 190):
        chain[rng.randrange(120)] = f"c{i}"
        docs.append((i, " ".join(chain)))
    passage = cases.prose(11, 60)
    docs += [(i, cases.prose(i, 70) + " " + passage) for i in range(200, 280)]
    docs += [(300, "a b"), (301, "A B"), (302, "a b c"), (303, None), (304, "")]
    rows = neardup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == cases.near_components(docs)
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(cases.shingles(t)) for i, t in docs}


def test_signatures_estimate_similarity() -> None:
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 700).astype(np.uint64)
        a, b = np.unique(pool[:600]), np.unique(pool[100:])
        errors.append((neardup.signature(a) == neardup.signature(b)).mean() - 500 / 700)
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.09


def test_quality_measures_and_verdicts(spark: SparkSession) -> None:
    rows = quality.quality(table(spark)).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark).collect()}
    for r in rows:
        assert tuple(r[c] for c in quality.MEASURES) == cases.measures(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    codes = quality.vote_codes(quality.measure([texts[r["doc_id"]] or "" for r in rows]))
    seen, which, counts = np.unique(codes, return_inverse=True, return_counts=True)
    good = quality.fit(seen, counts.astype(float))[which]
    assert [r["kept"] for r in rows] == [not r["base_failed"] and p >= 0.5 for r, p in zip(rows, good, strict=True)]
    truth = {r["doc_id"]: r["quality"] for r in table(spark, "labels").collect()}
    judged = [(truth[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in truth and r["n_words"] >= 50]
    assert all(kept for label, kept in judged if label == 1) and not any(kept for label, kept in judged if label == 0)


def test_lm_base_and_model(spark: SparkSession) -> None:
    docs = {r["doc_id"]: cases.words((r["text"] or "").translate(cases.LOW)) + [b"\n"] for r in table(spark).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = Counter(w for i, d in docs.items() if not held[i] for w in d)
    total, distinct = sum(counts.values()), len(counts)
    for r in lmscore.scores(table(spark)).collect():
        d = docs[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(d), sum(w in counts for w in d), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in d), rel_tol=1e-9)
        assert r["score"] < 0


def test_lm_learns_from_every_training_window(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Each token of each training text, also of texts of one window and of copies, is a target once."""
    texts = [cases.prose(i, 3) for i in range(40)] + ["one two"] * 5 + [cases.prose(99, 300), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    given: list[tuple] = []
    monkeypatch.setattr(lmscore, "learn", lambda *args: given.append(args) or lmscore.Language(*args[1:]))
    lmscore.scores(docs)
    rows, weights, begin = given[0]
    seen: list[np.ndarray] = []
    monkeypatch.setattr(attention, "train", lambda w, windows, rate, seed: seen.append(windows) or w)
    list(lmscore._trainer(weights, begin, 0.01, 0)(iter(rows.select("data").toArrow().to_batches())))
    dealt = [rows.filter(f"pmod(xxhash64(id, data), {lmscore.ROUNDS}) = {turn}").count() for turn in range(lmscore.ROUNDS)]
    assert sum(dealt) == rows.count() and min(dealt) > 0
    learned = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    lengths = np.array([len(x) for x in ids_of([" " + t if t else "" for t in learned], 0)])
    windows = np.concatenate(seen)
    assert len(windows) == -(-lengths // attention.WINDOW).sum() and (windows[:, 1:] >= 0).sum() == lengths.sum()


def test_training_is_worth_it(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """Held-out texts become more likely by training, by a tenth of a decade a token at least."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    trained = {r["doc_id"]: (r["score"], r["n_tokens"]) for r in lmscore.scores(docs).filter("held_out").collect()}
    monkeypatch.setattr(lmscore, "learn", lambda texts, weights, begin: lmscore.Language(weights, begin))
    before = {r["doc_id"]: r["score"] for r in lmscore.scores(docs).filter("held_out").collect()}
    gain = sum(s - before[i] for i, (s, _) in trained.items()) / sum(n for _, n in trained.values())
    assert trained.keys() == before.keys() and gain > 0.1


def test_a_token_past_the_first_window_sees_nine_tokens_or_more() -> None:
    rng = np.random.default_rng(4)
    weights = attention.initial(np.full(attention.CLASSES, 1 / attention.CLASSES)) + rng.normal(0, 0.2, attention._ENDS[-1]).astype(np.float32)
    classes = rng.integers(0, attention.CLASSES, 120)
    whole = lambda c, n: attention.score(weights, c[:n], np.array([0, n]), 0)[0] - attention.score(weights, c[: n - 1], np.array([0, n - 1]), 0)[0]
    for n in range(40, 72):
        moved = []
        for step in range(1, 9):
            other = classes.copy()
            other[n - 10] = (other[n - 10] + step) % attention.CLASSES  # the ninth class before the last one
            moved.append(abs(whole(classes, n) - whole(other, n)))
        assert max(moved) > 1e-4


def test_attention_is_a_distribution_and_learns() -> None:
    pairs = np.zeros((attention.BEFORE, 500), np.int64)
    pairs[:3] = np.random.default_rng(0).integers(0, 50, (3, 500))
    vocabulary = attention.vocabulary(pairs)
    for kind in (0, 2, 100):
        sums = np.bincount(vocabulary.classes, 10.0 ** vocabulary.shares[kind], attention.CLASSES)
        assert np.allclose(sums, 1, atol=1e-4)
    assert attention.before(np.array([5, 6, 5, 6, 7]), np.array([0, 2])).tolist()[::2] == [0, 0, attention.before(np.array([6, 7]), np.array([0]))[1]]
    weights = attention.initial(vocabulary.frequency)
    ends = [attention.score(weights, np.array([c]), np.array([0, 1]), 0)[0] for c in range(attention.CLASSES)]
    assert np.isclose(sum(10**e for e in ends), 1, atol=1e-4)
    pattern = np.tile(np.arange(5), 2000)
    windows = np.stack([pattern[i : i + attention.WINDOW + 1] for i in range(3000)])
    before = attention.score(weights, pattern[:100], np.array([0, 100]), 5)[0]
    trained = attention.train(weights, windows, 0.01, 0)
    assert attention.score(trained, pattern[:100], np.array([0, 100]), 5)[0] > before / 4


def test_ids_of_words_stay_in_one_piece() -> None:
    """A portion gives the ids of its words in one row; the rows that are shuffled by word hold no ids."""
    known = encode.encoder(encode.byte_bpe(), 1000)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "held_out": [False, True], "text": ["tokens of many words of", "words unheard"]})
    rows = [r for b in lmscore._portion_rows(batch, 7, known, 0) for r in b.to_pylist()]
    words = sorted((r for r in rows if r["kind"] == "word"), key=lambda r: r["number"])
    assert {r["word"]: r["n"] for r in words} == {"of": 2, "tokens": 1, "many": 1, "words": 1, "unheard": 0}
    assert all(r["data"] is None for r in words)
    (table,) = (r for r in rows if r["kind"] == "table")
    ids = lmscore.unpacked(table["data"])
    parts = np.split(ids[table["n"] :], np.cumsum(ids[: table["n"]])[:-1])
    assert [p.tolist() for p in parts] == [known.tokenizer.encode(" " + r["word"], add_special_tokens=False).ids for r in words]


@pytest.mark.parametrize("spread", [0.2, 4.0])
def test_gradient_is_that_of_the_plain_formulas(spread: float) -> None:
    """Against differences of the loss; with wide weights, powers leave single precision unless rows are shifted."""
    rng = np.random.default_rng(3)
    weights = attention.initial(np.full(attention.CLASSES, 1 / attention.CLASSES)) + rng.normal(0, spread, attention._ENDS[-1]).astype(np.float32)
    x, y = rng.integers(0, attention.CLASSES, (2, 3, attention.WINDOW))
    real = rng.random(y.shape) < 0.8
    room = attention._Room(3)
    attention.gradient(weights, y, x, real, room)  # what an earlier step left there does no harm

    def loss(w: np.ndarray) -> float:
        p = attention.views(w)
        logits = attention._outward(p, attention._attend(p, x)[-1])[-1]
        top = logits.max(axis=2)
        like = np.take_along_axis(logits, y[..., None], axis=2)[..., 0] - top - np.log(np.exp(logits - top[..., None]).sum(axis=2))
        return float(-like[real].mean())

    got, slope = attention.gradient(weights, x, y, real, room)
    assert np.isfinite(slope).all()
    if spread < 1:
        way = slope.astype(np.float64) / np.linalg.norm(slope)
        exact = weights.astype(np.float64)
        assert math.isclose(got, loss(exact), rel_tol=1e-4)
        assert math.isclose((loss(exact + 1e-4 * way) - loss(exact - 1e-4 * way)) / 2e-4, float(slope @ way), rel_tol=1e-2)


def test_each_token_is_scored_once_with_its_window() -> None:
    rng = np.random.default_rng(1)
    weights = attention.initial(np.full(attention.CLASSES, 1 / attention.CLASSES)) + rng.normal(0, 0.3, attention._ENDS[-1]).astype(np.float32)
    lengths = [1, 5, attention.WINDOW, attention.WINDOW + 1, 61, 200]
    classes, starts = rng.integers(0, attention.CLASSES, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    got = attention.score(weights, classes, starts, 7)
    p = attention.views(weights)
    for k, n in enumerate(lengths):
        own, total, scored = [7, *classes[starts[k] : starts[k + 1]].tolist()], 0.0, 0
        at = 0
        while scored < n:
            x = np.array([own[at : at + attention.WINDOW]])
            logits = attention._outward(p, attention._attend(p, x)[-1])[-1][0].astype(float)
            for j in range(scored - at, min(attention.WINDOW, n - at)):
                total += logits[j, own[at + j + 1]] - np.log(np.exp(logits[j]).sum())
                scored += 1
            at += attention.STEP
        assert math.isclose(got[k], total / math.log(10), rel_tol=1e-4)


def test_mix_meets_targets_with_whole_documents(spark: SparkSession) -> None:
    rows = mixing.mix(table(spark)).collect()
    by: dict[float, tuple[float, int]] = {}
    for r in rows:
        by[r["target"]] = (r["source_size"], by.get(r["target"], (0, 0))[1] + r["taken"])
        assert 0 <= r["taken"] <= 3 * r["size"]
    sources = {r["doc_id"]: r["source"] for r in table(spark).collect()}
    taken, targets = Counter(), {}
    for r in rows:
        taken[sources[r["doc_id"]]] += r["taken"]
        targets[sources[r["doc_id"]]] = r["target"]
    longest: Counter = Counter()
    for r in rows:
        longest[sources[r["doc_id"]]] = max(longest[sources[r["doc_id"]]], r["size"])
        assert r["taken"] == r["n_copies"] * r["size"]  # whole documents only
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 0.5 for s in targets)
    assert math.isclose(sum(targets.values()), sum(r["size"] for r in rows))
    copies = mixing.mixed_documents(table(spark)).collect()
    assert sum(len(cases.words(r["text"])) for r in copies) == sum(r["taken"] for r in rows)
    assert len(copies) == sum(r["n_copies"] for r in rows)
    texts = {r["doc_id"]: r["text"] for r in table(spark).collect()}
    assert all(r["text"] == texts[r["doc_id"]] for r in copies)


def test_sources_without_words(spark: SparkSession) -> None:
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", "b"), (4, " \n", None)]
    got = {r["doc_id"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i: (r["size"], r["target"], r["taken"], r["position"]) for i, r in got.items() if i != 3} == dict.fromkeys((1, 2, 4), (0, 0.0, 0, None))
    assert (got[3]["target"], got[3]["taken"]) == (2.0, 2)
    bare = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix(bare).collect()] == [0, 0] and mixing.mixed_documents(bare).collect() == []


def test_demand_is_inverted(spark: SparkSession) -> None:
    df = spark.createDataFrame([(float(p), s) for p in range(0, 101, 10) for s in mixing.STARTS], "p double, s double")
    from pyspark.sql import functions as F

    for p, s, t in df.select("p", "s", mixing.position(F.col("p"), F.lit(100.0), F.col("s"))).collect():
        assert math.isclose(100 * (s * t + (1 - s) * t * t), p, abs_tol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30) | st.text("ab'. \n\té \x1c1<|>", max_size=40), max_size=6))
def test_encoder_is_the_tokenizer(texts: list[str]) -> None:
    ids, starts = encode.encoder(encode.byte_bpe()).encode(pa.array(texts, pa.string()), 0)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)] == ids_of(texts, 0)


def test_strings_of_added_tokens_are_those_tokens() -> None:
    tokenizer = Tokenizer.from_file(encode.byte_bpe())  # as the file says, not as the encoder sets it
    end = "<|endoftext|>"
    texts = [end, f"a{end}b", f"one {end} two", f"{end}{end} x", f" {end}", "<|endoftext|", "<|ENDOFTEXT|>", "plain words", "", None]
    ids, starts = encode.encoder(encode.byte_bpe()).encode(pa.array(texts, pa.string()), 1)
    got = [ids[a:b].tolist() for a, b in zip(starts, starts[1:], strict=False)]
    assert got == [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert got[0] == [50256, 1] and got[2].count(50256) == 1


def test_added_tokens_in_files_and_pieces(spark: SparkSession) -> None:
    tokenizer = Tokenizer.from_file(encode.byte_bpe())
    texts = ["a b", "one <|endoftext|> two", "c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    files = {r["doc_id"]: r for r in bitpack.round_trip(docs).collect()}
    starts = [sum(len(x) + 1 for x in want[:i]) for i in range(3)]
    assert [(files[i]["start"], files[i]["n_tokens"], files[i]["ids_crc32"]) for i in range(3)] == [(a, len(x) + 1, crc(x + [0])) for a, x in zip(starts, want, strict=True)]
    check_packing(packing.pack(docs).collect(), [(i, x + [1]) for i, x in enumerate(want)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_bits_round_trip(bits: int, data: st.DataObject) -> None:
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=200)), "<u4")
    assert bitpack.unpack_bits(bitpack.pack_bits(ids, bits), bits, len(ids)).tolist() == ids.tolist()


def test_token_file_random_access(monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(bitpack, "BLOCK", 16)
    ids = np.random.default_rng(2).integers(0, 50_257, 100).astype("<u4")
    f = bitpack.TokenFile(bitpack.file_bytes([3, None, 9], np.array([10, 10, 100]), ids, 16, 1, 2))
    assert f.doc_ids == [3, None, 9] and (f.part, f.number, f.tokens) == (1, 2, 100)
    assert all(f.read(a, b).tolist() == ids[a:b].tolist() for a in range(0, 100, 7) for b in range(a, 101, 9))
    assert [len(f.document(i)) for i in range(3)] == [10, 0, 90]


def test_token_files(spark: SparkSession) -> None:
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark).collect())
    got = {r["doc_id"]: r for r in bitpack.round_trip(table(spark)).collect()}
    at = 0
    for (i, _), ids in zip(docs, ids_of([t for _, t in docs], 0), strict=True):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)


def test_languages_of_held_out_documents(spark: SparkSession) -> None:
    rows = {r["doc_id"]: r for r in langid.held_out_languages(table(spark)).collect()}
    docs = [(r["doc_id"], r["lang"]) for r in table(spark).collect()]
    held = [(rows[i]["lang_pred"], lang) for i, lang in docs if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in docs)
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def check_packing(rows: list, docs: list[tuple[int, list[int]]]) -> None:
    pieces: dict[int, list] = {}
    bins: dict[int, list] = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append(r)
    assert sorted(pieces) == [i for i, _ in docs]
    for i, ids in docs:
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.005 * sum(len(x) for _, x in docs)
    assert sorted(bins) == list(range(len(bins)))


def test_packing(spark: SparkSession) -> None:
    docs = sorted((r["doc_id"], r["text"]) for r in table(spark).collect())
    full = list(zip([i for i, _ in docs], ids_of([t for _, t in docs], 1), strict=True))
    pieces = packing.pack(table(spark).repartition(5))
    rows = pieces.collect()
    check_packing(rows, full)
    assert all(crc(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
    ids = packing.sequences(pieces).collect()
    assert all(len(r["ids"]) == 2048 or len(r["ids"]) & (len(r["ids"]) - 1) == 0 for r in ids)


def test_archives_of_large_and_equal_payloads(spark: SparkSession) -> None:
    big, twin = "é" * 400_000, "t" * 1000
    rows = [(1, "http://a\r\nX: y", big), (2, None, twin), (3, "u", twin), (4, "u", "s" * 999), (5, "u", "s" * 999), (6, "u", None), (None, "u", twin), (7, "u", "")]
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        revisit = html == twin and i != 3
        assert got[i] == (len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None)


def test_archives_are_read_by_a_task_each(spark: SparkSession, tmp_path: Path) -> None:
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(60)], "page_id long, url string, html string").repartition(6)
    manifest = warc.write_archives(pages, f"file://{tmp_path}/archives", "page_id", "url", "html")
    chunks = warc.chunk_table(manifest, f"file://{tmp_path}/archives")
    files = manifest.count()
    assert files > 1 and chunks.rdd.getNumPartitions() == files and chunks.select("page_id").distinct().count() == 60


def test_archive_is_read_in_chunks() -> None:
    payload = random.Random(1).randbytes(1_000_000)
    row = {"id": 5, "url": "http://x", "n_bytes": len(payload), "digest": hashlib.sha1(payload).hexdigest(), "refers_to": None}
    data = gzip.compress(warc.record_head(row) + payload + b"\r\n\r\n") * 2
    chunks = list(warc.archive_chunks(io.BytesIO(data)))
    assert [c["record"] for c in chunks] == [0] * 4 + [1] * 4 and max(len(c["data"]) for c in chunks) <= warc.CHUNK
    assert b"".join(c["data"] for c in chunks[:4]) == payload
    assert all(c["digest"] == hashlib.sha1(payload[: (k + 1) * warc.CHUNK]).hexdigest() for k, c in enumerate(chunks[:4]))
    with pytest.raises(ValueError):
        list(warc.archive_chunks(io.BytesIO(gzip.compress(warc.record_head(row) + payload[:-9]))))


OPERATORS = {
    "licenses": licenses.scan, "near": neardup.near_groups, "quality": quality.quality, "lm": lmscore.scores, "exact": exact.exact_groups, "mix": mixing.mix, "tokens": bitpack.round_trip,
    "languages": langid.held_out_languages, "packing": packing.pack, "keep_good": quality.keep_good, "drop_copies": exact.drop_copies, "keep_one": neardup.keep_one_of_each, "mixed": mixing.mixed_documents,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark: SparkSession, name: str) -> None:
    assert OPERATORS[name](cases.empty(spark)).collect() == []


def test_empty_archives(spark: SparkSession) -> None:
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


@pytest.mark.parametrize("name", ["licenses", "near", "quality", "lm", "exact", "mix", "tokens", "languages"])
def test_a_row_for_each_awkward_row(spark: SparkSession, name: str) -> None:
    docs = cases.awkward(spark)
    got = Counter(r["doc_id"] for r in OPERATORS[name](docs).collect())
    assert got == Counter(r["doc_id"] for r in docs.collect())


def test_awkward_rows(spark: SparkSession) -> None:
    docs = cases.awkward(spark)
    found = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert found[10]["base_labels"] == "apache,cc-by" and found[10]["labels"] == "apache,apache-2.0,cc-by" and found[1]["n_words"] == 0 and found[1]["score"] == 0
    assert Counter(r["doc_id"] for r in licenses.scan(docs).collect()) == Counter(r["doc_id"] for r in docs.collect())
    groups = exact.exact_groups(docs).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in groups if r["keep_id"] == 5) == [(0, False), (4, False), (4, False), (5, True)]
    assert sum(r["kept"] for r in groups) == len({r["text"] or "" for r in docs.collect()})
    kept = exact.drop_copies(docs).collect()
    assert Counter((r["doc_id"], r["text"] or "") for r in kept) == Counter({(r["keep_id"], t) for r in groups for t in [next(d["text"] or "" for d in docs.collect() if d["doc_id"] == r["keep_id"] and hashlib.sha256((d["text"] or "").encode()).hexdigest() == r["text_sha256"])]})
    near = {r["doc_id"]: r for r in neardup.near_groups(docs).collect() if r["doc_id"] is not None}
    assert near[4]["component_id"] == near[5]["component_id"] == near[8]["component_id"] == 4 and near[1]["component_id"] == 1 and near[2]["n_shingles"] == 0
    assert next(r for r in neardup.near_groups(docs).collect() if r["doc_id"] is None and r["n_shingles"])["component_id"] == 4
    languages = {r["doc_id"]: r["lang_pred"] for r in langid.held_out_languages(docs).collect()}
    assert languages[1] == languages[3] == languages[12] == "und" and languages[7] == "en"
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}[1] == 0
    for name in ("keep_good", "drop_copies", "keep_one", "mixed"):
        assert OPERATORS[name](docs).columns == docs.columns
    assert sum(len(r["ids"]) for r in packing.pack(docs).collect()) == sum(map(len, ids_of([r["text"] for r in docs.collect()], 1)))


@pytest.mark.parametrize("docs", [cases.awkward, cases.empty])
def test_pipeline_of_awkward_tables(spark: SparkSession, docs: Callable[[SparkSession], DataFrame]) -> None:
    """Texts of fewer words than the rules ask for go; of the others one of each group is packed whole."""
    rows = [r for r in docs(spark).collect()]
    got = corpus_pipeline.apply(spark, docs(spark), FOLDER).collect()
    kept = {r["doc_id"] for r in quality.quality(docs(spark)).collect() if r["kept"]}
    assert {r["doc_id"] for r in got} <= kept and (6 in {r["doc_id"] for r in got}) == bool(rows)
    assert len({r["doc_id"] for r in got} & {4, 5, None, 8}) == (1 if rows else 0)


def test_pipeline_stage_by_stage(spark: SparkSession) -> None:
    """Every stage against a plain version, on what its predecessor kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark)
    verdict = {r["doc_id"]: r["kept"] for r in quality.quality(docs).collect()}
    good = stages["quality rules"](spark, docs, FOLDER).cache()
    assert {r["doc_id"] for r in good.collect()} == {i for i, kept in verdict.items() if kept}
    single = stages["exact dedup"](spark, good, FOLDER).cache()
    best: dict[str, int] = {}
    for r in good.collect():
        best[r["text"]] = max(best.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"]: r["text"] for r in single.collect()} == {i: t for t, i in best.items()}
    apart = stages["near dedup"](spark, single, FOLDER).cache()
    assert {r["doc_id"] for r in apart.collect()} == set(cases.near_components([(r["doc_id"], r["text"]) for r in single.collect()]).values())
    mix = stages["source mix"](spark, apart, FOLDER).cache()
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(apart).collect()}
    got: Counter = Counter()
    for r in mix.collect():
        got[r["doc_id"]] += len(cases.words(r["text"]))
    assert got == Counter({i: n for i, n in taken.items() if n})
    assert docs.columns == good.columns == single.columns == apart.columns == mix.columns
    rows = stages["packing"](spark, mix, FOLDER).collect()
    texts = [(r["doc_id"], len(x)) for r, x in zip(mix.collect(), ids_of([r["text"] for r in mix.collect()], 1), strict=True)]
    assert Counter({i: sum(n for j, n in texts if j == i) for i, _ in texts}) == Counter({i: sum(r["length"] for r in rows if r["doc_id"] == i) for i, _ in texts})
    assert len(rows) == corpus_pipeline.run(spark, FOLDER).count()
