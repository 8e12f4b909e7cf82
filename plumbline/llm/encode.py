"""Texts to token ids with a public tokenizer file, batch by batch.

Tokenizers split a text at blanks before anything else, and in prose most words come again. So a batch is cut into
words, each distinct word is encoded once by the tokenizer, new words many at a time, and the ids are put together with
array operations. Texts
in which a blank follows a blank, where the cut would not be the tokenizer's, and texts that hold the string of an added
token, which the tokenizer takes out before it splits, are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode white space, as regular expressions of the tokenizer take it.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Words whose ids a worker remembers, bytes of text encoded at once, and new words encoded as one text.
REMEMBERED, AT_ONCE, TOGETHER = 600_000, 8_000_000, 2000
#: Byte-level models write a byte that is no visible ASCII character as a letter from 256 on, in the order of bytes.
_LETTERS = {b: 256 + i for i, b in enumerate([*range(33), 127])}
_CONTROLS = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """One tokenizer of a worker and the ids of the words it has met."""

    def __init__(self, path: str, remembered: int) -> None:
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side already
        self.tokenizer = Tokenizer.from_file(path)
        self._added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        added = [regex.escape(a, special_only=True) for a in self._added]
        self._odd = "|".join([f"^ |[{SPACE}] ", *added])
        self.size = self.tokenizer.get_vocab_size()
        self._split, self._model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self._parts = regex.compile(public_tokenizers.PATTERN).findall
        blank = chr(_LETTERS[32])
        vocabulary = self.tokenizer.get_vocab()
        self._begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self._begins[[i for token, i in vocabulary.items() if token.startswith(blank)]] = True
        self._known: dict[str, bytes] = {}
        self._remembered = remembered

    def word(self, word: str) -> bytes:
        found = self._known.get(word)
        if found is None:
            if word.isascii() and not _CONTROLS.search(word):
                # Words of ASCII are split by the tokenizer's own pattern; the model takes bytes as letters.
                parts = [part.translate(_LETTERS) for part in self._parts(word)]
            else:
                parts = [part for part, _ in self._split(word)]
            found = array("I", [t.id for part in parts for t in self._model(part)]).tobytes()
            if len(self._known) < self._remembered:
                self._known[word] = found
        return found

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words that hold no blank, each after a blank."""
        words = [" " + w for w in words]
        found = [self._known.get(w) for w in words]
        new = [w for w, ids in zip(words, found, strict=True) if ids is None]
        made = iter([ids for i in range(0, len(new), TOGETHER) for ids in self._together(new[i : i + TOGETHER])])
        return [next(made) if ids is None else ids for ids in found]

    def _together(self, words: list[str]) -> list[bytes]:
        """The ids of new words, encoded as one text: it is cut at its blanks, and a token with a blank begins a word.

        Where the cuts would be others (white space before a blank, added tokens) the words are encoded one by one.
        """
        text = "".join(words)
        if any(w[-1].isspace() for w in words) or any(a in text for a in self._added):
            plain = [w for w in words if not w[-1].isspace() and not any(a in w for a in self._added)]
            made = dict(zip(plain, self._together(plain), strict=True)) if plain and not any(" " in a for a in self._added) else {}
            return [made[w] if w in made else self.word(w) for w in words]
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self._begins[ids]).tolist()
        if len(cuts) != len(words) or cuts[0]:
            return [self.word(w) for w in words]
        data = ids.tobytes()
        made = [data[4 * a : 4 * b] for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True)]
        self._known.update(zip(words[: max(0, self._remembered - len(self._known))], made, strict=False))
        return made

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids start (one more number than texts)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, self._odd).to_numpy(zero_copy_only=False)
        if odd.any():
            return self._mixed(texts, odd, end)
        words = pc.split_pattern(texts, " ")
        ends = words.offsets.to_numpy().astype(np.int64)
        coded = words.values.dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        distinct = coded.dictionary.to_pylist()
        heads = code[ends[:-1]]
        firsts, head_code = np.unique(heads, return_inverse=True)
        code[ends[:-1]] = len(distinct) + head_code
        known = self.words(distinct) + [self.word(distinct[i]) for i in firsts]
        if end is not None:
            known.append(np.array([end], "<u4").tobytes())
            code = np.insert(code, ends[1:], len(known) - 1)
            ends = ends + np.arange(len(ends))
        table = np.frombuffer(b"".join(known), "<u4")
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begins = np.cumsum(lengths) - lengths
        counts = lengths[code]
        upto = np.concatenate([[0], np.cumsum(counts)])
        where = np.repeat(begins[code] - upto[:-1], counts)
        where += np.arange(len(where))
        return table[where], upto[ends]

    def _mixed(self, texts: pa.Array, odd: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        rows: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        even = np.flatnonzero(~odd)
        if len(even):
            ids, starts = self.encode(texts.take(pa.array(even)), end)
            for k, i in enumerate(even):
                rows[i] = ids[starts[k] : starts[k + 1]]
        last = [] if end is None else [end]
        for i in np.flatnonzero(odd):
            rows[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids + last, "<u4")
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


@cache
def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    return Encoder(path, remembered)


def portions(batches: Iterator[pa.RecordBatch], text: str = "text", at_once: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows of a partition again, in portions of about ``at_once`` bytes of text (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin = 0
        for i, n in enumerate(lengths):
            size += int(n)
            if size >= at_once:
                held.append(batch.slice(begin, i + 1 - begin))
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, begin = [], 0, i + 1
        if begin < batch.num_rows:
            held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
