"""Words encoded together have the ids that they have one by one."""

from __future__ import annotations

import random

from plumbline.llm.encode import Encoder, byte_bpe


def test_words_together_equal_words_alone() -> None:
    rng = random.Random(1)
    bits = ["a", "\n", "é", "\xa0", "<|endoftext|>", "1", "'s", "\t", "\x1f", "", "中", "<|end", "oftext|>", "_", "!?", "\x85", "the"]
    alone, together = Encoder(byte_bpe(), 10**6), Encoder(byte_bpe(), 50)
    for _ in range(100):
        words = list({"".join(rng.choices(bits, k=rng.randint(0, 4))) for _ in range(30)})
        assert together.words(words) == [alone.word(" " + w) for w in words]
