"""Texts of words with single spaces and line breaks are told from others without being split."""

import random

from strandframe.llm import tokens


def test_plain_texts_are_those_that_split_alike():
    rng = random.Random(2)
    parts = ["a", "é", "語", " ", "\n", " a", "\na", "\t", "\x1c", "\x85", "\xa0", " ", "　"]
    texts = ["".join(rng.choices(parts, [6, 2, 1, 2, 1, 8, 4] + [0.2] * 6, k=rng.randint(1, 9))) for _ in range(20_000)]
    found = [tokens._is_plain(t) for t in texts]
    assert found == [t.replace("\n", " ").split(" ") == t.split() for t in texts]
    assert 1000 < sum(found) < 19_000
