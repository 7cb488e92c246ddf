"""Words of Latin letters get the library's ids from its model alone, in any case and beside any marks."""

import random

import numpy as np
import pytest

from strandframe.llm import tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_by_the_model_are_those_of_whole_texts(name, monkeypatch):
    rng = random.Random(5)
    codes, seen = tokens.Encoder(tokens.vocabulary(name)), []
    whole = tokens.Encoder._encode
    monkeypatch.setattr(tokens.Encoder, "_encode", lambda self, keys: (seen.extend(keys), whole(self, keys))[1])
    letters = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), 0xAA, 0xB5, 0xBA, *range(0xC0, 0x130)) if c not in (0xD7, 0xF7)]
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]

    def word():
        body = "".join(rng.choices(letters[:52] if rng.random() < 0.6 else letters, k=rng.randint(1, 12)))
        return body + "".join(rng.choices(marks, k=rng.choice([0, 0, 0, 1, 1, 2, 3, 4])))

    odd = ["İstanbul", "ΟΔΟΣ", "it's", "ét", "don't.", "a1b2", "x<|endoftext|>", "語", "Ångström", "ﬁn", "-", "ſ", "a" * 70]
    texts = ["".join([rng.choice(odd) if rng.random() < 0.15 else word(), *(rng.choice("  \n") + (rng.choice(odd) if rng.random() < 0.15 else word()) for _ in range(30))]) for _ in range(400)]
    texts += ["Foo foo\nfoo Foo, foo! FOO", "  Foo\tfoo\r\nFoo ", "", *letters]
    for start in range(0, len(texts), 50):
        part = texts[start : start + 50]
        expected = [np.asarray(codes.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]
        assert codes.batch(part) == expected
        assert codes.batch(part) == expected
    assert seen and not any(k.isalpha() and max(k) < "İ" for k in seen)
