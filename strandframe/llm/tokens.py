"""Token ids of whole texts by a public vocabulary, through the tokenizers library.

Both vocabularies split a text at white space before any merge, so a text is the sequence of its
pieces "white space, then a word", each encoded on its own. Pieces recur, so each worker keeps the
ids of those it has met, up to a fixed number; the library encodes every other piece. They are kept from
task to task, and given up once the worker has had no such task for a moment or begins another operator.

A word of Latin letters is one string to the library's model in both vocabularies, so it goes to the model
straight, without normaliser and splitter. All other pieces take the whole way.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_PIECES = 700_000
IDLE_SECONDS = 1.0
CACHED_CHARS = 64
KEPT_MARKS = 10_000
# White space as Unicode defines it, which the vocabularies' own patterns use.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
# A piece of letters that normalise to themselves, but for their case, and that every Unicode version calls
# letters; a line break or the start of its text before it, up to four marks after it but no apostrophe.
WORD = re.compile("([\r\n]?)([A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f]+)([!-&(-/:-@[-`{-~]{0,4})")
# What else ``str.split`` takes for white space; looking for a character is far quicker than a split.
NOT_PLAIN = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]


def _byte_symbols() -> dict[int, int]:
    """The symbols that stand for bytes in byte-level vocabularies: printing ones for themselves."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTE_SYMBOLS = _byte_symbols()


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """batch(texts): each text's ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        # The vocabulary with a normaliser folds case and takes no white space into its ids.
        self.folds = self.tokenizer.normalizer is not None
        self.bytes = [i.to_bytes(4, "little") for i in range(self.size)]
        self.marks = {"": b"", "\n": self._library(["\n"])[0]}
        # Keys: a word (stands for a space and the word), a line break and a word, or "\r" and any piece.
        self.known: dict[str, bytes] = {}

    def batch(self, texts: list[str]) -> list[bytes]:
        plain = [i for i, t in enumerate(texts) if t and _is_plain(t)]
        odd = [i for i in sorted({*range(len(texts))}.difference(plain)) if texts[i]]
        # Arrow splits the texts, numbers their keys and puts the ids of the keys in their places.
        words = pc.split_pattern(pa.array(["\r" + texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
        pieces = [["\r" + piece for piece in PIECES.findall(texts[i])] for i in odd]
        flat = pa.concat_arrays([words.flatten(), pa.array([k for keys in pieces for k in keys], pa.large_string())]).dictionary_encode()
        keys = flat.dictionary.to_pylist()
        known = self.known
        here = [known.get(k) for k in keys]
        new = [i for i, ids in enumerate(here) if ids is None]
        met = len(known)
        other = self._words([keys[i] for i in new])
        known.update(zip(other, self._encode(other), strict=True))
        for i in new:
            here[i] = known[keys[i]]
        placed = pa.array(here, pa.large_binary()).take(flat.indices)
        ends = np.cumsum([0, *pc.list_value_length(words).to_pylist(), *map(len, pieces)])
        cuts = np.frombuffer(placed.buffers()[1], "i8", len(placed) + 1)[ends].tolist() if len(placed) else [0]
        data = memoryview(placed.buffers()[2] or b"")
        found = [b""] * len(texts)
        for i, start, stop in zip(plain + odd, cuts, cuts[1:], strict=False):
            found[i] = bytes(data[start:stop])
        if len(known) > CACHED_PIECES or any(len(keys[i]) > CACHED_CHARS for i in new):
            added = list(islice(known, met, None))
            free = max(0, CACHED_PIECES - met)
            for number, key in enumerate(added):
                if number >= free or len(key) > CACHED_CHARS:
                    del known[key]
        return found

    def _words(self, new: list[str]) -> list[str]:
        """Keeps the ids of the keys that are words of Latin letters, and returns the others."""
        known, marks, folds, other = self.known, self.marks, self.folds, []
        for key in new:
            if (found := WORD.fullmatch(key)) is None:
                other.append(key)
                continue
            lead, word, mark = found.groups()
            if folds:
                lead, bare = "", word.lower()
            else:
                bare = "\r" + word if lead else word
            if (ids := known.get(bare)) is None:
                ids = known[bare] = self._word(bare)
            if bare != key:  # the marks are encoded apart by both vocabularies, and so is the line break
                if (after := marks.get(mark)) is None:
                    after = self._library([mark])[0]
                    if len(marks) < KEPT_MARKS:
                        marks[mark] = after
                known[key] = marks["\n" if lead == "\n" else ""] + ids + after
        return other

    def _word(self, bare: str) -> bytes:
        """Ids of a key that is a word of Latin letters, by the model."""
        word = bare[1:] if bare[0] == "\r" else bare if self.folds else " " + bare
        if not word.isascii() or word[0] == " ":
            word = word.encode().decode("latin-1").translate(BYTE_SYMBOLS)
        return b"".join([self.bytes[t.id] for t in self.model.tokenize(word)])

    def _library(self, pieces: list[str]) -> list[bytes]:
        return [np.asarray(c.ids, "<u4").tobytes() for c in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _encode(self, keys: list[str]) -> list[bytes]:
        """The pieces joined in chunks, then told apart by where tokens start."""
        codes: list[bytes] = []
        pieces = [k[1:] if k[0] == "\r" else k if k[0] == "\n" else " " + k for k in keys]
        plain = [i for i, k in enumerate(keys) if k[0] != "\r"]
        codes = [b""] * len(keys)
        for start in range(0, len(plain), 2000):
            part = plain[start : start + 2000]
            text = "".join(pieces[i] for i in part)
            code = self.tokenizer.encode(text, add_special_tokens=False)
            ends = np.cumsum([len(pieces[i]) for i in part])
            begins = np.fromiter((o[0] for o in code.offsets), "i8", len(code.offsets))
            cuts = [0, *(4 * np.searchsorted(begins, ends)).tolist()]
            data = np.asarray(code.ids, "<u4").tobytes()
            for i, a, b in zip(part, cuts, cuts[1:], strict=False):
                codes[i] = data[a:b]
        odd = [i for i, k in enumerate(keys) if k[0] == "\r"]
        for i, code in zip(odd, self._library([pieces[i] for i in odd]), strict=True):
            codes[i] = code
        return codes


def _is_plain(text: str) -> bool:
    """Whether a text that is not empty is words with single spaces or line breaks between them."""
    even = text.replace("\n", " ")
    return "  " not in even and even[0] != " " and even[-1] != " " and not any(c in text for c in NOT_PLAIN)


def encoded(texts, codes: Encoder, chars: int = 1 << 20):
    """ids of each text in order, encoded in groups of about ``chars`` characters."""
    group, held = [], 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= chars:
            yield from codes.batch(group)
            group, held = [], 0
    yield from codes.batch(group)


_encoders: dict[str, Encoder] = {}


_idle: list[threading.Timer] = []


@contextmanager
def encoder(path: str) -> Iterator[Encoder]:
    """One encoder per worker process and vocabulary."""
    while _idle:
        _idle.pop().cancel()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    try:
        yield _encoders[path]
    finally:
        timer = threading.Timer(IDLE_SECONDS, forget_pieces)
        timer.daemon = True
        timer.start()
        _idle.append(timer)


def forget_pieces() -> None:
    """Gives up the ids that this worker has kept, and their memory."""
    _encoders.clear()
    gc.collect()
    with suppress(OSError, AttributeError):  # other C libraries return freed memory by themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)
