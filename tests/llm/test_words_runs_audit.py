"""Words to ids and back, periodic runs and the filter audit against plain versions, with odd rows and columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandframe.llm import filter_audit, periodic_runs, word_bpe
from strandframe.llm.common import table
from strandframe.llm.tokens import vocabulary

VOCABULARY = vocabulary("byte_bpe_50k.json")
ODD = [
    None, "", " ", "\n\n", "one", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>c  <|endoftext|>", " a  b\t\tc 　 d e", "it's  'S we'll\x85x",
    "\x00\x1c\x1f\x7f​﻿", "žluťoučký 数学 🙂🙂 \U0010ffff", "word " * 5000, "x" * 30000, "a b " * 4000, "\r\n".join("abc"), "1 2  3   4    ",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_rows(spark, texts=ODD):
    rows = [(i, t, i, "w", 1) for i, t in enumerate(texts)] + [(3, "one", 0, "w", 1), (3, "one", 0, "w", 1), (None, "two  words", 0, "w", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, block int, word string, ids int"), [r[:2] for r in rows]


def plain_codes(texts):
    from tokenizers import Tokenizer

    codes = [Tokenizer.from_file(VOCABULARY)] * len(texts)
    return [code.encode(text or "", add_special_tokens=False).ids for code, text in zip(codes, texts, strict=True)]


def test_ids_equal_the_library_for_odd_texts(spark):
    frame, rows = odd_rows(spark)
    for text_bytes in (word_bpe.RANGE_BYTES, 1000):
        found = word_bpe.encode_documents(frame.repartition(3), VOCABULARY, range_bytes=text_bytes).collect()
        expected = [(key, tuple(ids), text or "") for (key, text), ids in zip(rows, plain_codes([t for _, t in rows]), strict=True)]
        assert sorted(((r.doc_id, tuple(r.ids), r.text) for r in found), key=repr) == sorted(expected, key=repr)
    assert word_bpe.encode_documents(frame.limit(0), VOCABULARY).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sSt<|endoftext|> \xa01")), max_size=60))
def test_words_are_encoded_apart(text):
    words = word_bpe.PIECES.findall(text)
    assert "".join(words) == text
    assert list(itertools.chain.from_iterable(plain_words(w) for w in words)) == plain_words(text)


def plain_words(text):
    return word_bpe.library(VOCABULARY).encode(text, add_special_tokens=False).ids


def test_pieces_and_decoding_equal_the_library(spark):
    tokenizer = word_bpe.library(VOCABULARY)
    rng = random.Random(3)
    rows = [(i, [rng.randrange(50257) for _ in range(rng.randrange(1, 30))]) for i in range(200)] + [(200, [50256, 0, 50256]), (201, [99999, 1]), (202, [])]
    frame = spark.createDataFrame(rows, "n int, ids array<int>")
    found = {r.n: bytes(r.bytes).decode("utf-8", "replace") for r in word_bpe.decode_ids(frame, "n", VOCABULARY).collect()}
    assert found == {n: tokenizer.decode(ids, skip_special_tokens=False) for n, ids in rows if ids}
    assert word_bpe.pieces(spark, VOCABULARY).count() == tokenizer.get_vocab_size()


def test_other_vocabularies_are_refused(spark):
    with pytest.raises(ValueError, match="byte-level"):
        word_bpe.encode_documents(odd_rows(spark)[0], vocabulary("word_bpe_49k.json"))


def test_op11_equals_the_library(spark, folder):
    tokenizer = word_bpe.library(VOCABULARY)
    rows = [(r.doc_id, r.text or "") for r in table(spark, folder, "documents").collect()]
    expected = []
    for key, text in rows:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        expected.append((key, len(ids), sha(",".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, word_bpe.query(spark, folder).collect())) == sorted(expected)


def plain_runs(words, min_length=24, min_exponent=3):
    found = []
    for period in range(1, len(words) // min_exponent + 1):
        start = 0
        while start + period < len(words):
            stop = start
            while stop + period < len(words) and words[stop] == words[stop + period]:
                stop += 1
            length = stop + period - start
            run = words[start : start + length]
            if stop > start and length >= max(min_length, min_exponent * period) and not any(run[p:] == run[:-p] for p in range(1, period)):
                found.append((start, length, period))
            start = stop + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_digest(key, words):
    runs = plain_runs(words)
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    lines = "".join(f"{a},{n},{p}\n" for a, n, p in runs)
    return (key, len(runs), *best, milli, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def plain_planted(key, words):
    h, n = zlib.crc32(str(key).encode()), len(words)
    if key is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), st.integers(1, 9)), max_size=5), max_size=4), st.sampled_from([(24, 3), (6, 2), (5, 2), (9, 3), (24, 2), (8, 5)]))
def test_runs_equal_brute_force(documents, limits):
    documents = [[w.encode() for base, times in parts for w in base * times] for parts in documents]
    found = periodic_runs.runs_of(periodic_runs.symbols_of(documents), np.cumsum([0, *map(len, documents)]), *limits)
    assert found == [plain_runs(d, *limits) for d in documents]


def test_runs_of_odd_rows(spark):
    frame, rows = odd_rows(spark)
    frame = frame.withColumnRenamed("word", "runs").withColumnRenamed("block", "id")
    found = periodic_runs.find_runs(frame).collect()
    expected = []
    for key, text in rows:
        runs = plain_runs(split(text)) if len(split(text)) < 4000 else None
        if text == "word " * 5000:
            runs = [(0, 5000, 1)]
        if text == "a b " * 4000:
            runs = [(0, 8000, 2)]
        expected.append((key, tuple(runs), {5000: "word", 8000: "a b"}.get(len(split(text)), " ".join(split(text)))))
    assert sorted(((r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in found), key=repr) == sorted(expected, key=repr)
    assert periodic_runs.find_runs(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(frame, min_exponent=1)


def test_planted_runs_and_query_equal_plain_versions(spark, folder):
    odd, rows = odd_rows(spark)
    texts = {repr((r.doc_id, r.text)) for r in periodic_runs.planted(odd.select("doc_id", "text")).collect()}
    words = [(k, t, plain_planted(k, split(t))) for k, t in rows]
    assert texts == {repr((k, t if w == split(t) and zlib.crc32(str(k).encode()) % 10 else t if not w or k is None else " ".join(w))) for k, t, w in words}
    rows = table(spark, folder, "documents").select("doc_id", "text").collect()
    short = [r for r in rows if len(split(r.text)) < 3000]
    expected = {r.doc_id: plain_digest(r.doc_id, plain_planted(r.doc_id, split(r.text))) for r in short}
    found = {r.doc_id: tuple(r) for r in periodic_runs.query(spark, folder).collect()}
    assert len(found) == len(rows) and {k: found[k] for k in expected} == expected
    assert sum(r[1] for r in found.values()) > 5


def plain_audit(docs, labels):
    judged = []
    for key, text, part in docs:
        text = text or ""
        words = split(text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in docs),
        }
        mine = [r for r in labels if r[0] == key and key is not None]
        judged.append((part or "", {f for f, bad in fails.items() if bad}, any(r[1] == 1 for r in mine), any(r[2] == 1 for r in mine)))
    rows, shares = [], {}
    for part in {j[0] for j in judged}:
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [j for j in judged if j[0] == part]
                removed = [j for j in here if letter in j[1] and not j[1] & before]
                rows.append((part, "".join(order), step, sum(not j[1] & (before | {letter}) for j in here), len(removed), sum(letter in j[1] and bool(j[1] & before) for j in here), sum(j[1] == {letter} for j in here), sum(j[2] for j in removed), sum(j[3] for j in removed)))
                shares[part, letter] = shares.get((part, letter), 0) + len(removed)
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in rows)


def test_audit_of_odd_rows_equals_every_order(spark):
    rng = random.Random(8)
    texts = [None, "", "A B C", "a " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)) + " #", "same | text", "é" * 99 + "AAAAAA"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "t", None, ""])) for _ in range(120)]
    docs += [(7, "same | text", "s"), (7, "same | text", "s"), (6, "same | text", "t")]
    labels = [(rng.choice([None, *range(30)]), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(40)]
    frame = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], "doc_id long, text string, source string, mask int, key int, prefix string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit_documents(frame, marks).select("part", "filter_order", "step", *filter_audit.COUNTS, "shapley")
    assert sorted(map(tuple, found.collect())) == plain_audit(docs, labels)
    assert filter_audit.audit_documents(frame.limit(0), marks).count() == 0
    assert filter_audit.audit_documents(frame, marks.limit(0)).filter("good_lost + toxic_lost > 0").count() == 0
