"""Vectors, repeats, near copies and toxicity against plain versions, with odd rows and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.llm import dart_minhash, multi_index, recompress, suffix_array, toxicity
from strandframe.llm.common import components, written

SPANS = "aggregate(spans, 0L, (n, s) -> n + (s[1] - s[0]))"


def test_components_of_stars_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_links(rows, cosine):
    unit = {}
    for n, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            unit[n] = np.asarray(v, "f8") / np.linalg.norm(np.asarray(v, "f8"))
    links = {n: [m for m in unit if m != n and len(unit[m]) == len(unit[n]) and unit[n] @ unit[m] >= cosine] for n in unit}
    out = []
    for n, (key, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out.append((key, len(links.get(n, [])), min(rows[m][0] for m in seen)))
    return sorted(out)


@pytest.mark.parametrize("chunk", [4096, 9])
def test_vectors_equal_brute_force(spark, chunk):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    vectors = [(b + rng.normal(size=16) * s).tolist() for b in base for s in (0, 0.05, 0.1, 0.1, 0.2, 0.25)]
    vectors += [vectors[0], [2 * x for x in vectors[1]], None, [], [0.0] * 16, [None, *[1.0] * 15], [float("nan"), *[1.0] * 15], [float("inf")] * 16, [1.0, 2.0], [1.0, 2.01]]
    rows = [(100 - i, v) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, links int")
    found = multi_index.link_vectors(frame, chunk=chunk).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == plain_links(rows, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_vector_recall_and_empty_table(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(200, 16))
    rows = [(i, (base[i % 200] + rng.normal(size=16) * 0.03).tolist()) for i in range(600)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sum(r.n_links for r in multi_index.link_vectors(frame, recall=0.95).collect())
    assert found >= 0.9 * sum(n for _, n, _ in plain_links(rows, 0.95)) > 0
    assert multi_index.link_vectors(frame.limit(0)).count() == 0


def texts_with_repeats(words, seed):
    rng = random.Random(seed)
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [make(rng.randint(10, 80)) for _ in range(8)]
    docs = [(i, "\n".join(rng.choice(base)[rng.randint(0, 20) :] if rng.random() < 0.6 else make(rng.randint(1, 20)) for _ in range(rng.randint(0, 5)))) for i in range(60)]
    docs.insert(0, (-1, "a " * 60 + make(30)))  # a long run where a batch begins
    return docs + [(90, None), (91, ""), (92, "a " * 400), (93, "a b " * 90), (94, docs[3][1]), (94, docs[3][1]), (None, docs[5][1])]


def with_clash(spark, docs):
    return spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, kept string, shard int").coalesce(1)


@pytest.mark.parametrize("contexts", [8192, 4])
def test_byte_repeats_equal_brute_force(spark, contexts):
    docs, length = texts_with_repeats(["a", "b", "é", "cc"], 1), 40
    seen = defaultdict(int)
    data = [(d, (t or "").encode()) for d, t in docs]
    for _, b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    expected = []
    for d, b in data:
        covered = np.zeros(len(b) + 1, "i1")
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = 1
        kept = bytes(x for x, c in zip(b, covered, strict=False) if not c)
        expected.append((d, len(b), int(covered.sum()), int((np.diff(covered, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    found = suffix_array.remove_repeats(with_clash(spark, docs), length, 16, contexts)
    assert sorted(map(tuple, found.selectExpr("doc_id", "n_bytes", SPANS, "size(spans)", "sha2(kept, 256)").collect()), key=str) == sorted(expected, key=str)


def test_suffix_array_and_common_prefixes():
    texts = [b"banana", b"", b"anana", b"b"]
    data, bounds = np.frombuffer(b"".join(texts), "u1"), np.cumsum([0, *map(len, texts)])
    suffix = {i: t[i - s :] for t, s in zip(texts, bounds, strict=False) for i in range(s, s + len(t))}
    order = suffix_array.suffix_order(data, bounds)
    assert order.tolist() == sorted(suffix, key=lambda i: (suffix[i], i))
    expected = [0] + [next((n for n, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), min(len(suffix[a]), len(suffix[b]))) for a, b in zip(order, order[1:], strict=False)]
    assert suffix_array.common_prefixes(data, bounds, order).tolist() == expected


@pytest.mark.parametrize(("window", "hot"), [(20, 50_000), (8, 10)])
def test_word_repeats_equal_brute_force(spark, window, hot):
    docs = texts_with_repeats(["a", "b", "dé", "E\x0b", "f\xa0g"], 2)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first, expected = {}, []
    for n in sorted(range(len(docs)), key=lambda n: (docs[n][0] is not None, docs[n][0] or 0, n)):
        for p in range(len(split[n]) - window + 1):
            first.setdefault(tuple(split[n][p : p + window]), (n, p))
    for n, (d, _) in enumerate(docs):
        covered = [False] * len(split[n])
        for p in range(len(split[n]) - window + 1):
            if first[tuple(split[n][p : p + window])] != (n, p):
                covered[p : p + window] = [True] * window
        kept = " ".join(w for w, c in zip(split[n], covered, strict=True) if not c)
        expected.append((d, len(split[n]), sum(covered), hashlib.sha256(kept.encode()).hexdigest()))
    found = recompress.remove_repeats(with_clash(spark, docs), window, hot_rows=hot)
    assert sorted(map(tuple, found.selectExpr("doc_id", "n_words", SPANS, "sha2(kept, 256)").collect()), key=str) == sorted(expected, key=str)


def test_cutting_keeps_other_columns_and_clean_texts(spark):
    docs = [(1, "x  y\n" + " ".join(map(str, range(30)))), (2, " ".join(map(str, range(30))) + " tail"), (3, None)]
    frame = with_clash(spark, docs)
    rows = {r.doc_id: r for r in recompress.cut_repeats(frame).collect()}
    assert recompress.cut_repeats(frame).columns == frame.columns
    assert (rows[1].text, rows[2].text, rows[3].text) == (docs[0][1], "tail", None)
    assert recompress.cut_repeats(frame.limit(0)).count() == 0
    assert suffix_array.remove_repeats(frame.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2000, 3])
def test_near_copies_equal_brute_force(spark, block):
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(40, 200))] for _ in range(10)]
    docs = []
    for i in range(90):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
        docs.append((i, " ".join(words)))
    docs += [(90, None), (91, ""), (92, "one two"), (93, "one  two"), (94, "one two three"), (95, "a " * 300), (96, "a " * 200), (96, "a " * 200), (None, docs[0][1])]
    sets = []
    for _, t in docs:
        w = (t or "").split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(docs)))
    rank = lambda n: (docs[n][0] is not None, docs[n][0] or 0, n)
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old = group[a]
                group = [group[b] if g == old else g for g in group]
    expected = sorted(((docs[n][0], docs[min((m for m in range(len(docs)) if group[m] == group[n]), key=rank)][0]) for n in range(len(docs))), key=str)
    frame = with_clash(spark, docs)
    found = dart_minhash.near_duplicates(frame, block=block).collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == expected
    assert sum(r.kept for r in found) == len(set(group))


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(8)
    shingle, n = rng.integers(0, 1 << 62, 400, dtype="u8"), 512
    a, b = rng.integers(1, 5, 400).astype("f8"), rng.integers(1, 5, 400) - 0.5
    signature = dart_minhash.signatures(np.concatenate([shingle, shingle]), np.concatenate([a, b]), np.repeat([0, 1], 400), 2, n)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((signature[0] == signature[1]).mean() - truth) < 4 * np.sqrt(truth * (1 - truth) / n)


def test_dropping_near_copies_keeps_rows_as_they_are(spark):
    docs = [(2, "p q r s t u v"), (1, "p q r s t  u v"), (3, None), (4, None)]
    frame = with_clash(spark, docs)
    kept = dart_minhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, docs[1][1]), (3, None), (4, None)]
    assert dart_minhash.drop_near_duplicates(frame.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(900):
        words = [f"w{int(rng.paretovariate(0.7)) % 500}" for _ in range(rng.randint(5, 120))]
        toxic, low = rng.random() < 0.2, rng.random() < 0.2
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["Vile!", "awful", "nasty"]))
        if low:
            words.append("###x")
        docs.append((i, " ".join(words), "c"))
        labels.append((i, low, toxic))
    frame = spark.createDataFrame([*docs, (1000, None, "c"), (1001, "", "c"), (None, "nasty", "c"), (1, docs[1][1], "c")], "doc_id long, text string, p_toxic string")
    known = spark.createDataFrame([*labels[:600], (None, True, True), (5, None, None)], "doc_id long, low_quality boolean, toxic boolean")
    chain = toxicity.train_chain(frame, known)
    assert [len(m.earlier) for m in chain] == [0, 1]
    scored = toxicity.score_chain(frame, chain)
    rows = {r.doc_id: r for r in scored.collect()}
    assert scored.count() == 904
    wrong = sum((rows[i].p_toxic >= chain[1].cut) != t for i, _, t in labels[600:])
    assert wrong <= 6
    assert rows[1000].p_toxic == rows[1001].p_toxic < chain[1].cut
    empty = toxicity.train_chain(frame, known.limit(0))
    assert {r.p_toxic for r in toxicity.score_chain(frame, empty).collect()} == {0.0}
    assert toxicity.score_chain(frame.limit(0), chain).count() == 0


def test_pipeline_stages_agree_with_plain_rules(spark, folder):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, handed = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, folder)
        docs = written(out, name)
        handed[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns
    before, after = handed["near_dedup"]
    kept = {r.doc_id: r.text for r in after.select("doc_id", "text").collect()}
    assert len(set(kept.values())) == len(kept) and set(before.values()) >= set(kept.values())
    before, after = handed["substring_dedup"]
    assert after.count() == len(before)
    before, after = handed["decontamination"]
    assert {r.doc_id for r in after.collect()} <= set(before)
    before, after = handed["packing"]
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == set(before)
    assert pipeline.run(spark, folder).count() == len(pieces)


def test_verifying_holds_one_pair_of_blocks(spark):
    rows = [(7, i, j, i, u, b"", b"") for i in range(3) for j in range(i, 3) for u in range(5)]
    asked = []

    def batches():
        for start in range(0, len(rows), 4):
            asked.append(start)
            yield dart_minhash.copies_batch(rows[start : start + 4])

    pairs = dart_minhash.block_pairs(batches())
    first = next(pairs)
    assert (first.num_rows, asked) == (5, [0, 4])
    assert [(t["i"][0].as_py(), t["j"][0].as_py(), t.num_rows) for t in pairs] == [(i, j, 5) for i in range(3) for j in range(i, 3)][1:]
    assert list(dart_minhash.block_pairs(iter([]))) == []


def test_verifying_tasks_grow_with_the_copies(spark):
    make = lambda texts, blocks: spark.createDataFrame([(0, r, 1, blocks) for r in range(texts)], "shard int, row int, component bigint, blocks int")
    assert dart_minhash.verifying_tasks(make(1000, 50), 20, 4) == 1250
    assert dart_minhash.verifying_tasks(make(10, 1), 20, 4) == dart_minhash.verifying_tasks(make(10, 1).limit(0), 20, 4) == 4


def test_pairs_just_above_a_lower_least_are_found(spark):
    # 77 of 123 shingles are shared: similarity 0.626, which most signatures show as less than 0.64.
    texts = []
    for pair in range(12):
        start = [f"w{pair}-{k}" for k in range(81)]
        texts += [" ".join(start + [f"{side}{pair}-{k}" for k in range(23)]) for side in "ab"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in dart_minhash.near_duplicates(frame, least=0.6, bands=40, rows=4).collect()}
    assert found == {i: i - i % 2 for i in range(24)}
    assert dart_minhash.agreement_floor(0.8, 160) == pytest.approx(0.642, abs=1e-3)


CLASHES = ["__shard", "__row", "shard", "row", "file", "__kept", "kept", "__spans", "spans", "__n_words", "n_words", "__hit_spans", "hit_n_words", "__p_toxic", "p_toxic", "_P_low_quality"]


def test_stages_keep_columns_of_any_name(spark, folder):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        docs = written(out, name)
        for r in docs.select("doc_id", *CLASHES).collect():
            assert [r[c] for c in CLASHES] == [f"{c}{r.doc_id}" for c in CLASHES], name


def test_unread_results_survive_a_later_run(spark, folder):
    import corpus_pipeline as pipeline
    from strandframe.llm import packing

    first = packing.query(spark, folder)
    second = pipeline.run(spark, folder)
    third = pipeline.run(spark, folder)
    assert first.count() > 0 and second.count() == third.count() > 0


def test_released_tables_are_gone(spark):
    import os

    from strandframe.llm.common import collected, release

    outside = written(spark.range(3).toDF("id"), "kept")
    with collected() as paths:
        inside = written(spark.range(5).toDF("id"), "given-up")
        with collected() as inner:
            assert written(spark.range(7).toDF("id"), "inner").count() == 7
    assert (len(paths), len(inner)) == (1, 1) and inside.count() == 5
    place = paths[0].removeprefix("file://")
    release(paths)
    assert not os.path.exists(place) and paths == [] and outside.count() == 3


def test_marks_of_a_shard_come_in_order(spark):
    from strandframe.llm import shards as beside

    docs = spark.range(40).selectExpr("id AS doc_id", "string(id) AS text").repartition(5)
    held = beside.Shards(docs, "marks")
    rows = held.rows("doc_id").collect()
    marks = spark.createDataFrame([(r.shard, r.row, k, r.doc_id) for r in rows if r.doc_id % 3 for k in (2, 1)], "shard int, row int, start int, what long")

    def read(batches):
        import pyarrow as pa

        stream = beside.Marks(batches, ["start", "what"])
        for shard, uri in stream.shards():
            if shard % 2000 == 0:
                continue  # what is left is skipped
            for first, found in beside.read_shard(uri, ["doc_id"], 3):
                row, start, what = stream.upto(first + found.num_rows)
                ids = found.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(start.astype("i4")), pa.array(what.astype("i8")), pa.array(ids[row - first])], ["start", "what", "id"])

    found = held.beside(marks, ["start", "what"]).mapInArrow(read, "start int, what long, id long").collect()
    assert all(r.what == r.id for r in found)
    expected = sorted(r.doc_id for r in rows if r.doc_id % 3 and r.shard % 2000)
    assert [sorted(r.id for r in found if r.start == k) for k in (1, 2)] == [expected, expected]
    assert held.beside(marks.limit(0), ["start", "what"]).filter("row >= 0").count() == 0


def test_labels_of_absent_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, "nasty words here" if i % 2 else "good words here") for i in range(40)], "doc_id long, text string")
    known = spark.createDataFrame([(i, False, bool(i % 2)) for i in range(2000)], "doc_id long, low_quality boolean, toxic boolean")
    chain = toxicity.train_chain(docs, known, sample=60)
    assert len(chain[1].places) > 0
    scored = {r.doc_id: r.p_toxic >= chain[1].cut for r in toxicity.score_chain(docs, chain).collect()}
    assert scored == {i: bool(i % 2) for i in range(40)}


def test_chain_equals_a_plain_loop(spark):
    """Probabilities of the whole chain against sums written out word by word."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)] + ["awful", "nasty", "junk"]
    docs, labels = [], []
    for i in range(500):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))
        docs.append((i, text))
        labels.append((i, "junk" in text, "nasty" in text or "awful" in text))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    chain = toxicity.train_chain(frame, spark.createDataFrame(labels, "doc_id long, low_quality boolean, toxic boolean"))
    rows = toxicity.score_chain(frame, chain).collect()
    for r in rows:
        earlier = []
        for model in chain:
            places = set(toxicity.word_places([r.text])[0].tolist())
            weights = dict(zip(model.places.tolist(), model.weights.tolist(), strict=True))
            z = model.intercept + sum(weights.get(p, 0.0) for p in places) + sum(a * p for a, p in zip(model.earlier, earlier, strict=True))
            earlier.append(1 / (1 + np.exp(-z)))
        assert (r.p_low_quality, r.p_toxic) == pytest.approx(earlier, abs=1e-9)
