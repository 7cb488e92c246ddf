"""Blocks of vectors meet without being sent: disk, and links against all pairs."""

import os

import numpy as np
import pytest

from strandframe.llm import multi_index
from strandframe.llm.common import collected, qualified
from tests.llm.test_dedup_operators import plain_links


def bytes_below(folders):
    return sum(os.path.getsize(f"{d}/{f}") for top in folders for d, _, names in os.walk(top) for f in names if not f.endswith((".crc", ".index")))


def test_disk_grows_with_the_vectors_alone(spark):
    shuffled = [f.getPath() for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    x = np.random.default_rng(1).normal(size=(6000, 64))  # no clusters: bounds are weak
    frame = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    before = bytes_below(shuffled)
    with collected() as paths:
        assert multi_index.link_vectors(frame, chunk=200).filter("n_links > 0").count() == 0
    used = bytes_below(shuffled) - before + bytes_below(qualified(p).removeprefix("file://") for p in paths)
    assert used < 5 * 4 * x.size, used  # small files; vectors read, shuffled and in blocks are three times the values


def check(spark, rows, kind, chunk):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    found = multi_index.link_vectors(frame, chunk=chunk).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == plain_links(rows, 0.95)


@pytest.mark.parametrize("chunk", [4096, 40])
def test_crowded_cells_repeats_and_single_precision(spark, chunk):
    rng = np.random.default_rng(2)
    base, at_limit = rng.normal(size=(4, 24)), np.eye(24)
    at_limit[1:12, 0] = 3.0  # far from links as cosines go, one or two codewords for all
    x = [base[i % 4] + rng.normal(size=24) * (0.02 if i % 4 else 0.2) for i in range(240)] + [*at_limit, *base, *base[:2] * 3]
    check(spark, [(900 - i, np.asarray(v, "f4").tolist()) for i, v in enumerate(x)] + [(2000 + i, np.asarray(base[0], "f4").tolist()) for i in range(30)], "float", chunk)


def test_two_lengths_in_one_file(spark):
    rng = np.random.default_rng(3)
    x = [np.repeat(rng.normal(size=(5, n)), 4, axis=0) + rng.normal(size=(20, n)) * 0.05 for n in (3, 8, 1)]
    check(spark, [(i, v.tolist()) for i, v in enumerate(v for part in x for v in part)], "double", 4096)


def test_equal_vectors_lie_in_one_cell_whatever_lies_beside_them():
    words = np.vstack([np.eye(8), -np.eye(8)])
    x = np.vstack([np.zeros((1, 8)), np.ones((1, 8)), np.random.default_rng(4).integers(-1, 2, (400, 8))]).astype("f8")
    alone = np.concatenate([multi_index.nearest_word(v[None], words) for v in x])
    assert (multi_index.nearest_word(x, words) == alone).all()
    assert (multi_index.nearest_word(x[::-1], words) == alone[::-1]).all()


@pytest.mark.parametrize("blocks", [1, 2, 3, 8, 9])
def test_two_blocks_meet_once(blocks):
    found = [tuple(sorted((a, b))) for a in range(blocks) for b in multi_index.met(a, blocks, True)]
    assert sorted(found) == [(a, b) for a in range(blocks) for b in range(a + 1, blocks)]
    assert all(len(multi_index.met(a, blocks, False)) == blocks - 1 for a in range(blocks))
