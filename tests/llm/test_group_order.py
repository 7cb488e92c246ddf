"""Pairs packed into one number are ordered as by several keys, and so are those too wide for one."""

import numpy as np
import pytest

from strandframe.llm import suffix_array


@pytest.mark.parametrize("widest", [1, 50, 1 << 40, 1 << 62])
def test_pairs_are_ordered_with_ties_by_place(widest):
    rng = np.random.default_rng(4)
    for n in (2, 3, 1000):
        first = np.sort(rng.integers(0, max(1, n // 5), n)) * 3
        second = rng.integers(0, widest, n) * rng.integers(0, 2, n)
        second[-1] = widest
        by, fresh = suffix_array.group_order(first, second)
        assert by.tolist() == np.lexsort((np.arange(n), second, first)).tolist()
        pairs = list(zip(first[by].tolist(), second[by].tolist(), strict=True))
        assert fresh.tolist() == [i == 0 or pairs[i] != pairs[i - 1] for i in range(n)]
