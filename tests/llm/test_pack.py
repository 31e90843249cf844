import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridloom.llm import pack
from gridloom.llm import words as e


def check(entries, rows, capacity):
    used, filled, spans = {}, {}, {}
    for c, doc, piece, start, n, offset in rows:
        assert 0 < n <= capacity
        filled.setdefault(c, []).append((offset, n))
        spans.setdefault(doc, []).append((piece, start, n))
        used[doc] = used.get(doc, 0) + n
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    for doc, n in entries:
        assert used.get(doc, 0) == n
        parts = sorted(spans.get(doc, []))
        assert [p for p, _, _ in parts] == list(range(len(parts)))
        assert all(s == i * capacity for i, (_, s, _) in enumerate(parts))
        assert len(parts) == -(-n // capacity)  # divided only if it must be
    return len(filled)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 260), max_size=60), st.integers(1, 8))
def test_every_token_once(sizes, window):
    entries = list(enumerate(sizes))
    rows = [r for w in pack._windows(iter(entries), 100, window) for r in w]
    check(entries, rows, 100)


def test_little_is_unused():
    rng = np.random.default_rng(0)
    sizes = np.minimum(rng.lognormal(6.6, 1.0, 3000).astype(int) + 1, 40_000)
    entries = list(enumerate(sizes.tolist()))
    rows = [r for w in pack._windows(iter(entries), 4096, 256) for r in w]
    k = check(entries, rows, 4096)
    assert sizes.sum() / (k * 4096) > 0.97


def test_differencing_balances():
    parts = pack.differencing([8, 7, 6, 5, 4], 2)
    assert sorted(s for s, _ in parts) == [14, 16]  # what the method gives; the best is 15 and 15
    assert sorted(i for _, items in parts for i in items) == [0, 1, 2, 3, 4]
    assert pack.differencing([], 3) == []
    sums = [s for s, _ in pack.differencing(list(range(1, 101)), 10)]
    assert max(sums) - min(sums) <= 2


def test_the_count_rises_on_overflow():
    rng = random.Random(4)
    for _ in range(20):
        sizes = [rng.randrange(1, 60) for _ in range(40)]
        alone, mended = (pack.pack_window(sizes, 100, mend) for mend in (False, True))
        for parts in (alone, mended):
            assert sorted(i for p in parts for i in p) == list(range(40)) and max(sum(sizes[i] for i in p) for p in parts) <= 100
        assert -(-sum(sizes) // 100) <= len(mended) <= len(alone)


def test_equal_and_full_items():
    assert len(pack.pack_window([50] * 7, 100)) == 4
    assert sorted(map(len, pack.pack_window([60] * 3, 100))) == [1, 1, 1]
    assert pack.pack_window([], 100) == []


@pytest.mark.skipif(not os.path.exists(e.VOCABULARY), reason="no vocabulary files here")
def test_table(spark):
    texts = [None, "", "one two three", "word " * 300, "x y z", "one two three"]
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "doc_id bigint, text string, offset int")
    n = {r["doc_id"]: r["n_tokens"] for r in e.token_counts(df).collect()}
    rows = [tuple(r) for r in pack.containers(df.coalesce(1), capacity=64, window=2).collect()]
    check(list(n.items()), rows, 64)
    assert {r[1] for r in rows} == {2, 3, 4, 5}
    assert pack.containers(df.limit(0)).collect() == []
    report = pack.fill_report({"a": pack.containers(df, 64, 2), "b": pack.containers(df, 64, 2, mend=False)}, 64).collect()
    assert [r["tokens"] for r in report] == [sum(n.values())] * 2 and all(r["fullest"] <= 64 for r in report)
