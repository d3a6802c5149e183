import math

import numpy as np

from tessera.llm import topk


def test_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.standard_normal(8) * 0.3).round(2).astype("float32").tolist()) for i in range(400)]
    rows += [(400, None), (450, [1.0, None]), (500, [float("nan")] * 8), (550, [float("inf")] * 8), (600, rows[0][1]), (601, rows[0][1]), (650, []), (700, [0.5]), (0, rows[0][1]), (None, rows[1][1]), (None, [2.0] * 8), (7, [1.0] * 8), (50, [0.25] * 8), (7, rows[7][1])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, rank int, score string")
    ok = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    want = []
    for q, u in {(i, tuple(v)) for i, v in ok if i is not None and i % 50 == 0}:
        s = sorted((-sum(a * b for a, b in zip(u, v)), math.inf if c is None else c) for c, v in ok if c != q)[:5]
        want += [(q, r + 1, None if c == math.inf else c, -x) for r, (x, c) in enumerate(s)]
    text = lambda found: sorted(map(str, found))
    for block, asked, group in ((8192, 512, 1 << 14), (64, 3, 4)):
        got = topk.top_k(df, df.where("vec_id % 50 = 0"), block=block, query_block=asked, query_group=group).collect()
        assert text(map(tuple, got)) == text(want)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def brute(ids, x, qid, q, k):
    return sorted((-int(sum(int(a) * int(b) for a, b in zip(q, v))), int(c), i) for i, (c, v) in enumerate(zip(ids, x)) if c != qid)[:k]


def agrees(ids, x, qids, q, k=5):
    lists = topk.SortedLists(ids, x)
    for qid, own, (at, score) in zip(qids, q, lists.top(qids, q, k), strict=True):
        want = brute(ids, x, qid, own, k)
        assert [(-int(s), int(ids[a])) for a, s in zip(at, score)] == [w[:2] for w in want]
    return lists


def test_dense_tied_and_tiny_lists():
    rng = np.random.default_rng(7)
    for n in (1, 4, 6, 300):
        x = rng.integers(-5, 6, (n, 6))
        agrees(rng.permutation(n) // 2, x, np.arange(9), rng.integers(-5, 6, (9, 6)))
    agrees(np.arange(20), np.zeros((20, 3), np.int64), np.arange(2), np.ones((2, 3), np.int64))


def test_sums_beyond_doubles_are_exact():
    rng = np.random.default_rng(8)
    x, q = rng.integers(-(1 << 29), 1 << 29, (50, 4)), rng.integers(-(1 << 29), 1 << 29, (3, 4))
    x[1] = x[0] + [0, 0, 0, 1]  # scores that doubles can't tell apart
    agrees(np.arange(50), x, np.array([90, 91, 92]), q)


def test_reading_stops_early_on_skewed_vectors():
    """Few long vectors among many short ones: only a part of the lists is read."""
    rng = np.random.default_rng(9)
    x = rng.integers(0, 4, (4000, 16)) * (rng.random((4000, 16)) < 0.02)
    x[:40] = rng.integers(50, 300, (40, 16))
    lists = agrees(np.arange(4000), x, np.arange(10_000, 10_016), rng.integers(0, 100, (16, 16)))
    assert 0 < lists.reads <= 4000 * 16 // 8
    dense = agrees(np.arange(500), rng.integers(-100, 100, (500, 16)), np.array([10_000]), rng.integers(-100, 100, (1, 16)))
    assert dense.reads <= 500 * 16
