"""Near-copy groups against all pairs of a small corpus."""

import numpy as np
from test_simhash import brute_components

from tessera.llm import nearcopies as N
from tessera.llm import simhash
from tessera.llm.common import read_table


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows, least=0.8):
    """A component number for every (doc_id, text)."""
    fps = simhash.fingerprints([t for _, t in rows], 5)
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = both and both >= least * (len(sets[i]) + len(sets[j]) - both) - 1e-9
            if alike or int(fps[i] ^ fps[j]).bit_count() <= 3:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS label", "1 AS n", "2 AS sk").repartition(5)
    got = N.near_copy_groups(docs).collect()
    want = brute_groups(rows)
    assert len(got) == len(rows)
    least, ids = {}, {}
    for (i, _), c in zip(rows, want):
        ids[i] = c
        if i is not None:
            least[c] = min(i, least.get(c, i))
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == least[ids[r.doc_id]], r
    assert len({r.label for r in got}) == len(set(want))
    return want


def corpus(bases=25, cluster=40):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.choice(words, 60))
    rows = []
    for _ in range(bases):
        base = rng.choice(words, rng.integers(4, 300)).tolist()
        if rng.random() < 0.5:
            base += passage.split()
        rows.append(" ".join(base))
        for _ in range(rng.integers(0, 6)):
            copy = list(base)
            for at in rng.integers(0, len(copy), max(1, int(len(copy) * rng.choice([0.005, 0.015, 0.025, 0.04])))):
                copy[at] = "edit%d" % rng.integers(1000)
            rows.append(" ".join(copy))
    base = rng.choice(words, 150).tolist()
    for i in range(cluster):  # a cluster in which each copy has one other edit
        rows.append(" ".join([*base[: 3 * i], f"v{i}", *base[3 * i + 1 :]]))
    rows += ["", None, "one two", "One  two", "a b c d e f", "a b c d e f", "x " * 3000, passage]
    order = rng.permutation(len(rows))
    return [(int(i) if i % 9 else None, rows[k]) for i, k in enumerate(order)] + [(1, rows[order[1]])]


def test_groups_equal_all_pairs(spark):
    rows = corpus()
    want = check(spark, rows)
    fps = [int(x) for x in simhash.fingerprints([t for _, t in rows], 5)]
    alone = brute_components(list(range(len(rows))), fps)
    assert len(set(want)) < len(set(alone.values()))  # what SimHash by itself misses


def test_small_blocks_and_no_leaders_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "KEY_BLOCK", 3)
    monkeypatch.setattr(N, "SHARD_GROUPS", 1)
    monkeypatch.setattr(N, "GROUP_BYTES", 4000)
    monkeypatch.setattr(N, "LEADERS", 0)
    monkeypatch.setattr(N.candidates, "__defaults__", (4000,))
    check(spark, corpus(bases=10, cluster=25))


def test_shared_passages_make_no_links(spark):
    """Texts of several common passages, similar only to those with most of the same."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(3000)]
    passages = [" ".join(rng.choice(words, 30)) for _ in range(8)]
    rows = [(i, " ".join(passages[k] for k in sorted(rng.choice(8, rng.integers(1, 8), replace=False)))) for i in range(120)]
    want = check(spark, rows)
    assert 1 < len(set(want)) < 120


def test_real_rows_and_empty_table(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()])
    assert N.near_copy_groups(docs.limit(0)).count() == 0
