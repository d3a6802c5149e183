import numpy as np
import xxhash
from pyspark.sql import Row

from tessera.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if bin(fps[i] ^ fps[j]).count("1") <= 3 and label[j] > label[i]:
                    label[j] = label[i]
                    changed = True
    return {(d, f): min((ids[k] for k in range(len(fps)) if label[k] == label[i] and ids[k] is not None), default=None) for i, (d, f) in enumerate(zip(ids, fps))}


TEXTS = ["", None, "One two", "one  two", "A b c", "a b c d e f g", " a b c d e f h ", "x " * 700, "ÄB é \x0b z q", "w" * 5000 + " b c d", "\n\t", "a b c"]


def test_fingerprints_match_definition():
    rng = np.random.default_rng(0)
    many = TEXTS + [" ".join(rng.choice(list("abcdefgh"), rng.integers(1, 400))) for _ in range(40)]
    assert [int(x) for x in simhash.fingerprints(many)] == [brute_fp(t) for t in many]


def test_links_connect_what_all_pairs_connect(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base:
        for _ in range(12):
            x = int(b)
            for _ in range(rng.integers(1, 6)):
                x ^= 1 << int(rng.integers(0, 64))
            fps.add(x)
    fps = sorted(fps)
    label = brute_components(list(range(len(fps))), fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    from tessera.llm.components import components

    for cap in (simhash.RUN_CAP, 2):
        got = {r.node: r.label for r in components(simhash.links(df, cap)).collect()}
        groups = {}
        for i, f in enumerate(fps):
            s = int(np.uint64(f).view(np.int64))
            groups.setdefault(got.get(s, s), set()).add(i)
        want = {}
        for i, f in enumerate(fps):
            want.setdefault(label[(i, f)], set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_large_runs_equal_all_pairs():
    rng = np.random.default_rng(2)
    run = np.unique(rng.integers(0, 1 << 14, 3000).astype(np.uint64) << np.uint64(35))
    a, b = [], []
    simhash._link(run, np.arange(len(run)), (32, 32), fa := simhash._Forest(len(run)), a)
    simhash._near(run, np.arange(len(run)), fb := simhash._Forest(len(run)), b)
    assert [fa.root(i) for i in range(len(run))] == [fb.root(i) for i in range(len(run))]


def test_near_groups_edge_rows(spark):
    ids = [5, 6, 7, 8, None, 10, 11, 12, 13, 14, 15, 16]
    rows = [Row(doc_id=i, text=t, fp="clash", component_id=-1) for i, t in zip(ids, TEXTS)] + [Row(doc_id=5, text="", fp="", component_id=0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    ids = [r.doc_id for r in rows]
    fps = [brute_fp(r.text) for r in rows]
    want = brute_components(ids, fps)
    for r in got:
        assert r.component_id == want[(r.doc_id, int(np.int64(r.fp).view(np.uint64)))]
    assert simhash.near_groups(docs.limit(0)).count() == 0
