from collections import Counter

import numpy as np
import pytest

from tessera.llm import lmscore


def brute(rows, good, words=1 << 16, strength=32.0):
    """Both models with exact pairs: without collisions the hashed tables hold the same."""
    texts = [(t or "").lower().split() for _, t in rows]
    every = Counter(w for t in texts for w in t)
    vocab = set(every)
    uni, bi, context = [Counter(), Counter()], [Counter(), Counter()], [Counter(), Counter()]
    for (d, _), t in zip(rows, texts):
        for m in [1] + [0] * (d in good):
            for a, b in zip(["<s>", *t], t):
                uni[m][b] += 1
                bi[m][a, b] += 1
            context[m].update(t)
            context[m]["<s>"] += bool(t)
    size = len(vocab) + 2
    out = []
    for t in texts:
        loss = np.zeros((2, len(t)))
        for m in (0, 1):
            n = sum(uni[m].values()) + context[m]["<s>"]
            for i, (a, b) in enumerate(zip(["<s>", *t], t)):
                p = (uni[m][b] + 1) / (n + size)
                loss[m, i] = -np.log2((bi[m][a, b] + strength * p) / (context[m][a] + strength))
        out.append((len(t), *loss.mean(axis=1), (loss[1] - loss[0]).mean()) if t else (0, 0, 0, 0))
    return out


def test_scores_equal_brute_force(spark):
    rng = np.random.default_rng(10)
    rows = [(i, " ".join(rng.choice(list("abcdefghij"), rng.integers(1, 60), p=np.arange(10, 0, -1) / 55))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "a b c " * 3000), (None, "a b"), (5, "a repeated id")]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60)] + [(None, 1)], "doc_id long, quality int")
    got = lmscore.score_documents(docs, lmscore.fit(docs, labels)).collect()
    want = brute(rows, {i for i in range(60) if i % 2})
    key = lambda r: (str(r[0]), r[1], round(r[2], 3))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(((r[0], *w) for r, w in zip(rows, want)), key=key)):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=1e-4)
    assert lmscore.score_documents(docs.limit(0), lmscore.fit(docs.limit(0), labels)).count() == 0


def test_words_and_pairs_beyond_any_table_are_counted(spark, monkeypatch):
    """90,000 words and as many pairs: none is unknown, none shares a count, over many parts."""
    monkeypatch.setattr(lmscore, "GROUP_BYTES", 1 << 16)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 120_000, 1000))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int")
    models = lmscore.fit(docs, labels)
    assert models.parts > 20
    assert models.words == len({w for _, t in rows for w in t.split()}) + 1 > 90_000
    got = {r.doc_id: tuple(r)[1:] for r in lmscore.score_documents(docs, models).collect()}
    assert len(got) == 300
    for (i, _), w in zip(rows, brute(rows, {i for i in range(300) if i % 3 == 0}), strict=True):
        assert got[i] == pytest.approx(w, abs=1e-9)
