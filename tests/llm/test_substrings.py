import re

import numpy as np
from pyspark.sql import Row

from tessera.llm import substrings


def brute(rows, window=20):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r.text or "") for r in rows]
    key = [(r.doc_id is None, r.doc_id or 0) for r in rows]
    first = {}
    for k, w in zip(key, words):
        for p in range(len(w) - window + 1):
            g = tuple(w[p : p + window])
            first[g] = min(first.get(g, (k, p)), (k, p))
    out = []
    for k, w in zip(key, words):
        gone = set()
        for p in range(len(w) - window + 1):
            if (k, p) > first[tuple(w[p : p + window])]:
                gone.update(range(p, p + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdéß"), rng.integers(1, 5)))
    passages = [[word() for _ in range(n)] for n in (20, 21, 19, 35, 60, 140)]
    rows = [Row(doc_id=None, text=None), Row(doc_id=3, text=""), Row(doc_id=4, text=" \n\t"), Row(doc_id=9000, text="a " * 3000)]
    for i in range(120):
        parts = []
        for _ in range(rng.integers(1, 6)):
            parts.append([word() for _ in range(rng.integers(0, 30))])
            parts.append(passages[rng.integers(0, len(passages))])
        rows.append(Row(doc_id=int(rng.integers(0, 90)) if i % 17 else None, text=str(rng.choice([" ", "\n", "  ", "\x0b"])).join(x for p in parts for x in p)))
    rows += [rows[10], rows[11], Row(doc_id=7777, text=rows[12].text)]
    docs = spark.createDataFrame([Row(**r.asDict(), pid=1, kept_text="x", rest=2.5) for r in rows], "doc_id long, text string, pid int, kept_text string, rest double")
    for size in (1 << 20, 4000):
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_text) for r in substrings.repeated_words(docs, group_bytes=size).collect()))
        want = sorted((r.doc_id is None, r.doc_id or 0, *x) for r, x in zip(rows, brute(rows)))
        assert got == want
    r = substrings.repeated_words(docs).where("n_removed > 0").first()
    assert r.rest.rest == 2.5 and sum(s.last - s.first for s in r.spans) == r.n_removed
    assert substrings.repeated_words(docs.limit(0)).count() == 0
