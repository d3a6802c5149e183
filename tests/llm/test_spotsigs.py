import hashlib
import re

from pyspark.sql import Row

from tessera.llm import spotsigs as S

TEXTS = ["the cat of the house sat in a big tree by the old river and it was green " * 4, "", None, "!!!", "cat dog", "the", "the cat", "ÄB der Hund und die Katze sind im Haus " * 300, "word"]


def chains(text):
    words = [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (text or "").lower()) if w]
    out = set()
    for i, w in enumerate(words):
        rest = [x for x in words[i:] if x not in S.ANCHORS]
        if w in S.ANCHORS and len(rest) >= S.CHAIN:
            out.add((w, *rest[: S.CHAIN]))
    if not out and text:
        out = {tuple(words) or text}
    return out


def likeness(a, b):
    a, b = chains(a), chains(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_signatures_are_chains():
    for t, s in zip(TEXTS, S.signatures(TEXTS)):
        assert len(s) == len(chains(t)), t
    for a in TEXTS:
        for b in TEXTS:
            x, y = S.signatures([a, b])
            assert S.jaccard(x, y) == likeness(a, b)


def test_compare_with_edited(spark):
    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(None, "the end of a long story"), (6, "twice the same id")]
    docs = spark.createDataFrame([Row(doc_id=i, text=t, role=1, part="x") for i, t in rows], "doc_id long, text string, role int, part string").repartition(7)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for i, (doc_id, t) in enumerate(ordered):
        t, f = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        new = S.edit(t, f)
        want.append((str(doc_id), len(t), hashlib.sha256(new.encode()).hexdigest(), likeness(t, new), likeness(t, f)))
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in S.compare_with_edited(docs).collect()]
    assert sorted(got) == sorted(want)
    one = S.compare_with_edited(docs.where("doc_id = 0")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert S.compare_with_edited(docs.limit(0)).count() == 0


def test_near_sets_equals_brute_force(spark):
    words = "tree house river stone light field cloud grass night water bread".split()
    base = [" ".join(f"the {words[(i * j + j * j) % 11]} {words[(i + 3 * j) % 11]}{j}" for j in range(25)) for i in range(12)]
    texts = base + [b.replace(f"{k}", "x", 1) for k, b in enumerate(base)] + base[:3] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.a, r.b): r.likeness for r in S.near_sets(docs).collect()}
    first = {}
    for i, t in enumerate(texts):
        if chains(t):
            first.setdefault(frozenset(chains(t)), i)
    want = {(a, b): likeness(texts[a], texts[b]) for a in first.values() for b in first.values() if a < b and likeness(texts[a], texts[b]) >= 0.8}
    assert got == want and want
