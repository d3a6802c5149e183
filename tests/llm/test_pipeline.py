"""The pipeline's stages against a brute-force version over a small corpus."""

import re

import numpy as np
import pytest
from test_nearcopies import brute_groups
from test_substrings import brute as brute_repeats
from test_tokens import check_pack
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import bpe, language, toxicity
from tessera.llm.common import read_table, stash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    real = read_table(spark, SF, "documents")
    rows = [(None, None, "en", "s", 0), (9001, None, None, "s", 0), (9002, "", "en", None, 0), (9003, "12 34 !!", "en", "s", 8), (None, "the house and the cat were there", "en", "s", 32), (9004, "you idiot " * 30, "en", "s", 300)]
    more = spark.createDataFrame(rows, real.schema)
    return real.unionByName(more).unionByName(real.where("doc_id = 5")).selectExpr("*", "'x' AS row", "doc_id AS fp", "1.5 AS score", "'t' AS text0")


def test_stages_equal_brute_force(spark, docs):
    columns = docs.columns
    model = language.train(docs)
    rows = docs.collect()
    want = [r for r in rows if language.has_letter(r.text)]
    assert model.predict(language.features([r.text for r in want]))[0]
    step = stash(corpus_pipeline.identify_language(spark, docs, SF), "t")
    assert step.columns == columns and sorted(map(str, step.collect())) == sorted(map(str, want))

    grammar = toxicity.train(step, read_table(spark, SF, "labels"))
    want = [r for r, s in zip(want, grammar.score([r.text for r in want])) if s < 0.5]
    step = stash(corpus_pipeline.drop_toxic(spark, step, SF), "t")
    assert step.columns == columns and sorted(map(str, step.collect())) == sorted(map(str, want))
    assert 9004 not in {r.doc_id for r in want}

    group = brute_groups([(r.doc_id, r.text) for r in want])
    first = {}
    for r, g in zip(want, group):
        if r.doc_id is not None:
            first[g] = min(r.doc_id, first.get(g, r.doc_id))
    kept, seen = [], set()
    for r, g in zip(want, group):
        if r.doc_id == first.get(g) and g not in seen:
            seen.add(g)
            kept.append(r)
    step = stash(corpus_pipeline.drop_near_duplicates(spark, step, SF), "t")
    assert step.columns == columns and sorted(map(str, step.collect())) == sorted(map(str, kept))
    assert len(kept) < len(want)

    want = []
    for r, (n, gone, text) in zip(kept, brute_repeats(kept)):
        if gone < n:
            d = r.asDict()
            want.append(str(type(r)(**(d | {"text": text, "n_chars": len(text)} if gone else d))))
    step = stash(corpus_pipeline.remove_repeated_passages(spark, step, SF), "t")
    assert step.columns == columns and sorted(map(str, step.collect())) == sorted(want)

    left = step.collect()
    packed = corpus_pipeline.pack_sequences(spark, step, SF).collect()
    number = {r.doc_id: i for i, r in enumerate(left)}
    assert len(number) == len(left)
    moved = [type(p)(**(p.asDict() | {"doc_id": number[p.doc_id]})) for p in packed]
    assert check_pack(moved, [r.text for r in left], Tokenizer.from_file(bpe.default_path()), 2048) <= 2


def test_run_and_empty_input(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 50
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, SF), "t")
        assert docs.count() == 0


def test_documents_stay_where_no_language_can_be_learnt(spark):
    texts = ["the house and the cat", "der Hund", "É", "", None, "12 34 !!"]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for ids, lang in ((range(6), None), ([None] * 6, "en")):
        docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t in zip(ids, texts)], kinds)
        step = corpus_pipeline.identify_language(spark, docs, SF)
        assert step.columns == docs.columns
        assert sorted(map(str, step.collect())) == sorted(map(str, docs.collect()[:3]))


def test_an_id_on_unrelated_texts_stays_in_each_of_its_groups(spark):
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{j}" for j in rng.integers(0, 5000, 60))
    x, y, z, u, v = (text() for _ in range(5))
    # 5: two unrelated texts; 7: a copy of 3's text, and one of its own; 8: twice the same; and without an id
    rows = [(5, x), (5, y), (3, z), (7, z + " more"), (7, u), (8, v), (8, v), (None, text()), (None, u)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    want = [rows[i] for i in (0, 1, 2, 4, 5, 7)]
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted((str(i), t) for i, t in want)
