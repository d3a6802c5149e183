import zlib

import numpy as np
import pytest
from pyspark.sql import Row

from tessera.llm import language, toxicity
from tessera.llm.common import read_table

SF = "/root/testdata/sf0.1"


def kinds(text, lexicon=None):
    return [k for k, _, _ in toxicity.Grammar(lexicon or {"idiot$": 2.0, "lowe": 1.0, "waste space": 3.0}).clauses(text)]


def test_machine_accepts_what_the_grammar_says():
    P, T, R, N = toxicity.PLAIN, toxicity.TARGETED, toxicity.REPORTED, toxicity.NEGATED
    for text, want in {
        "an idiot": [P],
        "you are an idiot": [T],
        "idiots no. idiot like you": [T],
        "you are not an idiot": [N],
        "they said: idiot": [R],
        "the paper said idiot": [R],
        'the paper said "idiot"': [R],
        'the report quoted "idiot"': [R],
        "the paper said: idiot": [R],
        'a "quote. more" idiot here': [P],
        'he said "one. two idiot here" then. an idiot': [R, P],
        "note: idiot": [P],
        "he isn't an idiot": [N],
        "don\u2019t be an idiot": [N],
        "don't be an idiot": [N],
        "not here. an idiot": [P],
        'an open "quote\nan idiot': [P],
        "loweiä und": [P],
        "a waste space, he": [T],
        "waste of space": [],
        "i will kill you": [T],
        "kill the process": [],
        "an idiot; you idiot idiot": [P, T],
    }.items():
        assert kinds(text) == want, text
    assert kinds("") == kinds(None) == kinds("\n..") == []
    [(kind, weight, threat)] = toxicity.Grammar({}).clauses("we will kill them")
    assert kind == T and threat and weight == pytest.approx(2.0 + 1.0 + 0.5)


def by_definition(classes):
    """Marks and weight of each token, from what stands before it."""
    X, out = toxicity, []
    for i, c in enumerate(classes):
        clause = max([k for k in range(i) if classes[k] in (X.STOP, X.LINE)], default=-1) + 1
        line = max([k for k in range(i) if classes[k] == X.LINE], default=-1) + 1
        near = lambda cause, n: cause in classes[max(clause, i - n) : i]
        said, quoted = X.SAYING in classes[clause:i], 0
        for k in classes[line:i]:
            quoted = 1 if k == X.OPENING else 0 if k == X.CLOSING else 1 - quoted if k == X.QUOTE else quoted
        threat = c == X.VIOLENCE and near(X.INTENT, 4)
        marks, weight = X.MATCH if c == X.INSULT or threat else 0, 0.0
        if marks:
            for mark, holds in ((X.THREAT_MARK, threat), (X.TARGET_MARK, near(X.TARGET, 4)), (X.NEGATION_MARK, near(X.NEGATION, 3)), (X.REPORT_MARK, said or quoted)):
                if holds:
                    marks, weight = marks | mark, weight + X.WEIGHTS[mark]
        out.append((marks, weight))
    return out


def test_composed_machine_equals_its_parts():
    """The composed machine against its parts in a row, and both against the definition."""
    rng = np.random.default_rng(8)
    X = toxicity
    for _ in range(300):
        classes = rng.integers(0, len(X.CLASSES), 25).tolist()
        symbols = [(c, X.MATCH if c == X.INSULT else 0) for c in classes]
        got = X.MACHINE.run(symbols)
        weight = np.zeros(len(symbols))
        for part in (X.THREAT, X.TARGETING, X.NEGATING, X.REPORTING):
            out = part.run(symbols)
            symbols, weight = [x for x, _ in out], weight + [w for _, w in out]
        assert [x for x, _ in got] == symbols and [w for _, w in got] == pytest.approx(weight)
        assert [(m, pytest.approx(w)) for (_, m), w in got] == by_definition(classes)


def test_composition_over_all_short_inputs():
    """Every path of two small machines: what the second writes on what the first writes."""
    from itertools import product

    a, b, symbols = toxicity.NEGATING, toxicity.TARGETING, [(c, m) for c in (toxicity.NEGATION, toxicity.TARGET, toxicity.STOP, toxicity.INSULT) for m in (0, 1)]
    both = toxicity.compose(a, b, symbols)
    for path in product(symbols, repeat=4):
        first = a.run(list(path))
        second = b.run([x for x, _ in first])
        assert both.run(list(path)) == [(y, v + w) for (_, v), (y, w) in zip(first, second)]


def test_toxicity_on_held_out_rows(spark):
    docs, labels = read_table(spark, SF, "documents"), read_table(spark, SF, "labels")
    grammar = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, grammar).selectExpr("row.doc_id doc_id", "score").join(labels, "doc_id").where(toxicity.held_out()).select("doc_id", "score", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    bad, good = np.array([r.score for r in got if r.toxic]), np.array([r.score for r in got if not r.toxic])
    assert np.mean(good < 0.5) > 0.98 and np.mean(bad >= 0.5) > 0.85
    assert np.mean([np.mean(good < b) + np.mean(good == b) / 2 for b in bad]) > 0.95


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([Row(doc_id=1, text=None, score=9.0, row="r"), Row(doc_id=None, text="", score=None, row=None), Row(doc_id=3, text="you idiot " * 9000, score=1.0, row="x")], "doc_id long, text string, score double, row string")
    labels = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    out = {r.row.doc_id: r for r in toxicity.score_documents(docs, toxicity.train(docs, labels)).collect()}
    assert out[1].score == out[None].score < 0.5 < out[3].score <= 1 and out[1].row.score == 9.0
    assert toxicity.score_documents(docs.limit(0), toxicity.train(docs.limit(0), labels.limit(0))).count() == 0


def test_language_on_held_out_rows(spark):
    docs = read_table(spark, SF, "documents")
    model = language.train(docs)
    assert set(model.langs) == {"de", "en", "es", "fr"} and set(model.levels) == {"", "germanic", "romance"}
    got = language.identify(docs, model).where("crc32(cast(cast(row.doc_id as string) as binary)) % 4 = 2").selectExpr("row.lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.99
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, f"the cat and house {i} was there with water", "en") for i in range(20)] + [(i + 20, f"der hund und das haus {i} ist nicht schön", "de") for i in range(20)] + [(None, "x", "en"), (50, None, "de"), (51, "", None), (52, " 12 ½ !!", "en"), (53, "haus " * 20000, None), (54, "É", "zz")]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    out = {r.row.doc_id: r for r in language.identify(docs, language.train(docs)).collect()}
    assert len(out) == len(rows)
    assert [out[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3 and out[53].lang_pred in ("de", "en", "zz")
    assert out[3].lang_pred == "en" and out[23].lang_pred == "de"
    assert language.train(docs.limit(0)) is None
    assert language.identify(docs.limit(0), None).count() == 0
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(9)
    x = rng.standard_normal((200, 5)).astype(np.float32)
    y = np.where(x @ [1, -2, 0.5, 0, 1] + 0.3 > 0, 1.0, -1.0)
    w = language.train_svm(x, y, c=10.0, epochs=200)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97


def test_every_language_is_learnt_and_repeats_count_once(spark):
    """80 languages, more than a fixed number of classes would hold, and an id repeated many times."""
    rng = np.random.default_rng(4)
    alphabet = [chr(0x4E00 + i) for i in range(400)]
    rows, i = [], 0
    for k in range(80):
        for _ in range(8):
            rows.append((i, " ".join("".join(rng.choice(alphabet[5 * k : 5 * k + 5], 4)) for _ in range(20)), f"l{k:02}"))
            i += 1
    rows += [rows[0]] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs, per_language=3)
    assert len(model.langs) == 80
    got = language.identify(docs, model).selectExpr("row.lang = lang_pred AS ok").collect()
    assert len(got) == len(rows) and np.mean([r.ok for r in got]) > 0.95
    assert len(language.train(docs, per_language=3, sample_rows=100).langs) == 80
