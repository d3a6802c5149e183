"""Result contracts, bakes and corpus names on small fixtures."""

import io
import wave

import numpy as np
import pytest

from tessera.operators import bake, export, results, windows
from tessera.sources import tables


def wav(samples, rate):
    w = io.BytesIO()
    with wave.open(w, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate)
        f.writeframes(np.asarray(samples, "<i2").tobytes())
    return bytearray(w.getvalue())


def test_result_keys(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4, 256)], "corpus string, bpb double, loss double, seq_ce double, n_seqs int, context_length int")
    assert results.require_result_keys(df, "corpus").columns == ["corpus", *results.RESULT_KEYS]
    for bad in (df.drop("loss"), df.withColumn("more", df.bpb)):
        with pytest.raises(ValueError, match="result columns"):
            results.require_result_keys(bad, "corpus")
    results.require_reconciled(df, {"n_seqs": 4})
    with pytest.raises(ValueError, match="4 instead of 5"):
        results.require_reconciled(df, {"n_seqs": 5})


def test_matrix_has_no_number_where_a_cell_is_missing(spark):
    df = spark.createDataFrame([(1, 4, 0.5), (2, 8, 0.25)], "m int, k int, accuracy double")
    got = {r.m: (r.k4, r.k8) for r in results.accuracy_matrix(df, "m", "k", [4, 8]).collect()}
    assert got[1][0] == 0.5 and got[2][1] == 0.25 and np.isnan(got[1][1]) and np.isnan(got[2][0])


def test_csv_dimension_and_rounded_table(spark, tmp_path):
    (tmp_path / "d.csv").write_text("filename,fold\na.wav,1\nb.wav,2\n")
    assert tables.csv_dimension(spark, str(tmp_path / "d.csv"), ["fold"], "filename").count() == 2
    (tmp_path / "e.csv").write_text("filename,fold\na.wav,1\na.wav,2\n")
    with pytest.raises(ValueError, match="different values"):
        tables.csv_dimension(spark, str(tmp_path / "e.csv"), ["fold"], "filename")
    with pytest.raises(ValueError, match="missing columns"):
        tables.csv_dimension(spark, str(tmp_path / "d.csv"), ["target"], "filename")
    results.write_rounded_csv(spark.createDataFrame([("a", 1.0049)], "k string, v double"), str(tmp_path / "t"), {"v": 2})
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "t")).collect()] == [("a", "1.00")]


def test_every_corpus_bakes_and_round_trips(spark, tmp_path):
    rng = np.random.default_rng(2)
    raw = spark.createDataFrame([(f"f{i}", bytearray(rng.integers(0, 256, 3 * n).astype(np.uint8).tobytes()), f"a $( x $) {'b ' * n}") for i, n in enumerate((400, 90, 5))], "name string, raw binary, text string")
    shards = spark.createDataFrame([(i % 10, i, bytearray(b"abcdefgh" * 40)) for i in range(40)], "shard int, doc_id long, raw binary")
    sounds = lambda rate: spark.createDataFrame([(f"s{i}", wav(rng.integers(-9000, 9000, n), rate)) for i, n in enumerate((3000, 700))], "name string, raw binary")
    body = (rng.random(2000) - 0.5).astype("<f4").tobytes()
    import struct

    head = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 1, 44_100, 176_400, 4, 32) + b"data" + struct.pack("<I", len(body))
    music = spark.createDataFrame([("m", bytearray(b"RIFF" + struct.pack("<I", len(head) + len(body)) + head + body))], "name string, raw binary")
    for stem, corpus in bake.CORPORA.items():
        source = shards if corpus.family == "shards" else music if "musicnet" in stem else sounds(16_000 if "speech" in stem else 44_100) if "pcm8" in stem else raw
        records = bake.bake(source, stem, 101)
        n = export.write_windows(records, str(tmp_path / stem), 100)
        assert n > 0 and records.select("id").distinct().count() == n
    assert bake.bake(raw, "arithmetic", 101).count() == bake.CAP
    with pytest.raises(ValueError, match="unknown corpus"):
        bake.bake(raw, "nothing", 101)


def test_picked_windows_are_those_of_the_clips(spark):
    rows = [(f"c{i}", bytearray(range(10 * i, 10 * i + 10)) * 3) for i in range(4)]
    df = spark.createDataFrame(rows, "name string, raw binary")
    own = dict(rows)
    for family in ("clips", "spread", "stream"):
        got = bake.choose(df, bake.Corpus(family, cap=9), 8).orderBy("number").collect()
        assert [r.number for r in got] == list(range(9))
        assert all(bytes(r.payload) == bytes(own[r.name][7 * r.chunk : 7 * r.chunk + 7]) for r in got)
    assert windows.window_of(8) == 7


def test_sound_is_decimated_and_quantized(spark):
    x = (8000 * np.sin(np.arange(800) * 0.05)).astype(int)
    df = spark.createDataFrame([("a", wav(x, 16_000))], "name string, raw binary")
    plain, half = (bytes(bake.pcm_clips(df, 16_000, down, 41).first().raw) for down in (1, 2))
    assert plain == bytes(((x >> 8) + 128).astype(np.uint8).tolist()) and len(half) == 400
    assert np.abs(np.frombuffer(half, np.uint8).astype(int)[30:-30] - np.frombuffer(plain, np.uint8).astype(int)[::2][30:-30]).max() <= 1
    with pytest.raises(Exception, match="rate"):
        bake.pcm_clips(df, 8000).collect()


def test_corpus_names(tmp_path):
    folder = tmp_path / "c256"
    folder.mkdir()
    for n in ("b", "a"):
        (folder / f"{n}.jsonl").write_text("")
    other = tmp_path / "a.jsonl"
    other.write_text("")
    at = lambda n: (n, str(folder / f"{n}.jsonl"))
    assert bake.resolve_corpora("", str(tmp_path), 256) == [at("a"), at("b")]
    assert bake.resolve_corpora(f"b, {other},a", str(tmp_path), 256) == [at("b"), ("a", str(other))]
    for names, context in (("c", 256), ("", 512), (str(tmp_path / "z.jsonl"), 256)):
        with pytest.raises(FileNotFoundError):
            bake.resolve_corpora(names, str(tmp_path), context)


def test_arithmetic_draws(spark):
    g = np.random.default_rng(0)
    starts, steps = g.integers(0, 256, 5, dtype=np.uint8), g.integers(0, 256, 5, dtype=np.uint8)
    got = bake.arithmetic(spark, 5, 9).orderBy("number").collect()
    for r, a, b in zip(got, starts.tolist(), steps.tolist()):
        assert bytes(r.payload) == bytes((a + b * j) % 256 for j in range(9))
