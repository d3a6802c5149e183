"""Kernels against brute force, and sources against files made on the spot."""

import gzip
import hashlib
import io
import json
import math
import struct
import tarfile
import wave
import zipfile

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import streaming
from tessera.functions import signal, text
from tessera.operators import curves, detect, export, frontier, probes, programs, results, scoring, windows
from tessera.plans import catalog
from tessera.sources import archives, tables


def test_machine(spark):
    code = lambda c, **k: programs.execute(c, np.random.default_rng(0), **({"max_steps": 10_000, "tape_length": 16, "output_length": 8} | k))
    assert code(b"+[.++]") == (bytes([1, 3, 5, 7, 9, 11, 13, 15]), 2 + 8 * 4 - 3)
    assert code(b"<-.") == (b"\xff", 3) and code(b"]][.") == (b"\0", 4) and code(b"xyz") == (b"", 3)
    assert code(b"+[]", max_steps=50)[1] == 50
    wide = code(b"-.", modulus=1000)
    assert wide == ((999).to_bytes(8, "little"), 2)
    assert code(b"++++++", max_steps=4)[1] == 4 and code(b"+>+<[->]<.", max_steps=100) == (b"\0", 13)
    draws = np.random.default_rng(0)
    assert code(b",.,.")[0] == bytes(int(draws.integers(0, 1 << 32, dtype=np.uint32)) % 256 for _ in range(2))
    got = programs.run(spark.createDataFrame([(0, bytearray(b"SX.F+.")), (1, bytearray(b"S\xff+.")), (2, bytearray(b""))], "id long, program binary")).collect()
    assert [(r.code, bytes(r.output)) for r in sorted(got, key=lambda r: r.id)] == [("[-]" + "+" * 16 + ".", b"\x10"), ("+.", b"\x01"), ("", b"")]
    row = programs.training_rows(programs.run(spark.createDataFrame([(0, bytearray(b"S+."))], "id long, program binary"))).first()
    assert bytes(row.row) == b"O\x01" + bytes(4094)


def names_of(x):
    return [(h["family"], h["start_offset"]) for h in detect.classify(np.array(x))]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 255), st.integers(0, 127), st.integers(1, 255))
def test_polynomial_families(start, odd, lead):
    """Tapes of each degree, their coefficients drawn; a polynomial of a lower degree isn't one of a higher."""
    n = np.arange(600)
    step = 2 * odd + 1
    assert names_of((start + step * n) % 256) == [("arithmetic", 0)]
    assert names_of((start + step * n + (2 * lead + 1) * n * (n - 1) // 2) % 256)[0][0] == "quadratic"
    cubic = names_of((start + step * n + (2 * lead + 1) * n * (n - 1) * (n - 2) // 6) % 256)
    assert cubic and cubic[0][0] == "cubic"


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 255), st.integers(0, 127), st.integers(1, 24))
def test_recurrences_and_noise_before_a_tape(first, odd, noise):
    fib, geo = [first, 2 * odd + 1], [2 * odd + 1]
    for _ in range(998):
        fib.append((fib[-1] + fib[-2]) % 256)
        geo.append(geo[-1] * 11 % 256)
    assert ("fibonacci", 0) in names_of(fib) and "geometric" in {f for f, _ in names_of(geo)}
    rng = np.random.default_rng(noise)
    tape = (23 * np.arange(900) + first) % 256
    before = rng.integers(0, 256, noise)
    before[-1] = (tape[0] - 23 + 1 + odd) % 256  # breaks the progression where it begins
    assert names_of(np.concatenate((before, tape))) == [("arithmetic", noise)]


def test_tapes_without_a_family():
    n = np.arange(4095)
    for x in (np.zeros(4095, int), np.random.default_rng(5).integers(0, 256, 4095), n * 128 % 256, (23 * n[:150] + 4) % 256):
        assert names_of(x) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=40))
def test_min_period(x):
    assert detect.min_period(np.array(x)) == next(p for p in range(1, len(x) + 1) if all(x[i] == x[i + p] for i in range(len(x) - p)))


def test_periods_of_rows_whose_sums_agree():
    """Halves of a Thue-Morse sequence of 2,048 have the same sum modulo 2^64, whatever the odd base."""
    morse = np.array([bin(i).count("1") % 2 for i in range(4096)])
    rows = np.stack((morse, np.tile([1, 2], 2048), np.arange(4096)))
    want = [next(p for p in range(1, 4097) if (x[p:] == x[: 4096 - p]).all()) for x in rows]
    assert detect.min_periods(rows).tolist() == want


def test_tapes_are_dealt_over_tasks(spark):
    t = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    assert catalog.tapes(t).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_scan_skips_what_cannot_be_read(spark):
    good = json.dumps([(3 * i + 1) % 256 for i in range(300)])
    df = spark.createDataFrame([(1, good), (2, "no"), (3, None), (4, "[1, null]")], "id long, tape string")
    assert [(r.id, r.family, json.loads(r.params)) for r in detect.scan(df).collect()] == [(1, "arithmetic", {"diffs": [3]})]


def test_orders_of_short_and_broken_tapes(spark):
    n = range(9)
    rows = [(0, []), (1, [5]), (2, [5, 7]), (3, [i * i for i in n]), (4, [i**3 % 256 for i in n]), (5, [i**4 % 256 for i in n]), (6, None), (7, [None] * 9), (8, [250, 4, 14])]
    got = detect.polynomial_orders(spark.createDataFrame(rows, "id long, tape array<int>")).collect()
    assert dict(map(tuple, got)) == {0: None, 1: None, 2: 1, 3: 2, 4: 3, 5: None, 6: None, 7: None, 8: 1}


def test_bytes_are_decoded_once(spark):
    df = spark.createDataFrame([(bytearray(range(256)),), (bytearray(),), (None,)], "raw binary").select(windows.bytes_of("raw").alias("v"))
    assert [r.v for r in df.collect()] == [list(range(256)), [], None]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert "decode" in plan.lower() and "decode" not in plan[plan.index("lambdafunction") :].lower()


def test_poisson_interval():
    for k, lo, hi in ((0, 0.0, 3.688879454), (1, 0.02531780798, 5.571643390), (10, 4.795389, 18.39036)):
        a, b = detect.poisson_interval(k)
        assert abs(a - lo) < 1e-5 and abs(b - hi) < 1e-5


def test_fits_recover_known_exponents(spark):
    c = np.geomspace(1e14, 1e19, 24)
    pts = spark.createDataFrame([(float(x), float(0.2 + 3 * (x / 1e15) ** -0.3), float(5 * x**-0.07)) for x in c], "C double, bpb double, pure double")
    f = frontier.floor_fit(pts).first()
    assert abs(f.alpha - 0.3) < 1e-4 and abs(f.floor - 0.2) < 1e-4 and abs(f.amplitude - 3) < 1e-3
    p = frontier.power_fit(pts, loss="pure").first()
    assert abs(p.alpha - 0.07) < 1e-9 and abs(p.amplitude - 5) < 1e-6 and p.log_rmse < 1e-6
    q = frontier.raw_power_fit(pts.select("C", (pts.pure * 1.0).alias("bpb")), lo=0.01, hi=0.2, steps=191).first()
    assert abs(q.alpha - 0.07) < 1e-3
    r = frontier.robust_floor_fit(c, 0.2 + 3 * (c / 1e15) ** -0.3)
    assert abs(r["alpha"] - 0.3) < 5e-3 and abs(r["floor"] - 0.2) < 1e-2 and r["rmse"] < 1e-3 and r["n_points"] == 24
    # a few points far off weigh little under Huber's loss on the losses themselves
    noisy = 0.2 + 3 * (c / 1e15) ** -0.3 + np.where(np.arange(24) % 11 == 5, 0.4, 0.0)
    assert abs(frontier.robust_floor_fit(c, noisy)["alpha"] - 0.3) < 0.03
    both = spark.createDataFrame([(g, float(x), float(0.2 * g + 3 * (x / 1e15) ** -0.3)) for g in (1, 2) for x in c] + [(3, 1e15, 1.0)], "g int, C double, bpb double")
    fits = {x.g: x for x in frontier.robust_floor_fits(both, "g").collect()}
    assert sorted(fits) == [1, 2] and abs(fits[2].floor - 0.4) < 1e-2 and fits[1].n_points == 24
    with pytest.raises(ValueError):
        frontier.robust_floor_fit(c[:4], c[:4])
    with pytest.raises(Exception, match="finite and positive"):
        frontier.pareto(spark.createDataFrame([(-1.0, 1.0)], "C double, bpb double")).collect()
    assert frontier.joint_exponent(0.3, 0.6) == pytest.approx(0.2)


def test_curves_equal_numpy(spark):
    rng = np.random.default_rng(11)
    y = [rng.random(70), rng.random(5), rng.random(1)]
    df = spark.createDataFrame([(c, i, float(v)) for c, z in enumerate(y) for i, v in enumerate(z)], "curve int, i int, y double")
    med, hann, area = (curves.median_filter(df).collect(), curves.hann_smooth(df).collect(), {r.curve: r.area for r in curves.robust_area(df).collect()})
    for c, z in enumerate(y):
        pad = np.pad(z, 16, mode="edge")
        m = np.array([np.median(pad[i : i + 33]) for i in range(len(z))])
        w = np.hanning(31) / np.hanning(31).sum()
        assert np.allclose([r.y for r in sorted((r for r in med if r.curve == c), key=lambda r: r.i)], m)
        assert np.allclose([r.y for r in sorted((r for r in hann if r.curve == c), key=lambda r: r.i)], np.convolve(np.pad(z, 15, mode="edge"), w, "valid"))
        env = np.minimum.accumulate(m)
        assert math.isclose(area[c], np.trapezoid(env - env[-1]), abs_tol=1e-9)


def test_ensembles_equal_brute_force(spark):
    p = np.random.default_rng(12).random((3, 20))
    df = spark.createDataFrame([(0, s, i, float(p[s, i])) for s in range(3) for i in range(20)], "corpus int, seed int, item int, p double")
    got = {r.K: r.bpb for r in scoring.per_k(df, 3, "corpus").collect()}
    from itertools import combinations

    for k in (1, 2, 3):
        assert got[k] == pytest.approx(np.mean([-np.log2(p[list(c)].mean(0)).mean() for c in combinations(range(3), k)]))
    assert len(scoring.subset_masks(8, 4)) == 32 and len(scoring.subset_masks(8, 2)) == 28
    assert all(m.bit_count() == 4 for m in scoring.subset_masks(8, 4))


def test_windows_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", bytearray(range(256)) * 2), ("b", bytearray(b"x")), ("c", bytearray())], "name string, raw binary")
    cut = windows.chunk(df, 100).withColumn("number", windows.F.monotonically_increasing_id())
    assert cut.count() == 5
    assert export.write_windows(windows.records(cut, "toy", 100), str(tmp_path / "w"), 100) == 5
    back = tables.window_jsonl(spark, str(tmp_path / "w")).orderBy("metadata.chunk_index").first()
    assert back.sequence == list(range(100)) and back.metadata.context_length == 101
    with pytest.raises(ValueError):
        windows.require_valid(spark.createDataFrame([("x", [1, 300])], "id string, sequence array<int>"), 2)
    with pytest.raises(ValueError):
        windows.require_valid(spark.createDataFrame([("x", [1])], "id string, sequence array<int>"), 2)
    with pytest.raises(ValueError):
        windows.window_of(1)
    with pytest.raises(ValueError):
        windows.require_suite(spark.createDataFrame([("a", 2), ("a", 2)], "name string, context_length int"))
    assert windows.parse_rounds("0:1024:512") == [0, 512, 1024] and windows.parse_rounds("1, 5") == [1, 5]
    with pytest.raises(Exception, match="repeated index"):
        windows.rechunk(spark.createDataFrame([(1, 0, bytearray(b"ab")), (1, 0, bytearray(b"cd"))], "stream int, chunk_index int, raw binary"), 2).collect()
    with pytest.raises(Exception, match="never ends"):
        spark.createDataFrame([("a $( b",)], "s string").select(text.strip_comments("s")).collect()
    assert spark.createDataFrame([("a  $( b\n c $) d\n\n e ",)], "s string").select(text.strip_comments("s")).first()[0] == "a d\ne"


def test_archives(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("dir/./a.txt", "alpha")
    (tmp_path / "a.zip").write_bytes(z.getvalue())
    members = archives.zip_members(archives.binary_files(spark, str(tmp_path / "a.zip")))
    assert [(r.name, bytes(r.raw)) for r in members.collect()] == [("dir/a.txt", b"alpha")]
    pin = hashlib.sha256(b"alpha").hexdigest()
    assert bytes(archives.verified_prefix(members, 5, pin, 3).first().raw) == b"alp"
    with pytest.raises(Exception, match="not as pinned"):
        archives.verified_prefix(members, 5, "0" * 64, 3).collect()
    with pytest.raises(ValueError):
        archives.safe_name("../x")
    w = io.BytesIO()
    with wave.open(w, "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(8000)
        f.writeframes(np.array([0, -32768, 32767], "<i2").tobytes())
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        info = tarfile.TarInfo("x.wav")
        info.size = len(w.getvalue())
        f.addfile(info, io.BytesIO(w.getvalue()))
    (tmp_path / "a.tar.gz").write_bytes(t.getvalue())
    r = archives.tar_members(archives.binary_files(spark, str(tmp_path / "a.tar.gz")), ".wav").first()
    assert signal.pcm16_to_pcm8(archives.pcm16_wav(bytes(r.raw), 8000)) == bytes([128, 0, 255])
    body = np.array([0.5, -1], "<f4").tobytes()
    riff = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 1, 8000, 32000, 4, 32) + b"data" + struct.pack("<I", len(body)) + body
    assert archives.float32_wav(b"RIFF" + struct.pack("<I", len(riff)) + riff).tolist() == [0.5, -1.0]
    whole = b"RIFF" + struct.pack("<I", len(riff)) + riff
    for raw, rate in ((whole[:-3], None), (whole, 16_000), (b"RIFX" + whole[4:], None)):
        with pytest.raises(ValueError):
            archives.float32_wav(raw, rate)
    assert archives.float32_wav(whole, 8000).tolist() == [0.5, -1.0]
    (tmp_path / "d.jsonl.gz").write_bytes(gzip.compress(b'{"text": "\xc3\xa9"}\n\n{"text": "b"}\n'))
    assert [bytes(r.raw) for r in archives.jsonl_documents(archives.binary_files(spark, str(tmp_path / "d.jsonl.gz"))).collect()] == ["é".encode(), b"b"]
    (tmp_path / "c.bin").write_bytes(bytes([7, *range(6), 9, *range(6, 12)]))
    got = archives.cifar_records(archives.binary_files(spark, str(tmp_path / "c.bin")), 6).orderBy("record").collect()
    assert [(r.label, list(r.pixels)) for r in got] == [(7, list(range(6))), (9, list(range(6, 12)))]
    (tmp_path / "e.bin").write_bytes(bytes(13))
    with pytest.raises(Exception, match="no whole records"):
        archives.cifar_records(archives.binary_files(spark, str(tmp_path / "e.bin")), 6).collect()
    track = bytes([0, 0x90, 60, 64, 10, 62, 64, 10, 0x80, 60, 0, 0, 62, 0, 0, 62, 0, 0, 0xFF, 0x2F, 0])
    midi = b"MThd" + struct.pack(">IHHH", 6, 0, 1, 480) + b"MTrk" + struct.pack(">I", len(track)) + track
    assert archives.midi_notes(midi, 0) == ([(60, 0, 20, 0), (62, 10, 20, 1)], 1)
    np.savez(tmp_path / "p.npz", **{"dclm/3": np.array([[0.5, 0.25]], np.float32)})
    back = archives.npz_long(spark, str(tmp_path / "p.npz"))
    assert np.load(io.BytesIO(export.npz_bytes(back)))["dclm/3"].tolist() == [[0.5, 0.25]]


def test_filters():
    x = np.sin(np.arange(101) * 0.05)
    taps = signal.lowpass(4, 81)
    y = signal.decimate(x, taps, 4)
    pad = np.pad(x, 40)
    assert len(y) == 26 and np.allclose(y, [(pad[i : i + 81] * taps[::-1]).sum() for i in range(0, 101, 4)])


def test_trajectory_round_trip_and_tables(spark, tmp_path):
    rows = [("b", 10, 256, "x", 1, 2.5, 3), ("b", 10, 1024, "x", 1, 2.25, 3), ("b", 10, 1024, "y", 2, 1.5, 4), ("a", 5, 512, "x", 1, 3.0, 3)]
    traj = spark.createDataFrame(rows, tables.FRONTIER_SCHEMA)
    flat = export.trajectory_flat(export.trajectory_json(traj))
    assert [(r.rung, r["round"], r.corpus, r.K, r.bpb) for r in flat.collect()] == sorted((r[0], r[2], r[3], r[4], r[5]) for r in rows)
    assert export.append_new_slices(traj.select("rung", "round", "bpb"), str(tmp_path / "s")).count() == 4
    export.append_new_slices(traj.select("rung", "round", "bpb"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4
    wide = spark.createDataFrame([("b", 1.004, 1.0), ("A", 2.0, None)], "corpus string, p double, q double")
    assert export.latex_rows(wide, "corpus", ["p", "q"]) == [r"A & \textbf{2.00} & -- \\", r"b & \textbf{1.00} & \textbf{1.00} \\"]
    traj.coalesce(1).write.option("header", True).csv(str(tmp_path / "c"))
    assert tables.frontier_csv(spark, str(tmp_path / "c")).count() == 4
    export.catalog_tsv(spark.createDataFrame([(0, bytearray(b"ab")), (1, bytearray(b"c"))], "piece int, raw binary"), str(tmp_path / "t"))
    assert [r.offset for r in spark.read.option("sep", "\t").csv(str(tmp_path / "t"), header=True).orderBy("piece").collect()] == ["0", "2"]


def test_slice_stream_is_incremental(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    one = lambda n, r: (src / f"{n}.json").write_text(json.dumps({"rung": "1M", "N": 5, "round": r, "n_seeds": 3, "bpb": {"x": {"1": 2.0, "2": 1.5}}}))
    for n, r in (("a", 256), ("b", 512)):
        one(n, r)
        streaming.ingest(streaming.slice_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    one("c", 512)
    streaming.ingest(streaming.slice_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert tables.score_slices(spark, str(src)).count() == 6


def test_small_sources(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("[1, 130]\n[0]\n")
    assert [r.sequence for r in tables.melody_jsonl(spark, str(tmp_path / "m.jsonl")).collect()] == [[1, 130], [0]]
    (tmp_path / "bad.jsonl").write_text("[131]\n")
    with pytest.raises(Exception, match="not a melody row"):
        tables.melody_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    paths = spark.createDataFrame([("g/t/0/learner_256.pth",), ("g/t/1/learner_256.pth",), ("g/t/readme",)], "path string")
    assert tables.checkpoint_index(paths).first().paths == {"0": "g/t/0/learner_256.pth", "1": "g/t/1/learner_256.pth"}
    lines = spark.createDataFrame([(0, "x/shard_01/b"), (1, "x/shard_01/a"), (2, "x/shard_02/c")], "line_no int, path string")
    assert {r.shard: r.path for r in tables.first_path_per_shard(lines).collect()} == {1: "x/shard_01/b", 2: "x/shard_02/c"}


def test_prompts(spark):
    demos = probes.demo_table(spark, 3, 2, trials=4)
    rows = {(r.trial, r.demo): r.x for r in demos.collect()}
    for r in probes.prompts(demos, "sum").collect():
        want = [79]
        for d in range(3):
            x = rows[r.trial, d]
            want += [0, *x, sum(x) % 256]
        assert r.prompt == [*want, 0, *rows[r.trial, 3]] and r.answer == sum(rows[r.trial, 3]) % 256
    assert probes.prompts(demos, "max", delimiter=None, context=5).count() == 0
    for r in probes.stack_trace(spark, 12, 5).collect():
        s = []
        for o in r.ops[:-1]:
            s = s[:-1] if o == 0 else [*s, o]
        assert r.answer == s[-1]


def test_blocks_of_curves_equal_one_block(spark):
    rng = np.random.default_rng(8)
    rows = [(c, i, float(v)) for c, n in enumerate((1, 2, 16, 17, 64, 200)) for i, v in enumerate(rng.normal(size=n))]
    rows += [(9, i, None if i % 7 == 3 else float(i % 5)) for i in range(90)] + [(None, i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "curve int, i int, y double")
    plain = lambda x: {(r[0], r[1]): None if r[2] is None else round(r[2], 9) for r in x.select("curve", "i", "y").collect()}
    for f in (curves.median_filter, curves.hann_smooth):
        whole = plain(f(df))
        assert len(whole) == len(rows) and whole == plain(f(df, block=16)) == plain(f(df, block=64))
    area = lambda **k: {r.curve: round(r.area, 9) for r in curves.robust_area(df, **k).collect()}
    assert area() == area(block=16) and area()[0] == 0 and area()[None] == 0
    with pytest.raises(ValueError, match="block"):
        curves.median_filter(df, block=8)
    assert curves.median_filter(df.where("false")).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.binary(max_size=12), min_size=1, max_size=12), st.integers(1, 9))
def test_streams_are_cut_as_if_joined(spark, pieces, window):
    df = spark.createDataFrame([(s, 3 * i, bytearray(p)) for s in (1, None) for i, p in enumerate(pieces)] + [(2, 0, None)], "stream int, chunk_index int, raw binary")
    joined = b"".join(pieces)
    want = [joined[i : i + window] for i in range(0, len(joined) - window + 1, window)]
    for block in (1 << 12, 6):
        got = windows.cut(windows.placed(df, "stream", "chunk_index", block=block, unique=True), "stream", window).collect()
        for s in (1, None):
            assert [bytes(r.payload) for r in sorted((r for r in got if r.stream == s), key=lambda r: r.idx)] == want
        assert len(got) == 2 * len(want)


def test_stream_key_takes_the_first_there(spark):
    df = spark.createDataFrame([(1, ("f", "s", None)), (2, (None, "s", "0")), (3, (None, None, None))], "id int, metadata struct<original_file:string, subset:string, global_shard:string>")
    assert [r.k for r in df.select("id", windows.stream_key().alias("k")).orderBy("id").collect()] == ["original_file=f", "subset=s", None]


def test_association_and_nested_prompts(spark):
    made = probes.associations(spark, 4, 9, 3, np.random.default_rng(4))
    each = {t: [r for r in made.orderBy("demo").collect() if r.trial == t] for t in range(3)}
    for rows in each.values():
        seen = {r.x[0]: r.answer for r in rows[:4]}
        assert len(rows) == 10 and len(seen) == 4 and all(seen[r.x[0]] == r.answer for r in rows)
    got = {r.trial: r for r in probes.prompts(made, None).collect()}
    for t, rows in each.items():
        assert got[t].prompt == [79, *(v for r in rows[:-1] for v in (0, *r.x, r.answer)), 0, *rows[-1].x] and got[t].answer == rows[-1].answer
    with pytest.raises(ValueError, match="at least once"):
        probes.associations(spark, 4, 3, 1, np.random.default_rng(0))
    table = probes.demo_table(spark, 6, 2, trials=3, seed=1)
    nested = probes.prompts(probes.nested_demos(table.where("demo < 6"), table.where("demo = 6"), [0, 2, 5]), "sum", by=("size", "trial")).collect()
    by = {(r["size"], r.trial): r for r in nested}
    assert len(by) == 9 and all(len(by[m, 0].prompt) == 1 + 4 * m + 3 for m in (0, 2, 5))
    assert by[5, 1].prompt[:9] == by[2, 1].prompt[:9] and by[5, 1].answer == by[0, 1].answer


def test_softmax_of_large_logits(spark):
    x = np.random.default_rng(0).normal(size=16) * 900
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    want = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    r = df.select(probes.softmax("x").alias("p"), probes.log_probability("x", F.lit(3)).alias("l")).first()
    assert np.allclose(r.p, want) and math.isclose(r.l, x[3] - x.max() - math.log(np.exp(x - x.max()).sum()))


def test_midi_files_as_a_table(spark):
    body = b"\x00\x90\x3c\x40" + b"\x60\x80\x3c\x00" + b"\x00\x90\x40\x40" + b"\x81\x40\x80\x40\x00" + b"\x00\xff\x2f\x00"
    file = lambda division, b: bytearray(b"MThd" + struct.pack(">IHHH", 6, 0, 1, division) + b"MTrk" + struct.pack(">I", len(b)) + b)
    df = lambda *a: spark.createDataFrame([("a.mid", file(*a))], "path string, content binary")
    got = archives.midi_table(df(96, body), 0).orderBy("nid").collect()
    assert [tuple(r) for r in got] == [("a.mid", 96, 0, 60, 0, 96, 0), ("a.mid", 96, 1, 64, 96, 288, 0)]
    for bad in (df(0xE728, body), df(96, body[-4:])):
        with pytest.raises(Exception, match="quarter|no note"):
            archives.midi_table(bad, 0).collect()


def test_pins_joins_and_manifests(spark):
    raw = b"some member"
    members = spark.createDataFrame([("m", bytearray(raw))], "name string, raw binary")
    ok = archives.verified_prefix(members, len(raw), None, 4, md5=hashlib.md5(raw).hexdigest(), sha1=hashlib.sha1(raw).hexdigest())
    assert bytes(ok.first().raw) == b"some"
    with pytest.raises(Exception, match="not as pinned"):
        archives.verified_prefix(members, len(raw), None, 4, sha1=hashlib.sha1(b"x").hexdigest()).collect()
    clips = [("b", b"2"), ("a", b"1"), ("é", b"3")]
    assert archives.table_fingerprint(spark.createDataFrame([(n, bytearray(f)) for n, f in clips], "name string, frames binary")) == archives.content_fingerprint(clips)
    left, right = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int")
    assert results.strict_join(left.where("k = 'a'"), right, "k").first().v == 1
    with pytest.raises(Exception, match="no row for k b"):
        results.strict_join(left, right, "k").collect()
    lines = spark.createDataFrame([(0, "x/shard_01/a"), (1, "x/shard_00/b"), (2, "x/shard_01/c")], "line_no int, path string")
    assert [r.path for r in tables.first_path_per_shard(lines, 2).orderBy("shard").collect()] == ["x/shard_00/b", "x/shard_01/a"]
    with pytest.raises(Exception, match="no path of shard 2"):
        tables.first_path_per_shard(lines, 3).collect()
