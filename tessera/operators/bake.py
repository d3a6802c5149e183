"""Corpora: from source bytes to baked records, by name.

A corpus is a family and its parameters. A source table has ``name`` and ``raw`` (bytes), and
for shards ``shard, doc_id, raw``. Families: *shards* (documents of a shard joined, a quota of
windows from each), *stream* (all windows of each file, or the first ``cap``), *clips* (round
robin over clips from a start drawn by their digest), *spread* (the same, evenly spaced over
each clip), *generated*."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import signal, text
from tessera.operators import windows
from tessera.sources import archives

CAP = 8192


def pcm_clips(files: DataFrame, rate: int, down: int = 1, taps: int = 81, floats: bool = False) -> DataFrame:
    """WAV members ``name, raw`` to unsigned 8-bit clips ``name, raw``, decimated by ``down``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in b.column(1).to_pylist():
                x = archives.float32_wav(raw, rate) * 32768.0 if floats else archives.pcm16_wav(raw, rate)
                if down == 1 and not floats:
                    out.append(signal.pcm16_to_pcm8(x))
                else:
                    y = signal.decimate(x, signal.lowpass(down, taps), down) if down > 1 else x
                    out.append(np.floor((np.clip(y, -32768.0, 32767.0) + 32768.0) / 256.0).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["name", "raw"])

    return files.select("name", "raw").mapInArrow(run, "name string, raw binary")


def _plain(df: DataFrame) -> DataFrame:
    return df


def _without_comments(df: DataFrame) -> DataFrame:
    return df.withColumn("raw", text.strip_comments("text").cast("binary"))


def _interleaved(df: DataFrame) -> DataFrame:
    """Planar pixel records to one value of each channel in turn."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.frombuffer(x, np.uint8).reshape(3, -1).T.tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["name", "raw"])

    return df.select("name", "raw").mapInArrow(run, "name string, raw binary")


@dataclass(frozen=True)
class Corpus:
    """How a corpus is baked."""

    family: str
    transform: Callable[[DataFrame], DataFrame] = _plain
    cap: int | None = CAP
    shards: int = 10


#: Every corpus by its stem.
CORPORA = {
    "dclm": Corpus("shards"),
    "arithmetic": Corpus("generated"),
    "kolmogorov_text": Corpus("stream", cap=None),
    "kolmogorov_dna": Corpus("stream", cap=None),
    **{f"aitdcc_{m}": Corpus("stream", cap=None) for m in ("a_protein", "b_c_source", "d_glibc_rand", "e_atlas_float32", "g_astronomy")},
    "metamath": Corpus("stream", _without_comments, cap=None),
    "cifar10_rgb_planar": Corpus("stream"),
    "cifar10_rgb_hwc": Corpus("stream", _interleaved),
    **{f"llm_compression_{m}": Corpus("clips") for m in ("python", "cc", "arxiv_math")},
    "speech_commands_pcm8": Corpus("clips", lambda df: pcm_clips(df, 16_000)),
    "speech_commands_pcm8_4khz": Corpus("clips", lambda df: pcm_clips(df, 16_000, 4)),
    "speech_commands_pcm8_8khz": Corpus("clips", lambda df: pcm_clips(df, 16_000, 2, 41)),
    "esc50_pcm8": Corpus("clips", lambda df: pcm_clips(df, 44_100)),
    "esc50_pcm8_11khz": Corpus("clips", lambda df: pcm_clips(df, 44_100, 4)),
    "musicnet_pcm8": Corpus("spread", lambda df: pcm_clips(df, 44_100, floats=True)),
    "musicnet_pcm8_11khz": Corpus("spread", lambda df: pcm_clips(df, 44_100, 4, floats=True)),
    "mutopia": Corpus("spread"),
}


def _stream(df: DataFrame, window: int, cap: int | None) -> DataFrame:
    """Windows of files in the order of their names, numbered through."""
    sizes = df.select("name", F.expr(f"octet_length(raw) div {window}").alias("n"))
    before = F.sum("n").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    cut = windows.chunk(df.select("name", "raw"), window).join(sizes.select("name", F.coalesce(before, F.lit(0)).alias("before")), "name")
    numbered = cut.withColumn("number", F.col("before") + F.col("idx"))
    return windows.first_n(numbered, cap, "number").select("number", "name", F.col("idx").alias("chunk"), "payload")


def _picked(df: DataFrame, picks: DataFrame, window: int) -> DataFrame:
    return picks.join(df.select("name", "raw"), "name").select("number", "name", "chunk", F.expr(f"substring(raw, cast(chunk * {window} + 1 as int), {window})").alias("payload"))


def choose(source: DataFrame, corpus: Corpus, context_length: int) -> DataFrame:
    """``number, name, chunk, payload``: the windows of a corpus."""
    window = windows.window_of(context_length)
    df = corpus.transform(source)
    if corpus.family == "shards":
        cut = windows.shard_bake(df, window, corpus.cap, corpus.shards)
        before = sum((F.when(F.col("shard") > i, windows.quota(corpus.cap, corpus.shards, F.lit(i))).otherwise(0) for i in range(corpus.shards)), F.lit(0))
        return cut.select((before + F.col("idx")).alias("number"), F.col("shard").cast("string").alias("name"), F.col("idx").alias("chunk"), "payload")
    if corpus.family == "stream":
        return _stream(df, window, corpus.cap)
    if corpus.family == "clips":
        return _picked(df, windows.balanced_cap(df, window, corpus.cap), window)
    if corpus.family == "spread":
        return _picked(df, windows.spread_cap(df, window, corpus.cap), window)
    raise ValueError(f"unknown family {corpus.family}")


def arithmetic(spark: SparkSession, n: int, window: int, seed: int = 0) -> DataFrame:
    """``number, start, step, payload``: progressions modulo 256 whose starts and steps are drawn
    by NumPy's generator on the driver, as bytes: all starts, then all steps."""
    generator = np.random.default_rng(seed)
    starts, steps = (generator.integers(0, 256, n, dtype=np.uint8).tolist() for _ in range(2))
    rows = spark.createDataFrame(list(zip(range(n), starts, steps)), "number long, start long, step long")
    return rows.withColumn("payload", F.expr(f"unhex(array_join(transform(sequence(0, {window - 1}), j -> lpad(hex((start + step * j) % 256), 2, '0')), ''))"))


def bake(source: DataFrame, stem: str, context_length: int) -> DataFrame:
    """The baked records of a named corpus."""
    if stem not in CORPORA:
        raise ValueError(f"unknown corpus {stem}; known: {', '.join(sorted(CORPORA))}")
    window = windows.window_of(context_length)
    corpus = CORPORA[stem]
    chosen = arithmetic(source.sparkSession, corpus.cap, window) if corpus.family == "generated" else choose(source, corpus, context_length)
    return windows.records(chosen.select("payload", "number", F.col("number").alias("idx")), stem, window)


def baked_path(folder: str, context_length: int, stem: str) -> str:
    return f"{folder}/c{context_length}/{stem}.jsonl"


def bake_command(stem: str, context_length: int, path: str) -> str:
    """What to run where a corpus isn't there."""
    return f"python -m tessera.operators.bake {stem} --context-length {context_length} --output {path}"


def resolve_corpora(names: str, folder: str, context_length: int) -> list[tuple[str, str]]:
    """``a,b,/path/c.jsonl``, or all corpora of the context's folder where no name is given, as
    (name, path); the first of a name counts. What isn't there, or an empty choice, is an error."""
    found: dict[str, str] = {}
    for item in [x.strip() for x in (names or "").split(",") if x.strip()]:
        whole = "/" in item or item.endswith(".jsonl")
        name, path = (Path(item).stem, item) if whole else (item, baked_path(folder, context_length, item))
        if not Path(path).exists():
            raise FileNotFoundError(f"no corpus at {path}; bake it: {bake_command(name, context_length, path)}")
        found.setdefault(name, path)
    if not (names or "").strip():
        found = {p.stem: str(p) for p in sorted(Path(folder, f"c{context_length}").glob("*.jsonl"))}
    if not found:
        raise FileNotFoundError(f"no corpora for a context of {context_length} in {folder}")
    return list(found.items())
