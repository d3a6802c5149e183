"""Sinks: baked windows, score slices, trajectories, tables for papers."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.windows import require_valid
from tessera.sources.tables import window_jsonl


def write_windows(records: DataFrame, path: str, window: int, overwrite: bool = False) -> int:
    """Write baked records as JSON lines, read them again, check them; their number."""
    records.write.mode("overwrite" if overwrite else "errorifexists").json(path)
    again = window_jsonl(records.sparkSession, path)
    require_valid(again.select("id", "sequence"), window)
    return again.count()


def append_new_slices(slices: DataFrame, path: str, keys: tuple = ("rung", "round")) -> DataFrame:
    """Append the slices whose keys aren't at ``path`` yet; what was appended."""
    spark = slices.sparkSession
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        slices = slices.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")
    slices.write.mode("append").parquet(path)
    return slices


def trajectory_json(traj: DataFrame) -> DataFrame:
    """A row for each rung: its rounds, corpora and losses by K as one JSON text."""
    by_k = traj.groupBy("rung", "N", "round", "corpus").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("K").cast("string"), "bpb")))).alias("m"), F.max("n_seeds").alias("n_seeds"))
    by_round = by_k.groupBy("rung", "N", "round").agg(F.map_from_entries(F.collect_list(F.struct("corpus", "m"))).alias("corpora"), F.max("n_seeds").alias("n_seeds"))
    rounds = by_round.groupBy("rung", "N").agg(F.map_from_entries(F.collect_list(F.struct(F.col("round").cast("string"), F.struct("n_seeds", "corpora")))).alias("rounds"))
    return rounds.select("rung", F.to_json(F.struct("N", "rounds")).alias("json"))


def trajectory_flat(nested: DataFrame) -> DataFrame:
    """The inverse of :func:`trajectory_json`, sorted by rung and by round as a number."""
    schema = "N bigint, rounds map<string,struct<n_seeds:int,corpora:map<string,map<string,double>>>>"
    rows = nested.select("rung", F.from_json("json", schema).alias("j"))
    rows = rows.select("rung", "j.N", F.explode("j.rounds").alias("round", "r"))
    rows = rows.select("rung", "N", F.col("round").cast("int").alias("round"), "r.n_seeds", F.explode("r.corpora").alias("corpus", "m"))
    return rows.select("rung", "N", "round", "corpus", F.explode("m").alias("K", "bpb"), "n_seeds").withColumn("K", F.col("K").cast("int")).orderBy("rung", "round", "corpus", "K")


def latex_rows(wide: DataFrame, label: str, columns: list[str], places: int = 2) -> list[str]:
    """Table rows in order of the label; the least value of each row, after rounding, in bold."""
    out = []
    for r in wide.orderBy(F.lower(label)).collect():
        values = [None if r[c] is None else round(r[c], places) for c in columns]
        least = min((v for v in values if v is not None), default=None)
        cells = ["--" if v is None else f"\\textbf{{{v:.{places}f}}}" if v == least else f"{v:.{places}f}" for v in values]
        out.append(" & ".join([str(r[label]), *cells]) + r" \\")
    return out


def catalog_tsv(pieces: DataFrame, path: str) -> None:
    """Pieces ``piece, raw`` with their byte offsets in the stream, tab-separated."""
    from pyspark.sql import Window

    size = F.octet_length("raw").cast("long")
    before = F.sum("size").over(Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    sized = pieces.select("piece", size.alias("size"), F.sha2("raw", 256).alias("sha256"))
    sized.withColumn("offset", F.coalesce(before, F.lit(0))).select("piece", "offset", "size", "sha256").write.option("sep", "\t").option("header", True).csv(path)


def npz_bytes(probs: DataFrame) -> bytes:
    """``corpus, seed, seq_id, p`` as an NPZ file with a matrix for each ``corpus/seed``."""
    rows = probs.orderBy("corpus", "seed", "seq_id").collect()
    arrays: dict[str, list] = {}
    for r in rows:
        arrays.setdefault(f"{r.corpus}/{r.seed}", []).append(r.p)
    out = io.BytesIO()
    np.savez_compressed(out, **{k: np.array(v, np.float32) for k, v in arrays.items()})
    return out.getvalue()
