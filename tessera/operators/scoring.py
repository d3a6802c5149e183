"""Scores of windows: byte n-gram models, bits a byte, ensembles of every size."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The context of a window's first byte: the tag of outputs.
FIRST = 79


def pair_counts(docs: DataFrame, window: int, *by: str, raw: str = "raw") -> DataFrame:
    """``by…, prev, byte, n`` over whole windows of each row's bytes. A task adds up its
    own pairs before anything is shuffled: at most 65,536 rows for each group and task."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in by)

    def run(batches):
        counts: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, content in zip(*(c.to_pylist() for c in b.columns)):
                n = len(content or b"") // window
                if not n:
                    continue
                x = np.frombuffer(content, np.uint8, n * window).reshape(n, window).astype(np.int64)
                prev = np.concatenate((np.full((n, 1), FIRST), x[:, :-1]), axis=1)
                c = counts.setdefault(tuple(key), np.zeros(1 << 16, np.int64))
                c += np.bincount((prev * 256 + x).ravel(), minlength=1 << 16)
        for key, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([*(pa.array([k] * len(at)) for k in key), pa.array(at // 256, pa.int32()), pa.array(at % 256, pa.int32()), pa.array(c[at])], [*by, "prev", "byte", "n"])

    sent = docs.select(*by, raw).mapInArrow(run, (schema + ", " if schema else "") + "prev int, byte int, n long")
    return sent.groupBy(*by, "prev", "byte").agg(F.sum("n").alias("n"))


def bigram_bits(train: DataFrame, test: DataFrame, *by: str, alpha: float = 0.5) -> DataFrame:
    """Mean bits a byte of test pairs under a bigram model of the training pairs with
    add-``alpha`` smoothing, for each group of ``by``. Both are :func:`pair_counts`, so at
    most 65,536 rows each for a group."""
    model = train.groupBy("prev", "byte").agg(F.sum("n").alias("pair"))
    context = train.groupBy("prev").agg(F.sum("n").alias("total"))
    seen = test.groupBy(*by, "prev", "byte").agg(F.sum("n").alias("n"))
    scored = seen.join(F.broadcast(model), ["prev", "byte"], "left").join(F.broadcast(context), "prev", "left")
    p = (F.coalesce("pair", F.lit(0)) + alpha) / (F.coalesce("total", F.lit(0)) + 256 * alpha)
    return scored.groupBy(*by).agg((F.sum(F.col("n") * -F.log2(p)) / F.sum("n")).alias("bpb"), F.sum("n").alias("n_bytes"))


def bits_per_byte(probs: DataFrame, *by: str, p: str = "p") -> DataFrame:
    """Mean of -log2(max(p, 1e-30)) over rows of single probabilities."""
    return probs.groupBy(*by).agg(F.avg(-F.log2(F.greatest(F.col(p).cast("double"), F.lit(1e-30)))).alias("bpb"))


def loss_sums(losses: DataFrame, *by: str) -> DataFrame:
    """Rows ``ce`` (mean nats of a sequence) and ``length``: mean loss of sequences, of
    tokens, and bits a byte."""
    token = F.sum(F.col("ce") * F.col("length")) / F.sum("length")
    return losses.groupBy(*by).agg(F.avg("ce").alias("seq_ce"), token.alias("loss"), (token / F.log(F.lit(2.0))).alias("bpb"), F.count("*").alias("n_seqs"))


def masked_mean(tokens: DataFrame, *by: str) -> DataFrame:
    """Rows ``pos, ce, length``: mean over the positions before ``length``; 0 if there are none."""
    inside = F.col("pos") < F.col("length")
    return tokens.groupBy(*by).agg((F.sum(F.when(inside, F.col("ce")).otherwise(0.0)) / F.greatest(F.count_if(inside), F.lit(1))).alias("mean_ce"))


def subset_masks(seeds: int, size: int, most: int = 32, rng: np.random.Generator | None = None) -> list[int]:
    """Bit masks of the ensembles of ``size`` seeds: all, if at most ``most``; else that many
    draws, each without replacement."""
    if comb(seeds, size) <= most:
        return [sum(1 << i for i in c) for c in combinations(range(seeds), size)]
    rng = rng or np.random.default_rng(0)
    return [sum(1 << int(i) for i in rng.choice(seeds, size, replace=False)) for _ in range(most)]


def ensemble_bits(probs: DataFrame, masks: DataFrame, *by: str) -> DataFrame:
    """``by…, mask, bpb``: rows ``by…, seed, item, p``; an ensemble averages its seeds'
    probabilities, and only then takes logarithms. Items are grouped with all their seeds
    first, so the masks (few, and broadcast) need no shuffle of their own."""
    items = probs.groupBy(*by, "item").agg(F.map_from_entries(F.collect_list(F.struct("seed", F.col("p").cast("double")))).alias("ps"))
    each = items.crossJoin(F.broadcast(masks))
    members = F.expr("filter(array_sort(map_keys(ps)), s -> (mask & shiftleft(1, cast(s as int))) <> 0)")
    p = F.expr("aggregate(members, 0D, (a, s) -> a + ps[s]) / size(members)")
    scored = each.withColumn("members", members).where("size(members) > 0").withColumn("p", p)
    return scored.groupBy(*by, "mask").agg(F.avg(-F.log2(F.greatest("p", F.lit(1e-30)))).alias("bpb"))


def per_k(probs: DataFrame, seeds: int, *by: str, most: int = 32) -> DataFrame:
    """``by…, K, bpb``: the mean over ensembles of each size."""
    rng = np.random.default_rng(0)
    rows = [(k, m) for k in range(1, seeds + 1) for m in subset_masks(seeds, k, most, rng)]
    sizes = probs.sparkSession.createDataFrame(rows, "K int, mask int")
    scored = ensemble_bits(probs, sizes.select("mask").distinct(), *by)
    return scored.join(F.broadcast(sizes), "mask").groupBy(*by, "K").agg(F.avg("bpb").alias("bpb"))


def subset_stats(probs: DataFrame, seeds: int, size: int, *by: str) -> DataFrame:
    """Mean, sample deviation and median over all ensembles of one size."""
    masks = probs.sparkSession.createDataFrame([(m,) for m in subset_masks(seeds, size, 1 << 30)], "mask int")
    return ensemble_bits(probs, masks, *by).groupBy(*by).agg(F.avg("bpb").alias("mean"), F.stddev_samp("bpb").alias("sd"), F.expr("percentile(bpb, 0.5)").alias("median"), F.count("*").alias("subsets"))
