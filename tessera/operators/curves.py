"""Statistics of curves (``curve, i, y`` with i from 0 without gaps)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Positions of a curve that are filtered together.
BLOCK = 1 << 12


def _filtered(curves: DataFrame, half: int, kernel: Callable[[np.ndarray], np.ndarray], block: int) -> DataFrame:
    """``curve, block, i, y`` with ``kernel`` applied to the ``2 half + 1`` values around each
    position; beyond an end the end's value is repeated. A curve is cut into blocks, and only
    rows within ``half`` of a block's edge are sent to the next block too, so that a long curve
    is spread over tasks and shuffled once."""
    if block < half:
        raise ValueError("a block is at least half a filter long")
    at, place = F.floor(F.col("i") / block), F.col("i") % block
    blocks = F.array_compact(F.array(at, F.when((place < half) & (at > 0), at - 1), F.when(place >= block - half, at + 1)))
    dealt = curves.select("curve", "i", "y", F.explode(blocks).alias("block"))

    def run(key, table):
        table = table.sort_by("i")
        i = table.column("i").to_numpy()
        own = np.flatnonzero(i // block == key[1].as_py())
        if not len(own):
            return table.slice(0, 0).select(["curve", "block", "i", "y"])
        y = table.column("y").cast(pa.float64()).to_numpy()  # a null is NaN
        first, last = own[0], own[-1]
        low, high = max(first - half, 0), min(last + half + 1, len(y))
        around = np.concatenate([np.repeat(y[0], half - (first - low)), y[low:high], np.repeat(y[-1], half - (high - 1 - last))])
        out = pa.array(kernel(np.lib.stride_tricks.sliding_window_view(around, 2 * half + 1)), from_pandas=True)
        mine = table.slice(first, len(own))
        return pa.table([mine.column("curve"), mine.column("block"), mine.column("i"), out], names=["curve", "block", "i", "y"])

    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    return dealt.groupBy("curve", "block").applyInArrow(run, f"curve {kinds['curve']}, block {kinds['block']}, i {kinds['i']}, y double")


def _medians(around: np.ndarray) -> np.ndarray:
    if not np.isnan(around).any():
        return np.median(around, axis=1)
    out = np.full(len(around), np.nan)
    some = ~np.isnan(around).all(axis=1)
    out[some] = np.nanmedian(around[some], axis=1)
    return out


def median_filter(curves: DataFrame, width: int = 33, block: int = BLOCK) -> DataFrame:
    """The median of ``width`` values around each; nulls among them are passed over."""
    return _filtered(curves, width // 2, _medians, block).drop("block")


def hann_smooth(curves: DataFrame, taps: int = 31, block: int = BLOCK) -> DataFrame:
    """A normalized Hann window of ``taps`` taps; a null adds nothing."""
    w = np.hanning(taps) / np.hanning(taps).sum()

    def smooth(around: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(around).all(axis=1), np.nan, np.nan_to_num(around, nan=0.0) @ w)

    return _filtered(curves, taps // 2, smooth, block).drop("block")


def robust_area(curves: DataFrame, width: int = 33, block: int = BLOCK) -> DataFrame:
    """Trapezoid area above the final value of the running minimum of the median-filtered curve.
    The minimum runs within a block, from that of the blocks before it."""
    filtered = _filtered(curves, width // 2, _medians, block)
    before = Window.partitionBy("curve").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lows = filtered.groupBy("curve", "block").agg(F.min("y").alias("low")).select(F.col("curve").alias("c"), F.col("block").alias("b"), F.min("low").over(before).alias("low"))
    within = Window.partitionBy("curve", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    running = filtered.select("curve", "block", F.min("y").over(within).alias("y"))
    env = running.join(lows, running.curve.eqNullSafe(lows.c) & (running.block == lows.b)).select("curve", F.least("y", "low").alias("env"))
    # the envelope never rises: its first value is its largest, its last one its least
    steps = env.groupBy("curve").agg(F.sum("env").alias("sum"), F.max("env").alias("first"), F.min("env").alias("last"), (F.count("env") - 1).alias("n"))
    return steps.select("curve", (F.col("sum") - (F.col("first") + F.col("last")) / 2 - F.col("n") * F.col("last")).alias("area"))


def outliers(values: DataFrame) -> DataFrame:
    """``arm, seed, v``: over 2.5 times the median of the arm's others, and over 1.1 times the
    largest of all values that differ from it. A seed is one row of its arm."""
    own = values.where("arm is not null and seed is not null and v is not null")
    # without one value, the middle of the others is that of the arm or the next one
    order = Window.partitionBy("arm").orderBy("v")
    ranked = own.select("arm", "v", (F.row_number().over(order) - 1).alias("r"), F.count("*").over(Window.partitionBy("arm")).alias("n")).withColumn("a", F.floor((F.col("n") - 2) / 2)).withColumn("b", F.floor((F.col("n") - 1) / 2))
    at = {"a0": F.col("a"), "a1": F.col("a") + 1, "b0": F.col("b"), "b1": F.col("b") + 1}
    middle = ranked.where("n > 1 and r between a and b + 1").groupBy("arm").agg(*[F.max(F.when(F.col("r") == x, F.col("v"))).alias(c) for c, x in at.items()])
    pick = lambda x: F.when(F.col("v") <= F.col(f"{x}0"), F.col(f"{x}1")).otherwise(F.col(f"{x}0"))
    others = values.join(F.broadcast(middle), "arm", "left").withColumn("median", F.when(F.col("seed").isNotNull(), (pick("a") + pick("b")) / 2))
    top = values.agg(F.max("v").alias("top"))
    second = values.join(F.broadcast(top), F.expr("v < top")).agg(F.max("v").alias("second"))
    both = others.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(second))
    rest = F.when(F.col("v") == F.col("top"), F.col("second")).otherwise(F.col("top"))
    return both.select("arm", "seed", "v", F.coalesce((F.col("v") > 2.5 * F.col("median")) & (F.col("v") > 1.1 * rest), F.lit(False)).alias("outlier"))


def interpolate(points: DataFrame, grid: list[float]) -> DataFrame:
    """``arm, seed, x, y`` on a grid of x, linearly; beyond a seed's last point its last
    value holds, before its first there is none. A grid point looks for the seed's
    segments, which are made by one window over the seed's own points."""
    by = Window.partitionBy("arm", "seed").orderBy("x")
    segments = points.withColumn("x1", F.lead("x").over(by)).withColumn("y1", F.lead("y").over(by))
    at = points.sparkSession.createDataFrame([(i, float(g)) for i, g in enumerate(grid)], "g int, gx double")
    inside = segments.join(F.broadcast(at), (F.col("gx") >= F.col("x")) & (F.col("x1").isNull() | (F.col("gx") < F.col("x1"))))
    return inside.select("arm", "seed", "g", "gx", F.when(F.col("x1").isNull(), F.col("y")).otherwise(F.col("y") + (F.col("y1") - F.col("y")) * (F.col("gx") - F.col("x")) / (F.col("x1") - F.col("x"))).alias("y"))


def band(interpolated: DataFrame) -> DataFrame:
    return interpolated.groupBy("arm", "g", "gx").agg(F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"), F.stddev_samp("y").alias("sd"))
