"""Trajectories, compute frontiers and power-law fits.

The fact table is ``rung, N, round, corpus, K, bpb, n_seeds``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Programs a round of self-play, and bytes of a context.
POOL, CONTEXT = 1536, 4096


def training_limits(layers, width) -> dict:
    """Step budget and tape length for a model's shape."""
    return {"max_steps": F.greatest(F.lit(2**14), layers * width * width * 16), "tape_length": F.greatest(F.lit(1024), width * 8)}


def rollup(traj: DataFrame) -> DataFrame:
    """For each rung: rounds, largest number of seeds, last round, corpora."""
    return traj.groupBy("rung").agg(F.count_distinct("round").alias("rounds"), F.max("n_seeds").alias("max_seeds"), F.max("round").alias("last_round"), F.count_distinct("corpus").alias("corpora"))


def min_seeds(traj: DataFrame, least: int = 3) -> DataFrame:
    return traj.where(F.col("n_seeds") >= least)


def final_round(traj: DataFrame, most_k: int = 4) -> DataFrame:
    """For each rung and corpus the loss at the last round, with the largest K up to ``most_k``."""
    inside = traj.where(F.col("K") <= most_k)
    return inside.groupBy("rung", "corpus").agg(F.max_by("bpb", F.struct("round", "K")).alias("bpb"), F.max(F.struct("round", "K")).alias("at")).select("rung", "corpus", F.col("at.round").alias("round"), F.col("at.K").alias("K"), "bpb")


def compute_axis(traj: DataFrame, pools: DataFrame | None = None) -> DataFrame:
    """``C = K * N * pool * context * (round + 1)``; ``pools`` gives the pool of each rung."""
    if pools is not None:
        traj = traj.join(F.broadcast(pools), "rung")
        pool = F.col("pool")
    else:
        pool = F.lit(POOL)
    c = F.col("K").cast("double") * F.col("N") * pool * CONTEXT * (F.col("round") + 1)
    return traj.withColumn("C", c).drop("pool")


def selection(traj: DataFrame, omit: tuple = (), stride: int = 1, keep: tuple | None = None, most_k: int | None = None) -> DataFrame:
    """Rounds after 0, not of omitted rungs, every ``stride``-th of a rung's rounds or those
    kept by name, K up to ``most_k``."""
    out = traj.where("round <> 0")
    if omit:
        out = out.where(~F.col("rung").isin(*omit))
    if most_k:
        out = out.where(F.col("K") <= most_k)
    if keep is not None:
        out = out.where(F.col("round").isin(*keep))
    if stride > 1:
        out = out.withColumn("_n", F.dense_rank().over(Window.partitionBy("rung").orderBy("round"))).where((F.col("_n") - 1) % stride == 0).drop("_n")
    return out


def pareto(points: DataFrame, *by: str, c: str = "C", loss: str = "bpb") -> DataFrame:
    """Points that improve strictly on every cheaper one, within each group of ``by``.
    Points must be finite and positive."""
    ok = (F.col(c) > 0) & (F.col(loss) > 0) & (F.abs(F.col(c)) < float("inf")) & (F.abs(F.col(loss)) < float("inf")) & ~F.isnan(c) & ~F.isnan(loss)
    checked = points.withColumn(c, F.when(ok, F.col(c)).otherwise(F.raise_error("points must be finite and positive").cast("double")))
    # equal costs reduce to their least loss before anything is ordered
    best = checked.groupBy(*by, c).agg(F.min(loss).alias(loss))
    order = Window.partitionBy(*by).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    return best.withColumn("_least", F.min(loss).over(order)).where(F.col("_least").isNull() | (F.col(loss) < F.col("_least"))).drop("_least")


def two_level(points: DataFrame, group: str = "corpus", rung: str = "rung") -> DataFrame:
    """The frontier of each group. Each rung's own frontier is taken first, in parallel, so
    that the last window orders few rows."""
    return pareto(pareto(points, group, rung), group)


def power_fit(points: DataFrame, *by: str, c: str = "C", loss: str = "bpb") -> DataFrame:
    """``loss = amplitude * C^-alpha`` by least squares on logarithms (3 points or more)."""
    x, y = F.log(F.col(c)), F.log(F.col(loss))
    fit = points.select(*by, x.alias("x"), y.alias("y")).groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("at0"), F.regr_r2("y", "x").alias("log_r2"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.count("*").alias("n_points"))
    rest = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    return fit.where("n_points >= 3").select(*by, F.exp("at0").alias("amplitude"), (-F.col("slope")).alias("alpha"), "log_r2", F.sqrt(rest / F.col("n_points")).alias("log_rmse"), "n_points")


def _grid_fit(points: DataFrame, by: tuple, alphas: list[float] | DataFrame, scale: float, floor: bool) -> DataFrame:
    """The best of a grid of exponents, one for all groups or (a DataFrame) one for each; for
    each exponent the linear part has a closed form."""
    x = F.pow(F.col("C") / scale, -F.col("alpha"))
    if isinstance(alphas, DataFrame):
        own = alphas.select("alpha", *[F.col(c).alias(f"_{i}") for i, c in enumerate(by)])
        crossed = points.join(F.broadcast(own), reduce(and_, [points[c].eqNullSafe(own[f"_{i}"]) for i, c in enumerate(by)], F.lit(True)))
    else:
        crossed = points.crossJoin(F.broadcast(points.sparkSession.createDataFrame([(float(a),) for a in alphas], "alpha double")))
    rows = crossed.select(*by, "alpha", x.alias("x"), F.col("bpb").alias("y"))
    if floor:
        fit = rows.groupBy(*by, "alpha").agg(F.regr_slope("y", "x").alias("amplitude"), F.regr_intercept("y", "x").alias("floor"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.count("*").alias("n_points"))
        sse = F.greatest(F.col("syy") - F.col("amplitude") * F.col("sxy"), F.lit(0.0))
        fit = fit.where("amplitude >= 0 and floor >= 0")
    else:
        fit = rows.groupBy(*by, "alpha").agg((F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("amplitude"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.sum(F.col("x") * F.col("y")).alias("xy"), F.lit(0.0).alias("floor"), F.count("*").alias("n_points"))
        sse = F.greatest(F.col("yy") - F.col("amplitude") * F.col("xy"), F.lit(0.0))
    scored = fit.withColumn("sse", sse)
    best = scored.groupBy(*by).agg(F.min_by(F.struct("alpha", "amplitude", "floor", "sse", "n_points"), F.struct("sse", "alpha")).alias("b"))
    return best.select(*by, "b.*").withColumn("rmse", F.sqrt(F.col("sse") / F.col("n_points"))).drop("sse")


def floor_fit(points: DataFrame, *by: str, scale: float = 1e15, lo: float = 0.01, hi: float = 2.0, steps: int = 200, refine: int = 3) -> DataFrame:
    """``loss = floor + amplitude * (C / scale)^-alpha`` by variable projection: for an
    exponent the rest is a line; a grid of exponents is refined around each group's best."""
    fit = _grid_fit(points, by, np.linspace(lo, hi, steps).tolist(), scale, True)
    step = (hi - lo) / (steps - 1)
    for _ in range(refine):
        low = F.greatest(F.lit(1e-6), F.col("alpha") - step)
        at = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: low + (F.col("alpha") + step - low) * i / (steps - 1))
        fit = _grid_fit(points, by, fit.select(*by, F.explode(at).alias("alpha")), scale, True)
        step = 2 * step / (steps - 1)
    return fit


def raw_power_fit(points: DataFrame, *by: str, scale: float = 1e15, lo: float = 0.001, hi: float = 2.0, steps: int = 400) -> DataFrame:
    """``loss = amplitude * (C / scale)^-alpha`` by least squares on losses themselves."""
    return _grid_fit(points, by, np.linspace(lo, hi, steps).tolist(), scale, False).drop("floor")


def robust_floor_fit(c: np.ndarray, loss: np.ndarray, delta: float = 1e-3) -> dict:
    """``loss = floor + amplitude * C^-alpha`` under Huber's loss on the residuals, in the units
    of the loss, by Nelder–Mead from three amplitudes by three exponents; six points over 1.5
    decades at least. The floor is searched for as its ratio to the amplitude, in decades."""
    c, loss = np.asarray(c, float), np.asarray(loss, float)
    if not (np.isfinite(c) & np.isfinite(loss) & (c > 0) & (loss > 0)).all():
        raise ValueError("compute and loss are positive numbers")
    x = np.log10(c)
    if len(c) < 6 or x.max() - x.min() < 1.5:
        raise ValueError("too few points or too narrow a range")
    ten = np.log(10.0)

    def curve(t: np.ndarray) -> np.ndarray:
        return np.exp(ten * t[0] + np.logaddexp(-ten * t[1] * x, ten * t[2]))

    def cost(t: np.ndarray) -> float:
        r = np.abs(curve(t) - loss)
        return float(np.where(r > delta, delta * (r - delta / 2), r * r / 2).sum())

    low = np.log10(max(loss.min() / 2, 1e-3))
    starts = [np.array([a, alpha, low - a]) for a in (np.log10(3 * loss.max()), 1.0, 2.0) for alpha in (0.03, 0.1, 0.3)]
    best = min((nelder_mead(cost, s, 20_000) for s in starts), key=cost)
    rmse = float(np.sqrt(np.mean((curve(best) - loss) ** 2)))
    return {"amplitude": float(10 ** best[0]), "floor": float(10 ** (best[0] + best[2])), "alpha": float(best[1]), "cost": cost(best), "rmse": rmse, "n_points": len(c)}


def robust_floor_fits(points: DataFrame, *by: str, delta: float = 1e-3) -> DataFrame:
    """The same for each group of ``C, bpb``, a task a group; groups with too few points or too
    narrow a range have no row. A group is a frontier: tens to thousands of points."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema if f.name in by), "amplitude double, floor double, alpha double, rmse double, n_points long"])

    def fit(pdf):
        import pandas as pd

        names = [*by, "amplitude", "floor", "alpha", "rmse", "n_points"]
        try:
            r = robust_floor_fit(pdf["C"], pdf["bpb"], delta)
        except ValueError:
            return pd.DataFrame([], columns=names)
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), *(r[c] for c in names[len(by) :])]], columns=names)

    return points.groupBy(*by).applyInPandas(fit, schema)


def nelder_mead(f, start: np.ndarray, steps: int = 2000, tolerance: float = 1e-12) -> np.ndarray:
    """A minimum of ``f`` by the downhill simplex method."""
    simplex = [start, *(start + np.eye(len(start))[i] * 0.25 for i in range(len(start)))]
    value = [f(p) for p in simplex]
    for _ in range(steps):
        order = np.argsort(value)
        simplex, value = [simplex[i] for i in order], [value[i] for i in order]
        if value[-1] - value[0] < tolerance:
            break
        middle = np.mean(simplex[:-1], axis=0)
        tried = middle + (middle - simplex[-1])
        got = f(tried)
        if got < value[0]:
            further = middle + 2 * (middle - simplex[-1])
            if (v := f(further)) < got:
                tried, got = further, v
        elif got >= value[-2]:
            tried = middle + 0.5 * (simplex[-1] - middle)
            got = f(tried)
            if got >= value[-1]:
                simplex = [simplex[0], *(simplex[0] + 0.5 * (p - simplex[0]) for p in simplex[1:])]
                value = [value[0], *(f(p) for p in simplex[1:])]
                continue
        simplex[-1], value[-1] = tried, got
    return simplex[int(np.argmin(value))]


def joint_exponent(alpha, beta):
    """The compute exponent of a law with one exponent for size and one for data."""
    return alpha * beta / (alpha + beta)


def common_compute(points: DataFrame, budget: float) -> DataFrame:
    """``corpus, arm, C, bpb`` to each arm's best loss within a budget, the reduction of the
    first arm (``selfplay``) against the best other, and its rank."""
    best = points.where(F.col("C") <= budget).groupBy("corpus").pivot("arm", ["selfplay", "uniform", "pcfg"]).agg(F.min("bpb"))
    cut = best.withColumn("reduction", 1 - F.col("selfplay") / F.least("uniform", "pcfg"))
    return cut.withColumn("rank", F.rank().over(Window.orderBy(F.desc_nulls_last("reduction"))))


def ablation_pivot(finals: DataFrame, arms: list[str]) -> DataFrame:
    """``arm, corpus, bpb`` to a row for each corpus, with the arms that equal the least after
    rounding to two places."""
    wide = finals.groupBy("corpus").pivot("arm", arms).agg(F.first("bpb"))
    least = F.least(*[F.round(F.col(a), 2) for a in arms])
    return wide.withColumn("best", F.concat_ws(",", *[F.when(F.round(F.col(a), 2) == least, F.lit(a)) for a in arms]))
