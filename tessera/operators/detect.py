"""Sequence families in output tapes, and how soon they are found."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Leading values that may be a transient; least period of a hit; tail that shows the
#: eventual period; shortest tape that is looked at; powers of the sums of a period; inverses
#: of odd values.
SKIP, LEAST_PERIOD, TAIL, SHORTEST = 30, 30, 2048, 200
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.array([pow(i, -1, 256) if i % 2 else 0 for i in range(256)])
HIT = "family string, start_offset int, period int, params string, first_terms array<int>, prefix array<int>, tape_len int"


def min_period(x: np.ndarray) -> int:
    """The smallest shift under which a sequence agrees with itself."""
    return int(min_periods(np.asarray(x)[None])[0])


def min_periods(x: np.ndarray) -> np.ndarray:
    """:func:`min_period` of each row. Sums modulo 2^64 of odd powers show which shifts may
    agree; the smallest is compared value by value, and passed over where only its sum agrees."""
    rows, n = x.shape
    if n < 2:
        return np.full(rows, n)
    powers = np.full(n + 1, _BASE)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros((rows, n + 1), np.uint64)
    np.cumsum(x.astype(np.int64).view(np.uint64) * powers[:n], axis=1, out=sums[:, 1:])
    may = sums[:, n:] - sums[:, 1:] == sums[:, n - 1 :: -1] * powers[1:]
    out = np.zeros(rows, np.int64)
    left = np.arange(rows)
    while len(left):
        shift = may[left].argmax(axis=1) + 1
        for s in np.unique(shift).tolist():
            here = left[shift == s]
            same = (x[here, s:] == x[here, : n - s]).all(axis=1)
            out[here[same]] = s
            may[here[~same], s - 1] = False
        left = left[out[left] == 0]
    return out


def differences(x: np.ndarray, order: int) -> np.ndarray:
    for _ in range(order):
        x = (x[..., 1:] - x[..., :-1]) % 256
    return x


def _residual(family: str, x: np.ndarray, ratio) -> np.ndarray:
    """What must be zero at every place for the family's recurrence to hold there."""
    if family == "fibonacci":
        return (x[..., 2:] - x[..., 1:-1] - x[..., :-2]) % 256
    if family == "geometric":
        return (x[..., 1:] - ratio * x[..., :-1]) % 256
    return differences(x, {"arithmetic": 2, "quadratic": 3, "cubic": 4}[family])


def _ratios(core: np.ndarray) -> np.ndarray:
    """The ratio of each geometric sequence: from an odd value, which can be inverted; if all
    are even, the first that fits; -1 if none does."""
    odd = core[:, :-1] % 2 == 1
    some = np.flatnonzero(odd.any(axis=1))
    at = odd[some].argmax(axis=1)
    out = np.full(len(core), -1)
    tried = core[some, at + 1] * _INVERSE[core[some, at] % 256] % 256
    good = ~_residual("geometric", core[some], tried[:, None]).any(axis=1)
    out[some[good]] = tried[good]
    left = np.flatnonzero(~odd.any(axis=1))
    for r in range(256):
        if not len(left):
            break
        fits = ~_residual("geometric", core[left], r).any(axis=1)
        out[left[fits]] = r
        left = left[~fits]
    return out


def classify(tape: np.ndarray) -> list[dict]:
    """The families that a tape belongs to after a short prefix. Of the polynomial ones
    only the lowest counts; tapes with a short period, at once or in the end, don't."""
    return [h for _, h in classify_rows(np.asarray(tape, np.int64)[None])]


def classify_rows(x: np.ndarray) -> list[tuple[int, dict]]:
    """:func:`classify` of tapes of one length, one a row: (row, hit), in order of rows."""
    if x.shape[1] < SHORTEST:
        return []
    core = x[:, SKIP:]
    nothing = np.zeros(len(x), np.int64)
    found = []
    open_ = np.arange(len(x))
    for order, family in enumerate(("arithmetic", "quadratic", "cubic"), 1):
        fits = ~_residual(family, core[open_], 0).any(axis=1)
        found.append((family, order, open_[fits], nothing))
        open_ = open_[~fits]
    found.append(("fibonacci", 0, np.flatnonzero(~_residual("fibonacci", core, 0).any(axis=1)), nothing))
    ratios = _ratios(core)
    found.append(("geometric", 0, np.flatnonzero(ratios >= 0), ratios))
    out = []
    for family, order, rows, ratio in found:
        if not len(rows):
            continue
        broken = _residual(family, x[rows], ratio[rows, None])[:, :SKIP] != 0
        starts = np.where(broken.any(axis=1), broken.shape[1] - broken[:, ::-1].argmax(axis=1), 0)
        diffs = np.stack([differences(core[rows], k)[:, 0] for k in range(1, order + 1)], axis=1).tolist() if order else None
        for start in np.unique(starts).tolist():
            at = np.flatnonzero(starts == start)
            rest = x[rows[at], start:]
            periods = min_periods(rest)
            tails = min_periods(rest[:, -TAIL:]) if rest.shape[1] > TAIL else periods
            for i, period, tail in zip(at.tolist(), periods.tolist(), tails.tolist()):
                if min(period, tail) >= LEAST_PERIOD:
                    row = int(rows[i])
                    params = {"diffs": diffs[i]} if order else {"ratio": int(ratio[row])} if family == "geometric" else {}
                    tape = x[row]
                    out.append((row, {"family": family, "start_offset": start, "period": period, "params": params, "first_terms": tape[start : start + 12].tolist(), "prefix": tape[:start].tolist(), "tape_len": len(tape)}))
    return sorted(out, key=lambda hit: hit[0])


def _by_length(column: pa.Array):
    """Tapes of an Arrow list column without nulls, by length and in pieces of about a million
    values: (rows, matrix)."""
    start = column.offsets.to_numpy()
    size = np.diff(start)
    values = column.values
    holes = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))
    whole = (holes[start[1:]] == holes[start[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for n in np.unique(size[whole]).tolist():
        rows = np.flatnonzero(whole & (size == n))
        step = max(1, (1 << 20) // max(n, 1))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            yield some, flat[start[some][:, None] + np.arange(n)]


def scan(tapes: DataFrame) -> DataFrame:
    """``id, tape`` (an array, or its JSON text: what can't be read is passed over) to a row
    for each hit."""
    import json

    column = tapes.schema["tape"].dataType.simpleString()
    base = tapes.select("id", F.col("tape") if column == "array<int>" else F.from_json("tape", "array<int>").alias("tape")).where("tape is not null")

    def run(batches):
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            for some, matrix in _by_length(b.column(1)):
                rows += [(ids[some[i]], h["family"], h["start_offset"], h["period"], json.dumps(h["params"], sort_keys=True), h["first_terms"], h["prefix"], h["tape_len"]) for i, h in classify_rows(matrix)]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["id", "family", "start_offset", "period", "params", "first_terms", "prefix", "tape_len"])

    return base.mapInArrow(run, "id long, " + HIT)


def polynomial_orders(tapes: DataFrame) -> DataFrame:
    """``id, tape`` to ``id, degree``: 1, 2 or 3 for the lowest order of constant differences
    modulo 256; null if none, or where a value is null."""

    def run(batches):
        for b in batches:
            degree = np.zeros(b.num_rows, np.int32)
            for some, matrix in _by_length(b.column(1)):
                left = np.arange(len(some))
                for order in (1, 2, 3):
                    matrix = differences(matrix, 1)
                    constant = (matrix == matrix[:, :1]).all(axis=1) & (matrix.shape[1] > 0)
                    degree[some[left[constant]]] = order
                    left, matrix = left[~constant], matrix[~constant]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(degree, mask=degree == 0)], ["id", "degree"])

    return tapes.select(F.col("id").cast("long"), F.col("tape").cast("array<int>")).mapInArrow(run, "id long, degree int")


def first_discovery(hits: DataFrame, rungs: DataFrame) -> DataFrame:
    """For each family the first round of each rung, and of all: the earliest round, then
    the smallest rung."""
    each = hits.groupBy("family", "rung").agg(F.min("round").alias("round")).join(F.broadcast(rungs), "rung")
    return each.groupBy("family").agg(F.min_by("rung", F.struct("round", "N")).alias("first_rung"), F.min("round").alias("first_round"), F.min_by("rung", "N").alias("smallest_rung"), F.count("*").alias("rungs"))


def expected_rounds(counts: DataFrame) -> DataFrame:
    """``family, hits, programs, per_round`` to the rounds until a first hit by chance: mean
    and median; without a hit the rule of three bounds the rate."""
    rate = F.when(F.col("hits") > 0, F.col("hits") / F.col("programs")).otherwise(3.0 / F.col("programs"))
    mean = 1 / (F.col("per_round") * rate)
    return counts.select("family", "hits", (F.col("hits") == 0).alias("bound"), rate.alias("rate"), mean.alias("mean_rounds"), (mean * F.log(F.lit(2.0))).alias("median_rounds"))


def _gamma_p(a: float, x: float) -> float:
    """The regularized lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > 1e-17 * abs(total):
            n += 1
            term *= x / n
            total += term
        return lead * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1 - lead * h


def poisson_interval(k: int, level: float = 0.95) -> tuple[float, float]:
    """The exact interval of a Poisson mean after ``k`` events."""

    def invert(a: float, p: float) -> float:
        lo, hi = 0.0, a + 50 + 20 * math.sqrt(a + 1)
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _gamma_p(a, mid) < p else (lo, mid)
        return (lo + hi) / 2

    tail = (1 - level) / 2
    return (invert(k, tail) if k else 0.0), invert(k + 1, 1 - tail)
