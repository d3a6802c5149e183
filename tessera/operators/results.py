"""Result tables: contracts and checks on them, curves and matrices put together from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The columns of a scored corpus, no more and no fewer.
RESULT_KEYS = ("seq_ce", "loss", "bpb", "n_seqs", "context_length")


def require_result_keys(df: DataFrame, *by: str) -> DataFrame:
    """``df`` with the columns of the contract in its order; missing or unexpected ones are an error."""
    got, want = set(df.columns) - set(by), set(RESULT_KEYS)
    if got != want:
        raise ValueError(f"result columns: missing {sorted(want - got)}, unexpected {sorted(got - want)}")
    return df.select(*by, *RESULT_KEYS)


def clip_name(column: str) -> Column:
    """``fold-clip-take-target.wav`` as a struct; null where a name is of another form."""
    form = r"^([1-5])-([0-9]+)-([A-Z])-([0-9]+)\.wav$"
    part = lambda i: F.regexp_extract(column, form, i)
    fields = F.struct(part(1).cast("int").alias("fold"), part(2).cast("long").alias("clip"), part(3).alias("take"), part(4).cast("int").alias("target"))
    return F.when(F.col(column).rlike(form), fields)


def rounds_of(checkpoints: DataFrame, wanted: DataFrame, *by: str) -> DataFrame:
    """The checkpoints whose group and round are asked for."""
    return checkpoints.join(wanted.select(*by, "round").distinct(), [*by, "round"], "left_semi")


def strict_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Each row of ``left`` with its row of ``right``; one that has none is an error."""
    there = right.withColumn("_there", F.lit(True))
    missing = F.raise_error(F.concat(F.lit(f"no row for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    joined = left.join(there, key, "left").where(F.when(F.col("_there"), True).otherwise(missing.cast("boolean")))
    return joined.drop("_there")


def assemble_curves(*named: tuple[str, DataFrame, Column]) -> DataFrame:
    """Rows of several result tables under one ``curve`` column: (name, table, which rows)."""
    return reduce(DataFrame.unionByName, [df.where(rows).withColumn("curve", F.lit(name)) for name, df, rows in named])


def table_differences(left: DataFrame, right: DataFrame, keys: list[str], value: str, places: int = 3) -> DataFrame:
    """Keys whose value is in one table alone, or differs when rounded as it is printed."""
    a = left.select(*keys, F.round(value, places).alias("left_value"))
    b = right.select(*keys, F.round(value, places).alias("right_value"))
    return a.join(b, keys, "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def accuracy_matrix(rows: DataFrame, row: str, column: str, values: list, value: str = "accuracy") -> DataFrame:
    """``row`` by ``column``; a cell without a result is not a number."""
    wide = rows.groupBy(row).pivot(column, values).agg(F.first(value))
    return wide.select(row, *[F.coalesce(F.col(str(v)).cast("double"), F.lit(float("nan"))).alias(f"k{v}") for v in values])


def accuracy_by_position(rows: DataFrame, *by: str) -> DataFrame:
    """Arrays ``pred, answer`` of one length a group, slot by slot: ``slot, accuracy, n``, and
    ``mean``, the average over slots of their averages."""
    each = rows.select(*by, F.posexplode(F.arrays_zip("pred", "answer")).alias("slot", "x"))
    slots = each.groupBy(*by, "slot").agg(F.avg((F.col("x.pred") == F.col("x.answer")).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    return slots.withColumn("mean", F.avg("accuracy").over(Window.partitionBy(*by)))


def copy_lag_curve(results: DataFrame) -> DataFrame:
    """``k, m, acc_by_position`` to the curve of each k at its largest m: slot j lags 2 j + 1 tokens."""
    best = results.groupBy("k").agg(F.max("m").alias("m"), F.max_by("acc_by_position", "m").alias("a"))
    return best.select("k", "m", F.posexplode("a").alias("slot", "accuracy")).withColumn("lag", 2 * F.col("slot") + 1)


def cumulative_composition(shares: DataFrame, parts: list[str], *by: str) -> DataFrame:
    """Columns ``parts`` as stacked bands: each with its ``low`` and ``high`` edge."""
    edges, total = [], F.lit(0.0)
    for i, p in enumerate(parts):
        edges.append(F.struct(F.lit(i).alias("rank"), F.lit(p).alias("part"), total.alias("low"), (total + F.col(p)).alias("high")))
        total = total + F.col(p)
    return shares.select(*by, F.explode(F.array(*edges)).alias("e")).select(*by, "e.*")


def reconcile(stats: DataFrame, expected: dict[str, int]) -> DataFrame:
    """A one-row table of totals against what they have to be: ``name, found, wanted, ok``."""
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("long").alias("found"), F.lit(v).cast("long").alias("wanted")) for k, v in expected.items()])
    return stats.select(F.explode(rows).alias("r")).select("r.*", F.col("r.found").eqNullSafe(F.col("r.wanted")).alias("ok"))


def require_reconciled(stats: DataFrame, expected: dict[str, int]) -> None:
    bad = reconcile(stats, expected).where(~F.col("ok")).collect()
    if bad:
        raise ValueError("; ".join(f"{r.name}: {r.found} instead of {r.wanted}" for r in bad))


def length_batches(rows: DataFrame, key: str, size: int, column: str = "prompt", salts: int = 64) -> DataFrame:
    """Ragged sequences in batches of one exact length and ``size`` rows at most: ``length,
    batch`` and the key. Ranks come from counts of (length, salt), so that a length that most
    rows have is spread over many tasks."""
    dealt = rows.select(F.size(column).alias("length"), F.pmod(F.col(key), F.lit(salts)).alias("salt"), key)
    counts = dealt.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offset = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy(key)) - 1
    return dealt.withColumn("rank", rank).join(offset, ["length", "salt"]).select("length", F.floor((F.col("before") + F.col("rank")) / size).alias("batch"), key)


def write_rounded_csv(df: DataFrame, path: str, places: dict[str, int], overwrite: bool = False) -> None:
    """A CSV table with a header, its numbers printed with so many places."""
    printed = [F.format_string(f"%.{places[c]}f", F.col(c).cast("double")).alias(c) if c in places else F.col(c) for c in df.columns]
    df.select(*printed).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).csv(path)
