"""Table-shaped sources: Parquet, window JSONL, frontier CSV, score slices, hits, melodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW_SCHEMA = "sequence array<int>, id string, metadata struct<sequence_length:int, context_length:int, original_file:string, subset:string, global_shard:string, chunk_index:bigint>"
FRONTIER_SCHEMA = "rung string, N bigint, round int, corpus string, K int, bpb double, n_seeds int"
SLICE_SCHEMA = "rung string, size string, N bigint, round int, n_seeds int, bpb map<string,map<string,double>>, bpb_per_seed map<string,map<string,double>>"
HIT_SCHEMA = "family string, rung string, seed int, round int, record_round int, start_offset int, period int"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def window_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Baked windows, one JSON object a line; blank lines are skipped."""
    return spark.read.schema(WINDOW_SCHEMA).json(path).where("sequence is not null")


def frontier_csv(spark: SparkSession, path: str) -> DataFrame:
    """The flat score table without round 0."""
    return spark.read.option("header", True).schema(FRONTIER_SCHEMA).csv(path).where("round <> 0")


def flat_slices(nested: DataFrame) -> DataFrame:
    """Nested score slices as flat rows, one for each corpus and ensemble size."""
    by_corpus = nested.select("rung", "N", "round", "n_seeds", F.explode("bpb").alias("corpus", "by_k"))
    flat = by_corpus.select("rung", "N", "round", "n_seeds", "corpus", F.explode("by_k").alias("k", "bpb"))
    return flat.where("k <> 'n_seeds'").select("rung", "N", "round", "corpus", F.col("k").cast("int").alias("K"), "bpb", "n_seeds")


def score_slices(spark: SparkSession, path: str) -> DataFrame:
    return flat_slices(spark.read.option("multiLine", True).schema(SLICE_SCHEMA).json(path))


def hits_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HIT_SCHEMA).json(path)


def melody_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Melody rows; fails on a blank line or a value that isn't an integer from 0 to 130."""
    lines = spark.read.text(path)
    parsed = lines.withColumn("sequence", F.from_json("value", "array<int>"))
    good = F.col("sequence").isNotNull() & F.forall("sequence", lambda x: x.isNotNull() & x.between(0, 130)) & ~F.col("value").rlike("true|false|[.eE\"]")
    return parsed.select(F.when(good, F.col("sequence")).otherwise(F.raise_error(F.concat(F.lit("not a melody row: "), F.substring("value", 1, 60))).cast("array<int>")).alias("sequence"))


def checkpoint_index(paths: DataFrame, group: str | None = None) -> DataFrame:
    """From a listing (column ``path``) like ``group/target/seed/learner_<round>.pth``: the
    seeds' paths for each target and round."""
    p = r"^(.*?)/([^/]+)/([^/]+)/learner_(\d+)\.pth$"
    parts = paths.where(F.col("path").rlike(p)).select(*[F.regexp_extract("path", p, i + 1).alias(n) for i, n in enumerate(("grp", "target", "seed"))], F.regexp_extract("path", p, 4).cast("int").alias("round"), "path")
    if group:
        parts = parts.where(F.col("grp") == group)
    return parts.groupBy("target", "round").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("seed", "path")))).alias("paths"))


def first_path_per_shard(manifest: DataFrame, shards: int | None = None) -> DataFrame:
    """From manifest lines (``line_no, path``) the first path of each ``shard_NN`` tag; where
    ``shards`` says how many there are, one that is absent is an error."""
    tagged = manifest.withColumn("shard", F.regexp_extract("path", r"shard_0*(\d+)", 1)).where("shard <> ''")
    found = tagged.groupBy(F.col("shard").cast("int").alias("shard")).agg(F.min_by("path", "line_no").alias("path"))
    if shards is None:
        return found
    every = manifest.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    absent = F.raise_error(F.concat(F.lit("no path of shard "), F.col("shard").cast("string"))).cast("string")
    return every.join(found, "shard", "left").select("shard", F.coalesce("path", absent).alias("path"))


def arithmetic_sequences(spark: SparkSession, n: int, width: int, seed: int = 0) -> DataFrame:
    """``(start + step * j) mod 256``: starts and steps from a seeded hash of the row."""
    rows = spark.range(n).select("id", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(256)).alias("start"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(256)).alias("step"))
    return arithmetic_values(rows, width)


def arithmetic_values(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("sequence", F.expr(f"transform(sequence(0, {width - 1}), j -> cast((start + step * j) % 256 as int))"))


def csv_dimension(spark: SparkSession, path: str, required: list[str], key: str) -> DataFrame:
    """A CSV file with a header as a dimension table; a missing column, no rows, or a key that
    repeats or is null is an error."""
    df = spark.read.option("header", True).csv(path)
    lacking = sorted(set(required) - set(df.columns))
    if lacking:
        raise ValueError(f"{path}: missing columns {lacking}")
    r = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys")).first()
    if not r.rows or r["keys"] != r.rows:
        raise ValueError(f"{path}: {r.rows} rows and {r['keys']} different values of {key}")
    return df
