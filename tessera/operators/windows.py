"""Byte streams and documents to fixed-width windows, and what is chosen of them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Tag bytes of outputs and programs.
OUTPUT_TAG, PROGRAM_TAG = b"O", b"S"


def window_of(context_length: int) -> int:
    """Bytes of a window: the context less its tag byte."""
    if context_length < 2:
        raise ValueError("a context holds its tag byte and at least one more")
    return context_length - 1


def spread(df: DataFrame) -> DataFrame:
    """The same rows dealt over tasks, where few files or row groups would leave the work that
    follows to a few of them. A number is given, since small partitions would be joined again."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism))


def chunk(df: DataFrame, window: int, raw: str = "raw") -> DataFrame:
    """Consecutive whole windows of each row's bytes; a short tail is dropped. ``raw`` is
    replaced by ``idx`` and ``payload``."""
    keep = [c for c in df.columns if c != raw]
    n = F.expr(f"octet_length(`{raw}`) div {window}")
    rows = df.where(F.octet_length(raw) >= window).select("*", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("idx"))
    return rows.select(*keep, "idx", F.expr(f"substring(`{raw}`, cast(idx * {window} + 1 as int), {window})").alias("payload"))


def chunk_tokens(df: DataFrame, window: int, column: str = "sequence") -> DataFrame:
    """The same for arrays of token ids."""
    n = F.expr(f"size(`{column}`) div {window}")
    rows = df.where(F.size(column) >= window).select("*", F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"))).alias("idx"))
    return rows.withColumn(column, F.expr(f"slice(`{column}`, cast(idx * {window} + 1 as int), {window})"))


def records(windows: DataFrame, stem: str, window: int) -> DataFrame:
    """Windows (``idx, payload``, numbered by ``number``) as baked records."""
    out = windows.select(F.concat_ws("_", F.lit(stem), F.lit(window), F.col("number")).alias("id"), bytes_of("payload").alias("sequence"), F.struct(F.lit(window).alias("sequence_length"), F.lit(window + 1).alias("context_length"), F.col("idx").alias("chunk_index")).alias("metadata"))
    return out.where(F.when(F.size("sequence") == window, True).otherwise(F.raise_error("a window of another length").cast("boolean")))


def bytes_of(column: str):
    """Unsigned byte values of a binary column; it is decoded once, not for each byte."""
    return F.expr(f"if(octet_length(`{column}`) = 0, cast(array() as array<int>), transform(split(decode(`{column}`, 'ISO-8859-1'), ''), c -> ascii(c)))")


def add_tag(column: str, tag: bytes = OUTPUT_TAG):
    return F.concat(F.lit(bytearray(tag)), F.col(column))


def strip_tag(column: str):
    return F.expr(f"substring(`{column}`, 2)")


def input_target(column: str):
    """(inputs, targets): all tokens but the last, and all but the first."""
    return F.struct(F.expr(f"slice(`{column}`, 1, size(`{column}`) - 1)").alias("input"), F.expr(f"slice(`{column}`, 2, size(`{column}`) - 1)").alias("target"))


def first_n(df: DataFrame, n: int | None, index: str = "idx") -> DataFrame:
    return df.where(F.col(index) < n) if n else df


def strided_shard(df: DataFrame, rank: int, world: int, index: str = "idx") -> DataFrame:
    return df.where(F.pmod(F.col(index), F.lit(world)) == rank)


def quota(total: int, shards: int, shard):
    """``total`` split over ``shards``: the first ones take the remainder."""
    return F.lit(total // shards) + F.when(shard < total % shards, 1).otherwise(0)


def parse_rounds(spec: str) -> list[int]:
    """``a,b,c`` or inclusive ``start:stop:step``."""
    if ":" in spec:
        start, stop, step = map(int, spec.split(":"))
        if step <= 0:
            raise ValueError("step must be positive")
        return list(range(start, stop + 1, step))
    return [int(x) for x in re.split(r"\s*,\s*", spec.strip())]


# ---- choosing windows of clips


def clip_plan(clips: DataFrame, window: int) -> DataFrame:
    """``name, raw`` with a window to: ``n`` windows, ``tail`` bytes, ``digest`` of the name
    and ``start``, the window drawn first: the digest's first 8 bytes modulo ``n``."""
    planned = clips.select("name", "raw", F.expr(f"octet_length(raw) div {window}").alias("n"), F.expr(f"octet_length(raw) % {window}").alias("tail"), F.sha2(F.col("name").cast("binary"), 256).alias("digest"))
    return planned.where("n > 0").withColumn("start", F.expr("cast(cast(conv(substr(digest, 1, 16), 16, 10) as decimal(20, 0)) % n as bigint)"))


def _draws(plan: DataFrame, at) -> DataFrame:
    one = plan.select("name", "digest", "n", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("rnd"))
    return one.select("name", "digest", "n", "rnd", at.alias("chunk"))


def balanced_cap(clips: DataFrame, window: int, cap: int) -> DataFrame:
    """Round-robin over clips in digest order, each from its own start chunk on, up to
    ``cap`` windows: ``number, name, rnd, chunk``. A draw of round r is made only for clips
    with more than r windows, and of rounds only as many as the cap needs."""
    plan = clip_plan(clips, window)
    draws = _draws(plan, F.expr("(start + rnd) % n")).where(F.col("rnd") < cap)
    return _numbered(draws, cap)


def _numbered(draws: DataFrame, cap: int) -> DataFrame:
    first = draws.orderBy("rnd", "digest", "name").limit(cap)
    order = Window.orderBy("rnd", "digest", "name")
    return first.select(F.row_number().over(order).cast("long").alias("number"), "name", "rnd", "chunk").withColumn("number", F.col("number") - 1)


def round_robin_quota(clips: DataFrame, window: int, cap: int) -> DataFrame:
    """``name, quota``: how many of the first ``cap`` draws fall on each clip."""
    return balanced_cap(clips, window, cap).groupBy("name").agg(F.count("*").alias("quota"))


def spread_cap(clips: DataFrame, window: int, cap: int) -> DataFrame:
    """As :func:`balanced_cap`, but a clip's windows are spread over it evenly: with its
    quota q the k-th is ``(start + k * n div q) mod n``."""
    plan = clip_plan(clips, window).drop("raw")
    with_quota = plan.join(round_robin_quota(clips, window, cap), "name")
    rows = with_quota.select("name", "digest", "n", "start", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1)).alias("rnd"))
    return _numbered(rows.select("name", "digest", "n", "rnd", F.expr("(start + (rnd * n) div quota) % n").alias("chunk")), cap)


def spread_order(plan: DataFrame) -> DataFrame:
    """The whole order of each clip's windows: its ``quota`` evenly spread ones first, then
    the others from ``start`` on. ``name, n, start, quota`` to ``name, k, chunk``."""
    some = plan.select("name", "n", "start", "quota", F.explode(F.expr("sequence(0L, cast(quota as bigint) - 1)")).alias("k")).select("name", "quota", "k", F.expr("(start + (k * n) div quota) % n").alias("chunk"))
    every = plan.select("name", "n", "start", "quota", F.explode(F.expr("sequence(0L, cast(n as bigint) - 1)")).alias("j")).select("name", "quota", "j", F.expr("(start + j) % n").alias("chunk"))
    rest = every.join(some, ["name", "chunk"], "left_anti")
    late = rest.withColumn("k", F.col("quota") + F.row_number().over(Window.partitionBy("name").orderBy("j")) - 1)
    return some.select("name", "k", "chunk").unionByName(late.select("name", "k", "chunk"))


def tail_stats(df: DataFrame, window: int, *by: str, raw: str = "raw") -> DataFrame:
    size = F.coalesce(F.octet_length(raw).cast("long"), F.lit(0))
    return df.groupBy(*by).agg(F.sum(size).alias("bytes"), F.sum(F.expr(f"coalesce(octet_length(`{raw}`) div {window}, 0)")).alias("windows"), F.sum(size % window).alias("tail_bytes"), F.count_if(size < window).alias("too_short"))


def placed(df: DataFrame, key: str, order: str, raw: str = "raw", block: int = 1 << 12, unique: bool = False) -> DataFrame:
    """``df`` with ``at``, the byte at which each row begins in the concatenation of its key's
    rows by ``order``: sums within blocks of ``order``, from sums of the blocks before, so that a
    key with most rows is spread over many tasks. With ``unique``, an order that repeats within a
    key is an error."""
    rows = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_size", F.coalesce(F.octet_length(raw).cast("long"), F.lit(0).cast("long")))
    earlier = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(F.col(key).alias("_key"), F.col("_block").alias("_b")).agg(F.sum("_size").alias("_total"))
    bases = totals.select("_key", "_b", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(key, "_block").orderBy(order, raw)
    ranked = rows.withColumn("_within", F.coalesce(F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if unique:
        again = F.lag(order).over(within) == F.col(order)
        error = F.raise_error(F.concat(F.lit("repeated index in "), F.col(key).cast("string"))).cast("long")
        ranked = ranked.withColumn("_again", again).withColumn("_within", F.when(F.col("_again"), error).otherwise(F.col("_within")))
    joined = ranked.join(bases, F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_b")))
    return joined.select(*df.columns, (F.col("_base") + F.col("_within")).alias("at"))


def cut(pieces: DataFrame, key: str, window: int, raw: str = "raw") -> DataFrame:
    """Placed pieces to ``key, idx, payload``, the whole windows of each key's stream. Windows
    within one piece are cut there; only parts of those that cross pieces are brought together."""
    spans = pieces.select(key, raw, "at", (F.col("at") + F.octet_length(raw)).alias("end")).where("end > at")
    each = spans.select("*", F.explode(F.expr(f"sequence(at div {window}, (end - 1) div {window})")).alias("idx"))
    part = F.expr(f"substring(`{raw}`, cast(greatest(idx * {window}, at) - at + 1 as int), cast(least((idx + 1) * {window}, end) - greatest(idx * {window}, at) as int))")
    parts = each.select(key, "idx", "at", part.alias("payload"))
    whole = parts.where(F.octet_length("payload") == window).select(key, "idx", "payload")
    crossing = parts.where(F.octet_length("payload") < window).groupBy(key, "idx").agg(F.array_sort(F.collect_list(F.struct("at", "payload"))).alias("parts"))
    joined = crossing.select(key, "idx", F.expr("unhex(array_join(transform(parts, p -> hex(p.payload)), ''))").alias("payload"))
    return whole.unionByName(joined.where(F.octet_length("payload") == window))


def shard_bake(docs: DataFrame, window: int, total: int, shards: int) -> DataFrame:
    """``shard, doc_id, raw`` to the first windows of each shard's concatenated documents,
    ``total`` over all. Documents that begin beyond a shard's quota aren't cut."""
    wanted = quota(total, shards, F.col("shard"))
    needed = placed(docs.select("shard", "doc_id", "raw"), "shard", "doc_id").where(F.col("at") < wanted * window)
    return cut(needed, "shard", window).where(F.col("idx") < wanted)


def rechunk(pieces: DataFrame, window: int) -> DataFrame:
    """``stream, chunk_index, raw`` re-sliced: a stream's pieces joined in order (gaps are
    passed over, a repeated index is an error) and cut anew."""
    return cut(placed(pieces.select("stream", "chunk_index", "raw"), "stream", "chunk_index", unique=True), "stream", window)


#: The metadata that names a record's stream, the first that is there.
STREAM_KEYS = ("original_file", "subset", "global_shard")


def stream_key(*names: str):
    """The stream that a record belongs to, by the first of ``names`` that its metadata has."""
    return F.coalesce(*[F.when(F.col(f"metadata.{n}").isNotNull(), F.concat_ws("=", F.lit(n), F.col(f"metadata.{n}"))) for n in names or STREAM_KEYS])


# ---- validation


def validate_windows(df: DataFrame, window: int) -> DataFrame:
    """One row about ``id, sequence``: lengths and values, and the first bad row."""
    bad = F.size("sequence") != window
    return df.agg(F.count("*").alias("rows"), F.count_if(bad).alias("bad_rows"), F.min(F.when(bad, F.col("id"))).alias("first_bad"), F.max(F.array_max("sequence")).alias("max_token"), F.min(F.array_min("sequence")).alias("min_token"))


def require_valid(df: DataFrame, window: int, vocab: int = 256) -> None:
    r = validate_windows(df, window).first()
    if not r["rows"]:
        raise ValueError("no windows")
    if r.bad_rows:
        raise ValueError(f"{r.bad_rows} windows aren't {window} long; the first is {r.first_bad}")
    if r.max_token >= vocab or r.min_token < 0:
        raise ValueError(f"tokens from {r.min_token} to {r.max_token} don't fit a vocabulary of {vocab}")


def require_suite(specs: DataFrame) -> None:
    """Corpora ``name, context_length``: not empty, unique names, one context length."""
    r = specs.agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_distinct("context_length").alias("lengths")).first()
    if not r.n or r.names != r.n or r.lengths != 1:
        raise ValueError("a suite needs corpora with unique names and one context length")
