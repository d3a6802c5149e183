"""Melodies on a grid of cells: skyline of notes, tokens back to notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Pitches are 0 to 127; then hold, rest and the end marker.
HOLD, REST, END = 128, 129, 130


def quantize(ticks, quarter, steps: int = 4):
    """Ticks to sixteenth-note cells, halves up."""
    return F.floor((2 * ticks * steps + quarter) / (2 * quarter)).cast("long")


def skyline(notes: DataFrame, cells: int = 4095) -> DataFrame:
    """``piece, nid, pitch, start, stop`` (cells) to ``piece, cell, token``: in each cell the
    note with the largest (pitch, raw start, id); HOLD while it is the one before, REST where
    none sounds. Notes that collapse to no cell are dropped; ``raw`` is the unquantized start."""
    sounding = notes.where(f"stop > start and start < {cells}").select("piece", "nid", "pitch", "raw", F.explode(F.expr(f"sequence(start, least(stop, {cells}) - 1)")).alias("cell"))
    top = sounding.groupBy("piece", "cell").agg(F.max(F.struct("pitch", "raw", "nid")).alias("top"))
    length = notes.where("stop > start").groupBy("piece").agg(F.max("stop").alias("length"))
    grid = length.select("piece", F.explode(F.expr(f"sequence(0L, least(length, {cells}L) - 1)")).alias("cell"))
    by = Window.partitionBy("piece").orderBy("cell")
    held = grid.join(top, ["piece", "cell"], "left").withColumn("before", F.lag("top.nid").over(by))
    token = F.when(F.col("top").isNull(), REST).when(F.col("top.nid") == F.col("before"), HOLD).otherwise(F.col("top.pitch"))
    return held.select("piece", "cell", token.cast("int").alias("token"))


def to_notes(tokens: DataFrame) -> DataFrame:
    """``piece, cell, token`` back to ``piece, start, stop, pitch``: gaps and islands. A hold
    without a note before it is an error."""
    by = Window.partitionBy("piece").orderBy("cell")
    run = tokens.withColumn("g", F.sum(F.when(F.col("token") != HOLD, 1).otherwise(0)).over(by))
    islands = run.groupBy("piece", "g").agg(F.min("cell").alias("start"), (F.max("cell") + 1).alias("stop"), F.min_by("token", "cell").alias("pitch"), F.count("*").alias("n"))
    bad = (F.col("pitch") == HOLD) | ((F.col("pitch") > HOLD) & (F.col("n") > 1))
    checked = islands.withColumn("pitch", F.when(~bad, F.col("pitch")).otherwise(F.raise_error("a hold without a note").cast("int")))
    return checked.where("pitch <= 127").select("piece", "start", "stop", "pitch")


def token_stats(tokens: DataFrame) -> DataFrame:
    onset = F.col("token") <= 127
    return tokens.groupBy("piece").agg(F.count_if(onset).alias("onsets"), F.count_if(F.col("token") == HOLD).alias("holds"), F.count_if(F.col("token") == REST).alias("rests"), F.count_if(F.col("token") == END).alias("ends"), F.min(F.when(onset, F.col("token"))).alias("lowest"), F.max(F.when(onset, F.col("token"))).alias("highest"))
