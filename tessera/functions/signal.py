"""Audio and pixels: 8-bit quantizers, decimating filters, channel interleave."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pcm8(sample):
    """8-bit value of a sample in -1..1: floor((clip(32768 x) + 32768) / 256)."""
    x = F.greatest(F.least(sample.cast("double") * 32768, F.lit(32767.0)), F.lit(-32768.0))
    return F.floor((x + 32768) / 256).cast("int")


def pcm16_to_pcm8(samples: np.ndarray) -> bytes:
    """The high byte of each 16-bit sample, offset to be unsigned."""
    return ((samples.astype(np.int32) >> 8) + 128).astype(np.uint8).tobytes()


def lowpass(down: int, taps: int) -> np.ndarray:
    """A windowed-sinc filter with unit gain for decimation by ``down`` (odd ``taps``)."""
    n = np.arange(taps) - taps // 2
    h = np.sinc(n / down) * np.kaiser(taps, 5.0)
    return h / h.sum()


def decimate(x: np.ndarray, taps: np.ndarray, down: int) -> np.ndarray:
    """Centred filter with zero padding, then every ``down``-th sample: ceil(n / down) of them."""
    full = np.convolve(np.asarray(x, np.float64), taps)
    mid = len(taps) // 2
    return full[mid : mid + len(x) : down]


def decimate_column(df: DataFrame, column: str, taps: np.ndarray, down: int) -> DataFrame:
    """An array column, decimated in Arrow batches."""
    at = df.columns.index(column)
    schema = ", ".join(f"`{f.name}` {'array<double>' if f.name == column else f.dataType.simpleString()}" for f in df.schema)

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([None if x is None else decimate(np.array(x), taps, down).tolist() for x in cols[at].to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return df.mapInArrow(run, schema)


def interleave(column: str, channels: int = 3):
    """Planar values (all of channel 0, then 1, …) to one value of each channel in turn."""
    return F.expr(f"transform(sequence(0, size(`{column}`) - 1), i -> `{column}`[(i % {channels}) * (size(`{column}`) div {channels}) + i div {channels}])")
