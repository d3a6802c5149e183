"""Session settings, shared-folder tables and Arrow batch helpers of the subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch; texts can be long, so batches stay short.
BATCH_ROWS = 512
#: Bytes of text that a kernel works on at once.
BATCH_BYTES = 2 << 20
#: Frees a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the
    context's own. Where neither is set, a temporary one in local mode; on a cluster an error,
    for no folder of one machine would do."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if current is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names the folder that driver and executors share; it isn't set")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Short Arrow batches for columns of whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    shared_dir(spark)


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage: a lost executor costs the tasks it ran, not the plan above; and
    once the table is written, nothing needs the shuffle files that led to it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(df: DataFrame) -> None:
    """Delete what :func:`stash` wrote, or the tables (``_stashes``) that a frame is made of;
    nothing may read them any more."""
    path = getattr(df, "_stash_path", None)
    for part in getattr(df, "_stashes", ()):
        unstash(part)
    if path:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that others, whatever their names, can't clash."""
    return df.select(*[df[n] for n in names])


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``most`` bytes of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        size = b.column(b.schema.names.index(text)).nbytes
        if size <= most or b.num_rows == 1:
            yield b
            continue
        lengths = pc.fill_null(pc.binary_length(b.column(b.schema.names.index(text))), 0).to_pylist()
        begin = total = 0
        for i, n in enumerate(lengths):
            if i > begin and total + n > most:
                yield b.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        yield b.slice(begin)


def arrow_rows(schema: str, *columns: list) -> pa.Table:
    """A table with the columns of a simple schema string."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([c if isinstance(c, pa.Array) else pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as their bytes of least weight first, then the next: what is zero in all is left out, what is in most compresses."""
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
    used = max(1, 8 - int(np.argmax(planes.any(axis=1)[::-1]))) if planes.any() else 1
    return bytes([used]) + planes[:used].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.reshape(-1).view("<u8")


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
