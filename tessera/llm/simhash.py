"""SimHash near-duplicate groups by deletion-variant signatures.

*Fingerprint.* A-Z lower-cased, words without ASCII white space, shingles of
``words`` words joined by one space, repeats included; a text with fewer words is one
shingle, one without words has fingerprint 0. A fingerprint bit is 1 if it is set in
over half of the shingles' XXH64 values (seed 42).

*Links.* Two fingerprints link if at most 3 of their 64 bits differ. Cut into only two
segments of 32 bits, at least one segment then differs by at most one bit. Every segment
is indexed under its 32 variants with one bit deleted (a wildcard): segments that differ
by at most one bit share a variant. Fingerprints that share a key are verified on all 64
bits. Equal segments are compared under the first wildcard alone, others under the
wildcard of the bit that differs.

*Skew.* Equal fingerprints are one row before any key is made, so copies, however many,
cost nothing. A key's fingerprints never become all their pairs: the kernel writes the
edges of a spanning forest. A key with more than ``run_cap`` different fingerprints is
cut again, by the variants of its other segment's halves, and such a key can hold no more
than 2**18 fingerprints.

Null texts count as empty, and empty texts link with each other and with whatever else
is within 3 bits of 0. Repeated rows are kept. A null ``doc_id`` takes part in links but
never names a component that has another id.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkern as K
from tessera.llm.common import pick, prepare, slices, stash, unstash
from tessera.llm.components import components

BITS = 3
RUN_CAP = 1 << 16
_SMALL = 1024
_LANES = sum(((np.arange(256, dtype=np.uint64) >> np.uint64(b)) & np.uint64(1)) << np.uint64(8 * b) for b in range(8))


def shingle_hashes(texts: list[str | None], words: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles, text after text, and the number of them in every text."""
    w = K.Words(K.encode(texts, lower=True))
    n = w.counts()
    if not len(w.start):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    starts = K.window_starts(w, words)
    short = np.flatnonzero((n > 0) & (n < words))
    start = np.concatenate((w.start[starts], w.start[w.first[short]]))
    end = np.concatenate((w.end[starts + words - 1], w.end[w.first[short + 1] - 1]))
    doc = np.concatenate((w.text_of()[starts], short))
    order = np.argsort(doc, kind="stable")
    return K.xxh64(w.buf, start, end)[order], np.bincount(doc, minlength=len(texts))


def majority(h: np.ndarray, total: np.ndarray) -> np.ndarray:
    """For every text the bits set in over half of its hashes."""
    out = np.zeros(len(total), np.uint64)
    if not len(h):
        return out
    has = np.flatnonzero(total)
    # up to 255 values are added in the eight byte lanes of one integer
    parts = -(-total[has] // 255)
    begin = np.cumsum(total[has]) - total[has]
    before = np.cumsum(parts) - parts
    cut = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(before, parts))
    octets = h.view(np.uint8).reshape(-1, 8)
    for j in range(8):
        lanes = np.add.reduceat(_LANES[octets[:, j]], cut).view(np.uint8).reshape(-1, 8)
        bits = np.add.reduceat(lanes.astype(np.int64), before, axis=0) * 2 > total[has][:, None]
        out[has] |= (bits.astype(np.uint64) << np.arange(8 * j, 8 * j + 8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(texts: list[str | None], words: int = 3) -> np.ndarray:
    """The 64-bit fingerprint of every text."""
    return majority(*shingle_hashes(texts, words))


def with_fingerprint_rows(docs: DataFrame, words: int = 3) -> DataFrame:
    """``docs`` (its columns in the struct ``row``) with ``fp``, a signed long."""
    prepare(docs.sparkSession)
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = fingerprints(b.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["row", "fp"])

    return base.mapInArrow(run, T.StructType([base.schema["row"], T.StructField("fp", T.LongType())]))


def with_fingerprint(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint of every row, as a signed long."""
    prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = fingerprints(b.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class _Forest:
    """Disjoint sets over the fingerprints of one key."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _near(fps: np.ndarray, ids: np.ndarray, sets: _Forest, edges: list) -> None:
    """Join whatever links among ``ids``, a block of rows at a time."""
    for lo in range(0, len(ids) - 1, 256):
        a = ids[lo : lo + 256]
        rest = ids[lo:]
        i, j = np.nonzero(np.bitwise_count(fps[a][:, None] ^ fps[rest][None, :]) <= BITS)
        for x, y in zip(a[i[i < j]].tolist(), rest[j[i < j]].tolist(), strict=True):
            if sets.join(x, y):
                edges.append((x, y))


def _link(fps: np.ndarray, ids: np.ndarray, free: tuple[int, int], sets: _Forest, edges: list) -> None:
    """Join all linked ``ids``. Beyond a few, the segment ``free`` (shift, width), in
    which all but one of the differences lie, is halved: one half differs by at most one
    bit, so linked fingerprints meet under a variant of it."""
    shift, width = free
    if len(ids) <= _SMALL or width <= 8:
        return _near(fps, ids, sets, edges)
    half = width // 2
    for s, other in ((shift, shift + half), (shift + half, shift)):
        part = (fps[ids] >> np.uint64(s)) & np.uint64((1 << half) - 1)
        for bit in range(half):
            key = part & np.uint64(~(1 << bit) & ((1 << half) - 1))
            order = np.argsort(key, kind="stable")
            cut = np.flatnonzero(np.diff(key[order])) + 1
            for group in np.split(order, cut):
                if len(group) > 1 and len({sets.root(x) for x in ids[group].tolist()}) > 1:
                    _link(fps, ids[group], (other, half), sets, edges)


def _edges_of(keys: np.ndarray, fps: np.ndarray, level: int, cap: int) -> Iterator[tuple]:
    """Edges of all complete runs of equal keys; a run over ``cap`` is returned as it is."""
    cut = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
    size = np.diff(cut)
    two = cut[:-1][size == 2]
    a, b = fps[two], fps[two + 1]
    ok = np.bitwise_count(a ^ b) <= BITS
    yield a[ok], b[ok], None
    for lo, n in zip(cut[:-1][size > 2], size[size > 2], strict=True):
        run = fps[lo : lo + n]
        k = int(keys[lo]) >> 32 if level == 1 else 0
        if level == 1 and k % 32:
            bit = np.uint64(k)  # the deleted bit; equal segments were compared under bit 0
            set_ = (run >> bit) & np.uint64(1)
            if set_.min() == set_.max():
                continue
        if n > cap:
            yield run, np.full(n, keys[lo], np.uint64), n
            continue
        edges: list = []
        free = (0 if k >= 32 else 32, 32) if level == 1 else (0, 64)
        _link(run, np.arange(n), free, _Forest(n), edges)
        if edges:
            e = np.array(edges)
            yield run[e[:, 0]], run[e[:, 1]], None


def _finder(level: int, cap: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_k, keep_f = [], []
        pending, spilling = 0, None

        def out(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a, b, over in _edges_of(keys, fps, level, cap):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.full(len(a), over is not None))], ["a", "b", "over"])

        def full(key: np.uint64, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(fps):
                yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(np.full(len(fps), key).view(np.int64)), pa.array(np.full(len(fps), True))], ["a", "b", "over"])

        for batch in batches:
            k = batch.column(0).to_numpy().view(np.uint64)
            f = batch.column(1).to_numpy().view(np.uint64)
            if spilling is not None:  # the rest of a run that is over the cap
                n = int(np.searchsorted(k, spilling, "right"))
                yield from full(spilling, f[:n])
                k, f = k[n:], f[n:]
                if not len(k):
                    continue
                spilling = None
            keep_k.append(k)
            keep_f.append(f)
            pending += len(k)
            if k[-1] == keep_k[0][0] and pending > cap:
                spilling = k[-1]
                for part in keep_f:
                    yield from full(spilling, part)
                keep_k, keep_f, pending = [], [], 0
                continue
            if pending < 1 << 15 or k[-1] == keep_k[0][0]:
                continue
            k, f = np.concatenate(keep_k), np.concatenate(keep_f)
            done = np.searchsorted(k, k[-1])
            yield from out(k[:done], f[:done])
            keep_k, keep_f, pending = [k[done:]], [f[done:]], len(k) - done
        if keep_k:
            yield from out(np.concatenate(keep_k), np.concatenate(keep_f))

    return run


def _variants(fps: DataFrame) -> DataFrame:
    """``key, fp``: 2 segments x 32 wildcards. The key holds the wildcard's number above the segment."""
    k = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")
    segment = "(shiftrightunsigned(fp, (k div 32) * 32) & 4294967295L)"
    return fps.select("fp", k).select(F.expr(f"shiftleft(cast(k as bigint), 32) | ({segment} & ~shiftleft(1L, k % 32))").alias("key"), "fp")


def _variants_again(over: DataFrame) -> DataFrame:
    """The same for the halves of the other segment of keys that are too full; ``b`` is the key."""
    k = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("k")
    segment = "(shiftrightunsigned(a, if(shiftrightunsigned(b, 32) >= 32, 0, 32) + (k div 16) * 16) & 65535L)"
    return over.select("a", "b", k).select(F.expr(f"xxhash64(b, k, {segment} & ~shiftleft(1L, k % 16))").alias("key"), F.col("a").alias("fp"))


def links(fps: DataFrame, run_cap: int = RUN_CAP) -> DataFrame:
    """``a, b``: links between different fingerprints (column ``fp``) that connect
    exactly what all pairs within 3 bits connect."""
    prepare(fps.sparkSession)
    schema = "a long, b long, over boolean"

    def find(keyed: DataFrame, level: int, cap: int) -> DataFrame:
        conf = fps.sparkSession.conf
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
        found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_finder(level, cap), schema)
        try:
            return stash(found.distinct(), "near")
        finally:
            prepare(fps.sparkSession)

    first = find(_variants(fps), 1, run_cap)
    over = first.where("over")
    edges, tables = first.where("not over").select("a", "b"), [first]
    if not over.isEmpty():
        second = find(_variants_again(over).distinct(), 2, 1 << 62)
        edges, tables = edges.unionByName(second.select("a", "b")), [first, second]
    edges._stashes = tables
    return edges


def near_groups(docs: DataFrame, words: int = 3, run_cap: int = RUN_CAP) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``: the smallest ``doc_id``
    that links lead to. The fingerprints are stashed, links and labels stay distributed."""
    rows = stash(with_fingerprint(docs, words), "fingerprints")
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("own"))
    near = links(own.select("fp"), run_cap)
    label = components(near)
    unstash(near)
    named = own.join(label, own.fp == label.node, "left").select("fp", "own", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("own").alias("component_id"))
    by_fp = named.join(least, "label").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
