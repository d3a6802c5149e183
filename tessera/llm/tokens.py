"""Documents as token ids: encode and decode, cut into pieces, pack into sequences.

:func:`encode_documents` is a map over rows; :func:`document_pieces` cuts documents that
are longer than a sequence; :func:`pack_minimum_slack` and :func:`pack_best_fit` are two
ways to pack pieces. Null texts count as empty; repeated rows are kept and packed each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import default_path, load
from tessera.llm.common import pick, prepare, slices, stash

CAPACITY = 2048


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids`` (little-endian unsigned 32-bit) and ``decoded``."""
    prepare(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in slices(batches, most=1 << 20):
            ids = bpe.encode_batch(b.column(1).to_pylist())
            cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full ones after a
    first piece that takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return [(0, head)] * (head > 0) + [(s, capacity) for s in range(head, n, capacity)]


def document_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every document's ids, then ``end_id``, in pieces of at most ``capacity``:
    ``doc_id, piece, start, length, ids_crc32`` (and ``ids``), plus ``part, local``: the
    task that made the piece and its number among the task's pieces of that length."""
    prepare(docs.sparkSession)
    path = path or default_path()
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local", *["ids"] * with_ids]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in slices(batches, most=1 << 20):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), bpe.encode_batch(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * s : 4 * (s + n)]
                    rows.append((doc_id, k, s, n, zlib.crc32(own), part, int(seen[n]), *[own] * with_ids))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long" + ", ids binary" * with_ids
    return pick(docs, "doc_id", "text").mapInArrow(run, schema)


# ---- minimum bin slack


def slack_patterns(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Bins for so many pieces of each length: (what a bin holds, how many such bins).

    Minimum bin slack: each bin takes the largest length left, then the fullest feasible
    combination of what is left beside it, found by subset sums in a bitset (bit s of an
    integer: sum s can be made). The combination is taken as often as the counts allow, so
    every step uses up a length: at most ``capacity`` steps, whatever the number of
    pieces."""
    left = {n: c for n, c in counts.items() if c > 0 and n > 0}
    if left and max(left) > capacity:
        raise ValueError("a piece is longer than a bin")
    bins = []
    while left:
        lengths = sorted(left, reverse=True)
        seed = lengths[0]
        room = capacity - seed
        full = (1 << (room + 1)) - 1
        reach, layers = 1, []
        for n in lengths:
            most = min(left[n] - (n == seed), room // n)
            step = 1
            while most > 0 and not reach >> room & 1:
                k = min(step, most)  # binary splitting: k pieces of this length at once
                layers.append((n, k, reach))
                reach |= (reach << (n * k)) & full
                most -= k
                step *= 2
            if reach >> room & 1:
                break
        total = reach.bit_length() - 1
        take = {seed: 1}
        for n, k, before in reversed(layers):
            if not before >> total & 1:
                take[n] = take.get(n, 0) + k
                total -= n * k
        times = min(left[n] // k for n, k in take.items())
        for n, k in take.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        bins.append((sorted(take.items(), reverse=True), times))
    return bins


def _slots(bins: list, shift: int) -> dict[str, np.ndarray]:
    """For each length its ranks in order: which pattern, from which bin and offset on."""
    rows, given, base = [], {}, 0
    for what, times in bins:
        offset = 0
        for n, k in what:
            rows.append(((n << shift) | given.get(n, 0), given.get(n, 0), k, base, offset))
            given[n] = given.get(n, 0) + k * times
            offset += n * k
        base += times
    table = np.array(sorted(rows) or [(0, 0, 1, 0, 0)], np.int64)
    return dict(zip(("key", "from", "each", "base", "offset"), table.T, strict=True))


def pack_minimum_slack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` plus ``sequence_id`` and ``offset``, gapless from 0 in each sequence.

    What is planned on the driver is the histogram of lengths, at most ``capacity`` rows.
    A piece's rank among those of its length is its number within its task plus the counts
    of the tasks before (the pieces are stashed, so both stay as they are); rank and length
    then name the place. No length's pieces meet in one task."""
    pieces = stash(pieces, "pieces")
    sums = pieces.groupBy("part", "length").agg((F.max("local") + 1).alias("n"))
    from pyspark.sql import Window

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sums = stash(sums.select("part", "length", "n", F.coalesce(before, F.lit(0)).alias("before")), "counts")
    counts = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shift = 44
    slots = _slots(slack_patterns(counts, capacity), shift)
    names = pieces.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.names.index(c)).to_numpy() for c in ("length", "_rank"))
            at = np.searchsorted(slots["key"], (length << shift) | rank, "right") - 1
            k = rank - slots["from"][at]
            sequence = slots["base"][at] + k // slots["each"][at]
            offset = slots["offset"][at] + (k % slots["each"][at]) * length
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    # the counts grow with the number of tasks: one way to join them at every size, never a broadcast
    ranked = pieces.join(sums.select("part", "length", "before").hint("merge"), ["part", "length"]).select(*names, (F.col("local") + F.col("before")).alias("_rank"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


# ---- best fit decreasing


class CapacityTree:
    """Open bins by room left, with a segment tree to find the tightest that fits."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)  # bins below each node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.open[i] += n
            i >>= 1

    def put(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The room and number of a bin with the least room of at least ``need``."""
        i = need + self.size
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.open[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices of ``lengths``: longest first, each into the tightest bin."""
    tree, bins = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        if found is None:
            found = capacity, len(bins)
            bins.append([])
        room, b = found
        bins[b].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], b)
    return bins


def pack_best_fit(docs: DataFrame, capacity: int = CAPACITY, end_id: int | None = None, pad_id: int = 0, buffer_tokens: int = 1 << 21, path: str | None = None) -> DataFrame:
    """Packed rows of token ids, by best-fit-decreasing within buffers of a task.

    One row for each sequence: ``sequence_id``; ``ids`` (``capacity`` little-endian 32-bit
    ids, padded with ``pad_id``); ``positions`` (32-bit, from 0 in each segment and in the
    padding); ``n_tokens``; ``cu_seqlens`` (0 and the end of each segment); ``doc_ids``,
    ``pieces`` and ``starts`` of the segments. Each document ends with ``end_id`` (null: the
    tokenizer's first added token); longer ones are cut without loss. A task packs as many documents as
    ``buffer_tokens`` hold, so memory doesn't grow with the input and nothing is shuffled;
    only the last bins of a buffer have room left."""
    prepare(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        end = np.array([min(bpe.special.values(), default=0) if end_id is None else end_id], "<u4").tobytes()
        pad = np.array([pad_id], "<u4").tobytes()
        made = TaskContext.get().partitionId() << 32
        step = np.arange(capacity, dtype="<u4")
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, held, size
            bins = best_fit_decreasing([p[3] for p in held], capacity)
            for lo in range(0, len(bins), 256):
                rows = []
                for b in bins[lo : lo + 256]:
                    own = [held[i] for i in b]
                    stops = np.cumsum([0, *(p[3] for p in own)])
                    n = int(stops[-1])
                    ids = b"".join(p[4] for p in own) + pad * (capacity - n)
                    starts = np.repeat(stops[:-1], np.diff(stops))
                    positions = np.concatenate((step[:n] - starts, step[: capacity - n])).astype("<u4")
                    rows.append((made, ids, positions.tobytes(), n, stops.tolist(), [p[0] for p in own], [p[1] for p in own], [p[2] for p in own]))
                    made += 1
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["sequence_id", "ids", "positions", "n_tokens", "cu_seqlens", "doc_ids", "pieces", "starts"])
            held, size = [], 0

        for b in slices(batches, most=1 << 20):
            for doc_id, ids in zip(b.column(0).to_pylist(), bpe.encode_batch(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, (s, n) in enumerate(cut(len(ids) // 4, capacity)):
                    held.append((doc_id, k, s, n, ids[4 * s : 4 * (s + n)]))
                size += len(ids) // 4
                if size >= buffer_tokens:
                    yield from flush()
        yield from flush()

    schema = "sequence_id long, ids binary, positions binary, n_tokens int, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"
    return pick(docs, "doc_id", "text").mapInArrow(run, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """The packed matrices as Parquet files, one row for each sequence."""
    packed.write.parquet(path)
