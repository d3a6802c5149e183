"""Near-copy groups: SimHash links, and an exact join of shingle sets for what they miss.

Two rows are linked if their SimHash fingerprints differ in 3 bits at most (``simhash``),
or if the Jaccard similarity of their sets of shingles is ``least`` or more. Equal sets are
one class, named by 128 bits, before any key is made.

*Order.* All sets are put in one order of shingles: by the number of classes that hold
them, then by hash. That number is exact but for a share of about 2**-8 of the shingles,
whose shortened keys meet others and which then count as more frequent, in every set
alike, so any link is found all the same. It comes from one exchange of packed keys: a
group of texts sends each of its shingles once, a shard adds up what all groups sent, and
the answers (the logarithm of the number, 4 bits) go back in the order sent.

*Candidates.* Similar sets share one of the first ``n - ceil(least * n) + 1`` shingles of
each. Shingles that one class alone holds make no candidate and are left out, though they
keep their places: so texts that nothing resembles, most of them, send nothing further.

*Groups.* First each class meets the leader of the classes that share one of its
``LEADERS`` min-hashes: the one with the most common shingles on average, for that is the
original of many copies or the least changed of them. These few pairs for each class join
most of a group of copies however large. After that only classes of different components can still add a
link. Those that share an indexed shingle become a pair if their sizes and their places in
both orders leave room for enough common shingles; keys whose classes are all of one
component are left out before. A key of more than ``KEY_BLOCK`` classes is cut into blocks
that meet in pairs, in separate tasks. Nothing is capped.

*Verification.* Pairs are compared on their whole sets.

Null and empty texts have no shingles: they link through their fingerprint 0 alone.
Repeated rows are kept. A row without ``doc_id`` takes part like any other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import simhash
from tessera.llm import textkern as K
from tessera.llm.common import arrow_rows, pack_sorted, prepare, slices, stash, unpack_sorted, unstash
from tessera.llm.components import components

LEAST = 0.8
LEADERS = 4
KEY_BLOCK = 4096
#: Bytes of text of a group, and how many groups' shingles a shard adds up.
GROUP_BYTES = 4 << 20
SHARD_GROUPS = 4


def distinct_hashes(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, and the sorted set of shingle hashes of every text with its size."""
    h, total = simhash.shingle_hashes(texts, words)
    fp = simhash.majority(h, total)
    doc = np.repeat(np.arange(len(total)), total)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return fp, h[first], np.bincount(doc[first], minlength=len(total))


def set_names(h: np.ndarray, n: np.ndarray) -> pa.BinaryArray:
    """16 bytes that name each set; those of empty sets are null."""
    has, parts = np.flatnonzero(n), []
    for key in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        name = K.mix(n.astype(np.uint64) * np.uint64(key))
        if len(h):
            name[has] += np.add.reduceat(K.mix(h * np.uint64(key)), (np.cumsum(n) - n)[has])
        parts.append(name)
    raw = np.stack(parts, axis=1).tobytes()
    return pa.array([raw[16 * i : 16 * i + 16] if k else None for i, k in enumerate(n.tolist())], pa.binary())


def prefix_length(n, least: float):
    """How many shingles of a set of ``n`` are looked at."""
    return np.where(n > 0, n - np.ceil(least * n - 1e-9).astype(np.int64) + 1, 0)


def _lists(values: np.ndarray, size: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(values))


def with_names(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, fp, sk, n`` for every row: fingerprint, name and size of the shingle set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp, h, n = distinct_hashes(b.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), set_names(h, n), pa.array(n.astype(np.int32))], ["doc_id", "fp", "sk", "n"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, fp long, sk binary, n int")


def _dealt_texts(docs: DataFrame, groups: int) -> DataFrame:
    """``pid, text``: the texts' words, each different text once a task, in groups by their hash."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in slices(batches, "text"):
            pids, texts = [], []
            for t in K.encode(b.column(0).to_pylist(), lower=True):
                words = b" ".join(t.split())
                name = xxhash.xxh3_128_intdigest(words)
                if words and name not in seen:
                    seen.add(name)
                    pids.append(name % groups)
                    texts.append(words.decode("utf-8", "surrogatepass"))
            if pids:
                yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int32()), pa.array(texts, pa.string())], ["pid", "text"])

    return docs.select(docs["text"].alias("text")).mapInArrow(run, "pid int, text string")


def candidates(docs: DataFrame, words: int, least: float, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``sk, n, score, keys, places, leaders, hashes`` of every class with an indexed shingle
    that another class holds: the mean level of its shingles, the indexed ones and their
    places in the order, min-hashes, whole set."""
    total = docs.agg(F.sum(F.octet_length(docs["text"]).cast("long"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    shards = max(1, groups // SHARD_GROUPS)
    cut = np.uint64(64 - min(60, max(32, (total // 6 + 1).bit_length() + 8)))
    base = _dealt_texts(docs, groups)
    sent, said = "shard int, pid int, keys binary, many binary", "pid int, shard int, levels binary"
    out = "sk binary, n int, score double, keys array<long>, places array<int>, leaders array<long>, hashes array<long>"

    def sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts = [distinct_hashes(b.column(0).to_pylist(), words)[1:] for b in slices(pa.table({"text": sorted(set(table["text"].to_pylist()))}).to_batches())]
        return np.concatenate([h for h, _ in parts]), np.concatenate([n for _, n in parts])

    def bounds(keys: np.ndarray) -> np.ndarray:
        """Where each shard's part of the sorted keys begins."""
        part = ((keys << cut) >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
        return np.searchsorted(part, np.arange(shards + 1).astype(np.uint64))

    def send(table: pa.Table) -> pa.Table:
        keys, n = np.unique(sets(table)[0] >> cut, return_counts=True)
        at = bounds(keys)
        some = np.flatnonzero(np.diff(at)).tolist()
        pid = table["pid"][0].as_py()
        return arrow_rows(sent, some, [pid] * len(some), [pack_sorted(keys[at[s] : at[s + 1]]) for s in some], [np.packbits(n[at[s] : at[s + 1]] > 1).tobytes() for s in some])

    def count(table: pa.Table) -> pa.Table:
        parts = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        more = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(k)] for k, x in zip(parts, table["many"].to_pylist(), strict=True)]
        key, inv = np.unique(np.concatenate(parts), return_inverse=True)
        df = np.bincount(inv, 1.0 + np.concatenate(more), len(key))
        level = np.minimum(np.log2(df).astype(np.uint8), 15)[inv]
        stops, levels = np.cumsum([0, *map(len, parts)]), []
        for a, b in zip(stops[:-1], stops[1:], strict=True):
            own = np.concatenate((level[a:b], np.zeros((b - a) % 2, np.uint8)))
            levels.append((own[::2] << 4 | own[1::2]).tobytes())
        return arrow_rows(said, table["pid"].to_pylist(), table["shard"].to_pylist(), levels)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        h, n = sets(table) if table.num_rows else (np.empty(0, np.uint64), np.empty(0, np.int64))
        keys, inv = np.unique(h >> cut, return_inverse=True)
        at, level = bounds(keys), np.zeros(len(keys), np.uint8)
        for s, x in zip(answers["shard"].to_pylist(), answers["levels"].to_pylist(), strict=True):
            both = np.frombuffer(x, np.uint8)
            level[at[s] : at[s + 1]] = np.stack((both >> 4, both & 15), axis=1).reshape(-1)[: at[s + 1] - at[s]]
        level = level[inv]
        doc, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        order = np.lexsort((K.mix(h), level, doc))
        place = np.arange(len(h)) - np.repeat(begin, n)
        held = (place < np.repeat(prefix_length(n, least), n)) & (level[order] > 0)
        kept = np.bincount(doc[held], minlength=len(n))
        own = np.flatnonzero(kept)
        if not len(own):
            return arrow_rows(out, *[[]] * 7)
        inside = np.repeat(kept > 0, n)
        whole, size = h[inside], n[own]
        low = [np.minimum.reduceat(K.mix(whole ^ K.mix(np.array([i + 1], np.uint64))), np.cumsum(size) - size) for i in range(LEADERS)]
        leaders = np.stack(low, axis=1).reshape(-1) if LEADERS else np.empty(0, np.uint64)
        score = np.add.reduceat(level[inside].astype(np.float64), np.cumsum(size) - size) / size
        columns = set_names(whole, size), size.astype(np.int32), score, _lists(h[order][held].view(np.int64), kept[own]), _lists(place[held].astype(np.int32), kept[own]), _lists(leaders.view(np.int64), np.full(len(own), LEADERS)), _lists(whole.view(np.int64), size)
        return arrow_rows(out, *columns)

    answers = base.groupBy("pid").applyInArrow(send, sent).groupBy("shard").applyInArrow(count, said)
    # texts of equal sets can be in several groups
    return base.groupBy("pid").cogroup(answers.groupBy("pid")).applyInArrow(finish, out).dropDuplicates(["sk"])


def _pairer(least: float):
    """Rows ``key, n, place, label, sk, one, two`` sorted by key and pair of blocks to pairs
    ``a, b`` of different labels that may be similar."""

    def find(key: np.ndarray, n: np.ndarray, place: np.ndarray, label: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of both rows of each pair, in runs of equal keys."""
        left, right = [], []
        cut = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        room, need = n - place, least / (1 + least)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            for a in range(lo, hi, 512):
                i = np.arange(a, min(a + 512, hi))[:, None]
                j = np.arange(a, hi)[None, :]
                fit = (i < j) & (label[i] != label[j]) & (other[i] != other[j])
                fit &= np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
                # the first common shingle is followed by no more than the rest of one of the two
                fit &= np.minimum(room[i], room[j]) >= need * (n[i] + n[j]) - 1e-9
                x, y = np.nonzero(fit)
                left.append(x + a)
                right.append(y + a)
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            g, n, place, label, side = (rows[c].to_numpy() for c in ("g", "n", "place", "label", "side"))
            i, j = find(g, n.astype(np.int64), place.astype(np.int64), label, side)
            if len(i):
                names, at = np.unique(np.array(rows["sk"].to_pylist(), "S16"), return_inverse=True)
                a, b = np.divmod(np.unique(np.minimum(at[i], at[j]) * len(names) + np.maximum(at[i], at[j])), len(names))
                whole = [x.ljust(16, b"\0") for x in names.tolist()]  # NumPy takes off the last zeros
                yield pa.RecordBatch.from_arrays([pa.array([whole[k] for k in c.tolist()], pa.binary()) for c in (a, b)], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            g = rows["g"].to_numpy()
            done = int(np.flatnonzero(g != g[-1])[-1]) + 1 if g[0] != g[-1] else 0
            if done:
                yield from out(rows.slice(0, done).combine_chunks())
            held = rows.slice(done)
        if held is not None:
            yield from out(held.combine_chunks())

    return run


def _alike(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """``a, b``: nodes of the pairs of classes whose whole sets are similar."""
    a = classes.select(F.col("sk").alias("a"), F.col("node").alias("x"), F.col("hashes").alias("ha"))
    b = classes.select(F.col("sk").alias("b"), F.col("node").alias("y"), F.col("hashes").alias("hb"))
    both = pairs.join(a, "a").join(b, "b").withColumn("k", F.size(F.array_intersect("ha", "hb")))
    return both.where(F.col("k") >= least * (F.size("ha") + F.size("hb") - F.col("k")) - 1e-9).select(F.col("x").alias("a"), F.col("y").alias("b"))


def _leader_pairs(classes: DataFrame) -> DataFrame:
    each = classes.select("sk", "score", F.explode("leaders").alias("key"))
    first = each.groupBy("key").agg(F.max(F.struct("score", "sk")).alias("first")).select("key", F.col("first.sk").alias("a"))
    return each.join(first, "key").where("a <> sk").select("a", F.col("sk").alias("b")).distinct()


def _indexed_pairs(classes: DataFrame, label: DataFrame, least: float) -> DataFrame:
    """Pairs of classes of different components that share an indexed shingle and may be similar."""
    spark = classes.sparkSession
    named = classes.join(label, classes.node == label.label_of, "left").select("sk", "n", "keys", "places", F.coalesce("label", "node").alias("label"))
    each = named.select("sk", "n", "label", F.explode(F.arrays_zip("keys", "places")).alias("e")).select("sk", "n", "label", F.col("e.keys").alias("key"), F.col("e.places").alias("place"))
    several = each.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("key", F.ceil(F.col("m") / KEY_BLOCK).cast("int").alias("blocks"))
    met = each.join(several, "key").withColumn("own", F.pmod(F.xxhash64("sk"), F.col("blocks")).cast("int"))
    # pairs of blocks (smaller, larger); a block meets itself too, and side tells the two apart where they differ
    whole = met.where("blocks = 1").select(F.xxhash64("key").alias("g"), "n", "place", "label", "sk", F.monotonically_increasing_id().alias("side"))
    split = met.where("blocks > 1").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    side = F.when(F.col("own") == F.col("with"), F.monotonically_increasing_id()).otherwise(-1 - F.col("own").cast("long"))
    split = split.select(F.xxhash64("key", F.least("own", "with"), F.greatest("own", "with")).alias("g"), "n", "place", "label", "sk", side.alias("side"))
    dealt = whole.unionByName(split).repartition("g").sortWithinPartitions("g")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")
    try:
        return stash(dealt.mapInArrow(_pairer(least), "a binary, b binary").distinct(), "met")
    finally:
        prepare(spark)


def near_copy_groups(docs: DataFrame, words: int = 5, least: float = LEAST) -> DataFrame:
    """``doc_id, fp, component_id, label`` for every row: the smallest ``doc_id`` that links
    lead to (null if none has one), and a number for the component."""
    prepare(docs.sparkSession)
    rows = stash(with_names(docs, words), "names")
    own = rows.groupBy("fp").agg(F.min("doc_id").alias("own"))
    # a class stands for its smallest fingerprint, and equal sets of other fingerprints link to it
    sets = rows.where("n > 0")
    ends = stash(sets.groupBy("sk").agg(F.min("fp").alias("node"), F.max("fp").alias("last")), "nodes")
    node = ends.select("sk", "node")
    same = sets.join(ends.where("node <> last"), "sk").where("fp <> node").select(F.col("fp").alias("a"), F.col("node").alias("b"))
    found = stash(candidates(docs, words, least), "candidates")
    classes = stash(found.join(node, "sk"), "classes")
    unstash(found)
    near = simhash.links(own.select("fp"))
    label = components(near.unionByName(same).unionByName(_alike(_leader_pairs(classes), classes, least)))
    unstash(near)
    of = label.withColumnRenamed("node", "label_of")
    met = _indexed_pairs(classes, of, least)
    if not met.isEmpty():
        more = stash(_alike(met, classes, least), "alike")
        if not more.isEmpty():
            name = lambda c: F.coalesce(F.col("label"), F.col(c))
            lifted = more.join(of, more.a == of.label_of, "left").select(name("a").alias("a"), "b").join(of, F.col("b") == of.label_of, "left").select("a", name("b").alias("b"))
            higher = components(lifted)
            every = label.unionByName(higher.select("node", F.col("node").alias("label"))).distinct()  # a single node is its own label
            moved = higher.select(F.col("node").alias("label"), F.col("label").alias("top"))
            label = every.join(moved, "label", "left").groupBy("node").agg(F.min(F.coalesce("top", "label")).alias("label"))
    named = own.join(label, own.fp == label.node, "left").select("fp", "own", F.coalesce("label", "fp").alias("label"))
    smallest = named.groupBy("label").agg(F.min("own").alias("component_id"))
    out = stash(rows.join(named.select("fp", "label").join(smallest, "label"), "fp").select("doc_id", "fp", "component_id", "label"), "groups")
    for x in (rows, ends, classes, met):
        unstash(x)
    return out
