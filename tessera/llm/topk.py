"""Exact top-k by integer inner product, with no random access to the lists (NRA).

Components become floor(scale * x). The candidates are dealt into blocks; a block is kept
as its sorted lists alone, one for each dimension, of (component, candidate). A query reads
these lists in turn, from the end that its own component favours, a step at a time, and
keeps for each candidate a lower and an upper bound: the sum of what has been read, plus
the least or the most that unread entries can add. A candidate whose upper bound is under
the k-th lower bound is out for good; reading stops when nobody else can qualify and the
bounds of all who do have met, which are then their scores. Nothing is ever looked up by
candidate: at full depth the sum of what has been read is the score.

All queries of a group read one step of a list together, so a step is a few matrix products
over the entries just read. How early reading stops depends on the data: sparse or skewed
vectors end after a small part of the lists, dense ones of many even components are read
whole (see the README).

The stated queries meet all blocks of candidates: a block meets ``query_group`` queries in
one task, and only k rows for each query and block come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import arrow_rows, prepare, stash, unstash

BLOCK = 8192
QUERIES = 512
#: Queries that a block of candidates meets in one task.
QUERY_GROUP = 1 << 14
SCALE = 256
#: Parts of the lists after which bounds are compared.
STEPS = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 3 / 4)


def _exact(x: np.ndarray, q: np.ndarray) -> type:
    """Doubles hold every sum of products exactly, or else Python's integers do."""
    most = [max(abs(int(v.max())), abs(int(v.min()))) if v.size else 0 for v in (x, q)]
    return np.float64 if most[0] * most[1] * max(1, x.shape[1]) < 1 << 52 else object


class SortedLists:
    """The candidates of a block as one ascending list for each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.n = ids, len(x)
        self.who = np.argsort(x, axis=0, kind="stable")
        self.value = np.take_along_axis(x, self.who, axis=0)
        #: Entries that the last call of :meth:`top` read.
        self.reads = 0

    def _read(self, begin: int, end: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """The entries ``begin:end`` of every list, by candidate, and which these are."""
        value, seen = np.zeros(self.value.shape, kind), np.zeros(self.value.shape, bool)
        dim = np.arange(self.value.shape[1])
        value[self.who[begin:end], dim] = self.value[begin:end]
        seen[self.who[begin:end], dim] = True
        return value, seen

    def top(self, qids: np.ndarray, q: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the numbers and scores of its k best in this block, other than rows of its own id."""
        n, kind = self.n, _exact(self.value, q)
        q = q.astype(kind)
        # positive components read lists from the top, negative ones from the bottom
        high, low = np.where(q > 0, q, 0).astype(kind), np.where(q < 0, q, 0).astype(kind)
        unseen = [np.ones(self.value.shape, bool), np.ones(self.value.shape, bool)]
        alive = self.ids[None, :] != qids[:, None]
        cols, total = np.arange(n), np.zeros((len(q), n), kind)
        lower = upper = total
        self.reads = depth = 0
        for to in sorted({*(max(1, int(s * n)) for s in STEPS), n} if n else ()):
            for part, side, (begin, end) in ((high, 0, (n - to, n - depth)), (low, 1, (depth, to))):
                if part.any():
                    value, seen = self._read(begin, end, kind)
                    unseen[side] &= ~seen
                    total += part @ value[cols].T
                    self.reads += (end - begin) * int(part.any(axis=0).sum())
            lower, upper = total.copy(), total.copy()
            if to < n:
                for part, side, worst, edge in ((high, 0, self.value[0], self.value[n - to - 1]), (low, 1, self.value[-1], self.value[to])):
                    if part.any():
                        rest = unseen[side][cols].T.astype(kind)
                        lower += (part * worst.astype(kind)) @ rest
                        upper += (part * edge.astype(kind)) @ rest
                if k < len(cols):
                    known = np.where(alive, lower, -np.inf if kind is np.float64 else -(1 << 200))
                    alive &= upper >= np.partition(known, len(cols) - k, axis=1)[:, len(cols) - k, None]
            depth = to
            if (lower == upper)[alive].all():
                break
            keep = np.flatnonzero(alive.any(axis=0))  # nobody reads the entries of the others any more
            if len(keep) < len(cols):
                cols, total, alive = cols[keep], total[:, keep], alive[:, keep]
                lower, upper = lower[:, keep], upper[:, keep]
        for i in range(len(q)):
            own = np.flatnonzero(alive[i])
            best = np.lexsort((self.ids[cols[own]], -lower[i, own]))[:k]
            yield cols[own[best]], lower[i, own[best]].astype(np.int64)


def _pack(df: DataFrame, block: str, scale: int, *more: str) -> DataFrame:
    """A row for each block: ids and integer components."""
    rows = df.select("vec_id", block, *more, F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"))
    return rows.groupBy(block).agg(F.collect_list(F.struct("vec_id", "x", *more)).alias("rows"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERIES, query_group: int = QUERY_GROUP) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest scores among the rows of
    ``vectors`` other than its own; ties go to the smaller ``vec_id``.

    Both tables have ``vec_id`` and ``embedding``. Vectors that are null or hold null or
    non-finite components take no part; shorter ones count as padded with zeros. Every other
    row is a candidate, those that repeat a ``vec_id`` each by itself, those without one too
    (null in the result, last among ties). Rows that share a query's id count as its own. A
    query without an id is none; rows that repeat a query's id are each a query with ranks of
    its own, where their vectors differ. Sums are exact; a score beyond a long is an error.
    Blocks hold about ``block`` rows: their number follows the count."""
    spark = vectors.sparkSession
    prepare(spark)
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    clean = lambda df: df.select(df["vec_id"].cast("long").alias("vec_id"), df["embedding"].alias("embedding")).where(F.col("embedding").isNotNull() & finite)
    asked = ask = stash(clean(queries).where("vec_id is not null").distinct().withColumn("number", F.monotonically_increasing_id()), "queries")
    have = clean(vectors)
    n_have, n_ask = have.count(), ask.count()
    blocks, query_blocks = max(1, -(-n_have // block)), max(1, -(-n_ask // query_block))
    groups = max(1, -(-n_ask // query_group))
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    have = _pack(have.withColumn("block", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks))), "block", scale).withColumn("group", numbers(groups))
    ask = _pack(ask.withColumn("asked", F.pmod(F.xxhash64("number"), F.lit(query_blocks))), "asked", scale, "number")
    ask = ask.withColumn("group", F.pmod("asked", F.lit(groups))).withColumn("block", numbers(blocks))

    def matrix(part: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        ids, x = part.field("vec_id"), part.field("x")
        sizes = pc.list_value_length(x).to_numpy(zero_copy_only=False)
        out = np.zeros((len(ids), int(sizes.max(initial=0))), np.int64)
        out[np.repeat(np.arange(len(ids)), sizes), np.concatenate([np.arange(s) for s in sizes])] = x.flatten().to_numpy(zero_copy_only=False)
        return pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), out

    schema = "query_id long, number long, vec_id long, score long"

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            rows = left["rows"].combine_chunks().flatten()
            ids, x = matrix(rows)
            named, lists = rows.field("vec_id"), None
            for chunk in right["rows"]:
                part = chunk.values
                qids, q = matrix(part)
                number = part.field("number").to_numpy(zero_copy_only=False)
                width = max(x.shape[1], q.shape[1])
                if lists is None or width > x.shape[1]:
                    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
                    lists = SortedLists(ids, x)
                q = np.pad(q, ((0, 0), (0, width - q.shape[1])))
                for lo in range(0, len(q), 128):
                    for i, (at, score) in enumerate(lists.top(qids[lo : lo + 128], q[lo : lo + 128], k), lo):
                        for column, values in zip(found, ([qids[i]] * len(at), [number[i]] * len(at), named.take(pa.array(at)).to_pylist(), score.tolist()), strict=True):
                            column.extend(values)
        return arrow_rows(schema, *found)

    near = stash(have.groupBy("block", "group").cogroup(ask.groupBy("block", "group")).applyInArrow(best, schema), "near")
    unstash(asked)
    order = Window.partitionBy("query_id", "number").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
