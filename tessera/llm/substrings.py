"""Exact removal of repeated word windows across documents, by fixed-block anchors.

A window of ``window`` words (20) holds at least one whole block of every grid of blocks
of half that length (10). So:

1. *Index and probe.* Every document is cut into non-overlapping blocks of 10 words (the
   index) and every rolling window of 10 words probes it, by 64-bit hash. A probe that
   meets a block at another place is a hit. Both sides of a repeat get hits.
2. *Extend.* Hits are extended to the 20-word windows that hold them; equal windows, by
   a 128-bit digest, form one group whose earliest place (smaller ``doc_id``, then
   earlier start) is found. All its later places are repeats, and runs of consecutive
   repeated windows are the maximal exact repeats.
3. Words covered by a repeated window are removed.

*Data flow.* Documents are dealt once into groups of about 1.5 MB of text by a hash of
the row, and that exchange is reused by all three passes. A group pre-aggregates: it sends
each different hash once, 4 bytes each, packed by shard, whatever the number of its
copies; so a passage that a third of all documents share costs a shard one entry for each
group. Answers come back as packed bits in the order sent, which a group can make again
from its own rows. Nothing is collected, broadcast or capped, and no pairs are made.

Null texts have no words. Rows that repeat a ``doc_id`` tie: of equal windows at equal
places in them neither is earlier. A null ``doc_id`` counts as larger than all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkern as K
from tessera.llm.common import prepare

WINDOW = 20
GROUP_BYTES = 3 << 19
#: Text beyond which groups grow with the square root of it, up to ``MOST_GROUP_BYTES``: so
#: messages between groups and shards are more in proportion to the text.
GROWTH_BYTES = 1 << 30
MOST_GROUP_BYTES = 6 << 20
_LAST = np.iinfo(np.int64).max


class _Group:
    """The rows of a group in their order, and the hashes of their windows."""

    def __init__(self, table: pa.Table, window: int):
        ids = table.column("id").to_pylist()
        texts = table.column("text").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
        self.ids = np.array([_LAST if ids[i] is None else ids[i] for i in self.order], np.int64)
        self.words = w = K.Words(K.encode([texts[i] for i in self.order]))
        self.window, self.block = window, window // 2
        self.hash1 = K.word_hashes(w, 1)
        self.doc = w.text_of()
        s = K.window_starts(w, self.block)
        self.probe = s = s[w.counts()[self.doc[s]] >= window]
        self.aligned = (s - w.first[self.doc[s]]) % self.block == 0
        self.keys, self.back = np.unique(K.window_hashes(self.hash1, s, self.block), return_inverse=True)

    def dealt(self, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which keys are sent, and where each shard's part begins and ends."""
        shard = (keys % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        n = np.bincount(shard, minlength=shards)
        return order, np.cumsum(n) - n, np.cumsum(n)

    def answers(self, table: pa.Table, kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
        """What the shards said of each key."""
        order, lo, hi = self.dealt(keys, shards)
        out = np.zeros(len(keys), np.uint8)
        part = table.filter(pc.equal(table.column("kind"), kind))
        for s, bits in zip(part.column("shard").to_pylist(), part.column("bits").to_pylist(), strict=True):
            n = hi[s] - lo[s]
            got = np.unpackbits(np.frombuffer(bits, np.uint8))
            out[order[lo[s] : hi[s]]] = got[:n] if kind == 2 else got[: 2 * n].reshape(n, 2) @ np.array([2, 1], np.uint8)
        return out

    def blocks(self) -> np.ndarray:
        """For each key the index blocks of this group that have it, 0, 1 or 2 for more."""
        return np.minimum(np.bincount(self.back, self.aligned, len(self.keys)), 2).astype(np.uint32)

    def candidates(self, found: np.ndarray) -> np.ndarray:
        """The starts of windows that hold a hit; ``found``: each key's index blocks anywhere."""
        w = self.words
        hit = np.zeros(len(w.start) + 1, np.int64)
        hit[self.probe[found[self.back] > self.aligned]] = 1
        hit = np.concatenate(([0], np.cumsum(hit)))
        s = K.window_starts(w, self.window)
        return s[hit[s + self.window - self.block + 1] > hit[s]]

    def digests(self, s: np.ndarray):
        """Windows in the order of (digest, doc_id, place) and the first of each digest."""
        h1 = K.window_hashes(self.hash1, s, self.window)
        h2 = K.window_hashes(K.word_hashes(self.words, 2), s, self.window)
        ids, place = self.ids[self.doc[s]], s - self.words.first[self.doc[s]]
        order = np.lexsort((place, ids, h2, h1))
        h1, h2, ids, place = h1[order], h2[order], ids[order], place[order]
        new = np.ones(len(s), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        return order, new, h1, h2, ids, place


def _table(schema: T.StructType, columns: list) -> pa.Table:
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.Table.from_arrays(columns, schema=to_arrow_schema(schema))


_SENT = T.StructType().add("shard", "integer").add("pid", "integer").add("keys", "binary")
_SENT2 = T.StructType().add("shard", "integer").add("pid", "integer").add("h1", "binary").add("h2", "binary").add("ids", "binary").add("place", "binary")
_SAID = T.StructType().add("pid", "integer").add("kind", "integer").add("shard", "integer").add("bits", "binary")


def repeated_words(docs: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, ``rest`` (a struct of its columns
    other than the text), ``n_words``, ``n_removed``, ``spans`` (the removed runs of
    words, first and past the last) and ``kept_text`` (kept words joined by one space)."""
    prepare(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    group_bytes = max(group_bytes, min(MOST_GROUP_BYTES, int(group_bytes * (total / GROWTH_BYTES) ** 0.5)))
    groups = max(1, -(-total // group_bytes))
    shards = max(1, groups // 4)
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"])
    base = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text"), rest.alias("rest"))
    base = base.withColumn("pid", F.pmod(F.xxhash64("id", "text"), F.lit(groups)).cast("integer"))
    out = T.StructType([T.StructField("doc_id", T.LongType()), base.schema["rest"]]).add("n_words", "long").add("n_removed", "long").add("spans", T.ArrayType(T.StructType().add("first", "integer").add("last", "integer"))).add("kept_text", "string")

    def send_blocks(table: pa.Table) -> pa.Table:
        g = _Group(table, window)
        order, lo, hi = g.dealt(g.keys, shards)
        sent = (((g.keys >> np.uint64(34)) << np.uint64(2)).astype(np.uint32) | g.blocks())[order]
        some = np.flatnonzero(hi > lo)
        pid = table.column("pid")[0].as_py()
        return _table(_SENT, [pa.array(some, pa.int32()), pa.array([pid] * len(some), pa.int32()), pa.array([sent[lo[s] : hi[s]].tobytes() for s in some], pa.binary())])

    def count_blocks(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()]
        every = np.concatenate(parts)
        key, inv = np.unique(every >> 2, return_inverse=True)
        n = np.minimum(np.bincount(inv, every & 3, len(key)), 2).astype(np.uint8)[inv]
        bits = np.unpackbits(n[:, None], axis=1)[:, 6:]
        stops = np.cumsum([0, *map(len, parts)])
        said = [np.packbits(bits[a:b].reshape(-1)).tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)]
        return _table(_SAID, [table.column("pid").combine_chunks(), pa.array([1] * len(parts), pa.int32()), table.column("shard").combine_chunks(), pa.array(said, pa.binary())])

    def send_windows(table: pa.Table, said: pa.Table) -> pa.Table:
        g = _Group(table, window)
        s = g.candidates(g.answers(said, 1, g.keys, shards))
        _, new, h1, h2, ids, place = g.digests(s)
        h1, h2, ids, place = h1[new], h2[new], ids[new], place[new].astype(np.int32)
        order, lo, hi = g.dealt(h1, shards)
        some = np.flatnonzero(hi > lo)
        pid = table.column("pid")[0].as_py()
        cut = lambda x: pa.array([x[order[lo[k] : hi[k]]].tobytes() for k in some], pa.binary())
        return _table(_SENT2, [pa.array(some, pa.int32()), pa.array([pid] * len(some), pa.int32()), cut(h1), cut(h2), cut(ids), cut(place)])

    def first_windows(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        h1, h2, ids, place = join("h1", np.uint64), join("h2", np.uint64), join("ids", np.int64), join("place", np.int32)
        order = np.lexsort((place, ids, h2, h1))
        new = np.ones(len(order), bool)
        a, b = order[1:], order[:-1]
        new[1:] = (h1[a] != h1[b]) | (h2[a] != h2[b])
        lead = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        first = np.empty(len(order), np.uint8)
        first[order] = (ids[order] == ids[lead]) & (place[order] == place[lead])
        stops = np.cumsum([0, *(len(x) // 4 for x in table.column("place").to_pylist())])
        said = [np.packbits(first[a:b]).tobytes() for a, b in zip(stops[:-1], stops[1:], strict=True)]
        return _table(_SAID, [table.column("pid").combine_chunks(), pa.array([2] * len(said), pa.int32()), table.column("shard").combine_chunks(), pa.array(said, pa.binary())])

    def remove(table: pa.Table, said: pa.Table) -> pa.Table:
        g = _Group(table, window)
        w = g.words
        s = g.candidates(g.answers(said, 1, g.keys, shards))
        order, new, h1, _, ids, place = g.digests(s)
        first = g.answers(said, 2, h1[new], shards)
        lead = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        early = (first[of] == 1) & (ids == ids[lead][of]) & (place == place[lead][of]) if len(s) else np.zeros(0, bool)
        gone = np.zeros(len(w.start) + 1, np.int64)
        repeats = s[order[~early]]
        np.add.at(gone, repeats, 1)
        np.add.at(gone, repeats + window, -1)
        gone = np.cumsum(gone[:-1]) > 0
        kept = w.buf[np.repeat(~gone, w.end - w.start + 1)].tobytes()
        size = np.concatenate(([0], np.cumsum(np.where(gone, 0, w.end - w.start + 1))))
        n_gone = np.concatenate(([0], np.cumsum(gone)))
        texts, spans = [], []
        for d in range(len(g.ids)):
            a, b = w.first[d], w.first[d + 1]
            texts.append(kept[size[a] : max(size[a], size[b] - 1)].decode("utf-8", "surrogatepass"))
            if n_gone[b] > n_gone[a]:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone[a:b].astype(np.int8), [0])))).reshape(-1, 2)
                spans.append([{"first": int(x), "last": int(y)} for x, y in edge])
            else:
                spans.append([])
        taken = table.take(pa.array(g.order))
        counts = pa.array(w.counts()), pa.array(n_gone[w.first[1:]] - n_gone[w.first[:-1]])
        return _table(out, [taken.column("id").combine_chunks(), taken.column("rest").combine_chunks(), *counts, pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), pa.array(texts)])

    said1 = base.groupBy("pid").applyInArrow(send_blocks, _SENT).groupBy("shard").applyInArrow(count_blocks, _SAID)
    sent2 = base.groupBy("pid").cogroup(said1.groupBy("pid")).applyInArrow(send_windows, _SENT2)
    said2 = sent2.groupBy("shard").applyInArrow(first_windows, _SAID)
    said = said1.unionByName(said2)
    return base.groupBy("pid").cogroup(said.groupBy("pid")).applyInArrow(remove, out)


#: DuckDB SQL of the same rows, written from the definition alone.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, hash(array_to_string(w[p:p + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS p FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, first_value(doc_id) OVER o AS d0, first_value(p) OVER o AS p0 FROM g WINDOW o AS (PARTITION BY h ORDER BY doc_id, p)) WHERE doc_id <> d0 OR p <> p0),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS i FROM r),
x AS (SELECT d.doc_id, len(w) AS n_words, coalesce(k.n, 0) AS n_removed, w, coalesce(k.gone, []) AS gone FROM d LEFT JOIN (SELECT doc_id, count(*) AS n, list(i) AS gone FROM c GROUP BY doc_id) k USING (doc_id)),
t AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
s AS (SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.i) AS kept FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.i = c.i GROUP BY t.doc_id)
SELECT x.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM x LEFT JOIN s USING (doc_id)
"""
