"""Connected components of a link table.

Up to ``AT_ONCE`` links, a fixed amount that one task holds easily, are joined in one task: a
single plan instead of some rounds of them, each of which costs the driver threads, plans and
task records however few its rows. More links go through alternating large-star and small-star
steps until these end or leave few enough: a round is a few equi-joins and partially aggregated
minima, and the number of rounds grows with the logarithm of a component's diameter. Both ways
are exact, and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.llm.common import stash, unstash

#: Links that one task joins.
AT_ONCE = 1 << 21
_OUT_ROWS = 1 << 16


def _written(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The links as a table, and their number and sum of hashes, taken while they are written."""
    seen = Observation()
    table = stash(links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
    return table, (seen.get["n"], seen.get["h"])


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the links ``a, b`` in order, and the smallest of each one's component."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while len(x):
        # the root of each link's larger end goes below the smallest root it is linked to
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (higher := up[up] != up).any():
            up[higher] = up[up[higher]]
        x, y = up[x], up[y]
        apart = x != y
        x, y = x[apart], y[apart]
    return nodes, nodes[up]


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ends = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if ends:
        node, label = smallest(*map(np.concatenate, zip(*ends, strict=True)))
        for i in range(0, len(node), _OUT_ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(c[i : i + _OUT_ROWS]) for c in (node, label)], ["node", "label"])


def components(links: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """``links`` has two long columns ``a`` and ``b``; returns ``node, label``: every
    node that has a link, and the smallest node of its component. Self-links and
    repeated links are harmless; an empty table gives an empty result."""
    e, seen = _written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while seen[0] > at_once and seen != before:
        # large star: every larger neighbour of u is linked to u's smallest neighbour (or u)
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: u and its smaller neighbours are linked to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new, after = _written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        unstash(e)
        e, before, seen = new, seen, after
    if seen[0] > at_once:
        found = e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    else:
        found = e.coalesce(1).mapInArrow(_joined, "node long, label long")
    label = stash(found, "labels")
    unstash(e)
    return label
