"""SpotSigs fingerprints: chains of content words that follow common-word anchors.

Words are cut at ASCII characters that are neither letters nor digits, lower-cased. Every
anchor (a common function word) spots the next ``CHAIN`` content words after it; anchor
and chain, hashed together, are one signature, and a text's signatures are a set. Likeness
is the Jaccard similarity of two sets, computed on whole sets. The fingerprint string is
the size of the set and its 32 smallest mixed hashes (32 bits each, hexadecimal): equal
texts, and texts with equal sets, have equal fingerprints.

A text with words but no signature has one for its whole word sequence; a text with other
characters alone has one for its characters; an empty or null text has none. Two empty
sets have likeness 1, an empty and a non-empty one 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textkern as K
from tessera.llm.common import pick, prepare, slices, stash

CHAIN = 2
SKETCH = 32
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an the of and in on to is it that for was as with by be at this are or not "
    "der die das und in zu den von mit ist des im nicht ein eine als auch es an für "
    "le la les de des et en un une du que est pour dans il elle au sur ne se "
    "el los las y que un una por con su para es lo como del al no"
).split()


def _anchor_hashes() -> np.ndarray:
    w = K.alnum_words(K.encode(sorted(set(ANCHORS))))
    return np.sort(K.word_hashes(w, 7))


def signatures(texts: list[str | None], chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted set of 64-bit signatures of every text."""
    anchors = _anchor_hashes()
    raw = K.encode([None if t is None else t.lower() for t in texts])
    w = K.alnum_words(raw)
    out: list[np.ndarray] = []
    h = K.word_hashes(w, 7) if len(w.start) else np.empty(0, np.uint64)
    is_anchor = anchors[np.minimum(np.searchsorted(anchors, h), len(anchors) - 1)] == h
    doc = w.text_of()
    content = np.flatnonzero(~is_anchor)
    spots = np.flatnonzero(is_anchor)
    follow = np.searchsorted(content, spots)
    whole = follow + chain - 1 < len(content)
    spots, follow = spots[whole], follow[whole]
    whole = doc[content[follow + chain - 1]] == doc[spots]
    spots, follow = spots[whole], follow[whole]
    value = h[spots]
    for k in range(chain):
        value = K.mix(value * np.uint64(0x9E3779B97F4A7C15) + h[content[follow + k]])
    cut = np.searchsorted(doc[spots], np.arange(len(texts) + 1))
    for d, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if b > a:
            out.append(np.unique(value[a:b]))
        elif raw[d]:
            words = b" ".join(bytes(w.buf[w.start[i] : w.end[i]]) for i in range(w.first[d], w.first[d + 1]))
            digest = hashlib.blake2b(words or raw[d], digest_size=8).digest()
            out.append(np.frombuffer(digest, np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def fingerprint(sigs: np.ndarray, size: int = SKETCH) -> str:
    low = np.sort(K.mix(sigs) >> np.uint64(32))[:size].astype(">u4")
    return f"{len(sigs):x}:{low.tobytes().hex()}"


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of sorted sets; 0.0 without a look at them if their sizes alone
    keep it under ``least``."""
    if not len(a) and not len(b):
        return 1.0
    small, large = sorted((len(a), len(b)))
    if not small or small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edit(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many that follow."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint against that of its edited text and of the next row's text.

    Rows are ordered by ``doc_id`` (null last), then text; the first follows the last.
    They are dealt by range of ``doc_id``; a task answers for all its rows but the last and
    hands on its first and last row, which meet those of the next task by an equi-join."""
    prepare(docs.sparkSession)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, role int, part int, text string"
    names = [f.split()[0] for f in schema.split(", ")]

    def rows_of(ids: list, texts: list[str], following: list[str], next_sigs: list | None = None) -> list[tuple]:
        sigs = signatures([*texts, following[-1]])
        new = [edit(t, f) for t, f in zip(texts, following, strict=True)]
        edited = signatures(new)
        out = []
        for i, doc_id in enumerate(ids):
            near_next = jaccard(sigs[i], sigs[i + 1] if next_sigs is None else next_sigs[i])
            sha = hashlib.sha256(new[i].encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, len(texts[i]), sha, fingerprint(sigs[i]), fingerprint(edited[i]), jaccard(sigs[i], edited[i]), near_next, 0, None, None))
        return out

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def inside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[list, list[str]] = ([], [])
        edge = lambda role, doc_id, text: (doc_id, *[None] * 6, role, part, text)
        first = True
        for b in slices(batches):
            ids = held[0] + b.column(0).to_pylist()
            texts = held[1] + [t or "" for t in b.column(1).to_pylist()]
            if first:
                yield batch([edge(1, ids[0], texts[0])])
                first = False
            if len(ids) > 1:
                yield batch(rows_of(ids[:-1], texts[:-1], texts[1:]))
            held = ids[-1:], texts[-1:]
        if held[0]:
            yield batch([edge(2, held[0][0], held[1][0])])

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, texts, following = (c.to_pylist() for c in b.columns)
            yield batch(rows_of(ids, texts, following, signatures(following)))

    key = F.col("doc_id").asc_nulls_last()
    ordered = pick(docs, "doc_id", "text").repartitionByRange(key).sortWithinPartitions(key, F.col("text").asc_nulls_first())
    out = stash(ordered.mapInArrow(inside, schema), "spots")
    heads = out.where("role = 1").select("part", F.col("text").alias("following"))
    tails = out.where("role = 2").select("part", "doc_id", "text")
    # the next task that has rows; the window holds one number for each task
    tasks = Window.orderBy("part")
    order = heads.select("part", F.coalesce(F.lead("part").over(tasks), F.first("part").over(tasks)).alias("next"))
    met = tails.join(order, "part").join(heads.withColumnRenamed("part", "next"), "next").select("doc_id", "text", "following")
    return out.where("role = 0").unionByName(met.mapInArrow(across, schema)).drop("role", "part", "text")


def near_sets(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """``a, b, likeness``: classes of equal signature sets (named by their smallest
    ``doc_id``) whose likeness is at least ``least``, each pair once, a < b.

    Sets are partitioned by length: similar ones differ in length by the factor ``least``
    at most, so a set is indexed under its length's partition and probes that and the next.
    Only a prefix is indexed, the rarest (1 - least) * n + 1 signatures: similar sets share
    one of them. Candidates are pruned by length again and verified on whole sets. Texts
    without signatures form a class that links to none."""
    prepare(docs.sparkSession)

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = [x.view(np.int64).tolist() for x in signatures(b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.list_(pa.int64()))], ["doc_id", "sigs"])

    every = pick(docs, "doc_id", "text").mapInArrow(sets, "doc_id long, sigs array<long>")
    classes = stash(every.where("size(sigs) > 0 and doc_id is not null").groupBy("sigs").agg(F.min("doc_id").alias("a")), "classes")
    each = classes.select("a", F.explode("sigs").alias("s"))
    rarity = each.groupBy("s").agg(F.count("*").alias("df"))
    keep = F.floor((1 - least) * F.size("own") + 1e-9).cast("int") + 1
    ranked = each.join(rarity, "s").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("own"))
    step = float(np.log(1 / least))
    prefix = ranked.select("a", F.size("own").alias("n"), F.floor(F.log(F.size("own").cast("double")) / step).alias("band"), F.explode(F.slice("own", 1, keep)).alias("x")).select("a", "n", "band", F.col("x.s").alias("s"))
    left = prefix.select("a", "n", "s", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    right = prefix.select(F.col("a").alias("b"), F.col("n").alias("m"), "s", "band")
    pairs = left.join(right, ["s", "band"]).where((F.col("a") < F.col("b")) & (F.least("n", "m") >= least * F.greatest("n", "m"))).select("a", "b").distinct()
    other = classes.select(F.col("a").alias("b"), F.col("sigs").alias("more"))
    both = pairs.join(classes, "a").join(other, "b").withColumn("k", F.size(F.array_intersect("sigs", "more")))
    return both.select("a", "b", (F.col("k") / (F.size("sigs") + F.size("more") - F.col("k"))).alias("likeness")).where(F.col("likeness") >= least)
