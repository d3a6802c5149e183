"""Cross-entropy difference of documents under two matched bigram models.

The *target* model is counted on the documents labelled of good quality, the *background*
model on all documents. Both share one vocabulary (all words of all documents), one order
and one smoothing, so their losses are comparable token by token: a document's score is the
mean over its tokens of background loss minus target loss, in bits; higher is more like the
target.

Every document is counted and every document is scored, whole; every word and every pair of
words has its own count, however many there are. Words and pairs are named by hashes (the
lowest bit tells one from the other) of so many bits that of all keys a share of about
2**-20 meets another, whatever the size of the corpus (63 bits at most). Counts are a table over the range of the hashes,
cut into as many parts as the text has groups of ``GROUP_BYTES``: nothing of it is gathered.
A group of documents adds up its own keys before it sends them, asks each part once for the
keys it has, and gets back counts in the order of its sorted keys; so a frequent pair is one
entry of a group, not one of each place where it stands. Null and empty texts have no tokens
and score 0; repeated rows count each time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textkern as K
from tessera.llm.common import arrow_rows, pack, pack_sorted, pick, prepare, slices, stash, unpack, unpack_sorted, unstash

#: Bytes of text of a group of documents, about; the counts have as many parts as there are groups.
GROUP_BYTES = 6 << 20
#: What stands before the first word of a text.
START = np.uint64(0x5851F42D4C957F2D)


def _read(texts: list[str | None]) -> tuple[K.Words, np.ndarray]:
    w = K.Words(K.encode([None if t is None else t.lower() for t in texts]))
    return w, K.word_hashes(w, 5) if len(w.start) else np.empty(0, np.uint64)


def _text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length(docs["text"]).cast("long"))).first()[0] or 0


def _group_count(size: int) -> int:
    return max(1, -(-size // GROUP_BYTES))


def _key_bits(size: int) -> int:
    """For about ``size / 6`` words, and pairs of them, and the lowest bit."""
    return min(64, max(32, (size // 6 + 1).bit_length() + 22))


def _grouped(docs: DataFrame, groups: int) -> DataFrame:
    """``g, doc_id, text``: rows by a hash of their id, so that labels find them; those without one by their text."""
    g = F.when(docs["doc_id"].isNotNull(), F.xxhash64(docs["doc_id"].cast("long"))).otherwise(F.xxhash64(docs["text"]))
    return docs.select(F.pmod(g, F.lit(groups)).alias("g"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))


@dataclass
class _Keys:
    """The sorted different keys of a group's texts, and where each token's are among them."""

    keys: np.ndarray
    word: np.ndarray
    pair: np.ndarray
    before: np.ndarray
    first: np.ndarray
    text_of: np.ndarray
    n: np.ndarray


def _keys(rows: pa.Table, bits: int) -> _Keys:
    short, one = np.uint64(64 - bits), np.uint64(1)
    words, pairs, counts = [], [], []
    for b in slices(rows.select(["text"]).to_batches()):
        w, h = _read(b.column(0).to_pylist())
        n = w.counts()
        before = np.concatenate(([START], h[:-1])) if len(h) else h
        before[w.first[:-1][n > 0]] = START
        words.append((h >> short) | one)
        pairs.append((K.mix(before * np.uint64(0x9E3779B185EBCA87) + h) >> short) & ~one)
        counts.append(n)
    word, pair, n = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((words, np.uint64), (pairs, np.uint64), (counts, np.int64)))
    start = np.array([START >> short | one][: len(word)], np.uint64)
    keys, at = np.unique(np.concatenate((word, pair, start)), return_inverse=True)
    first = (np.cumsum(n) - n)[n > 0]
    word, pair, start = at[: len(word)], at[len(word) : 2 * len(word)], at[2 * len(word) :]
    before = np.empty(len(word), np.int64)
    before[1:] = word[:-1]
    before[first] = start[0] if len(start) else 0
    return _Keys(keys, word, pair, before, first, np.repeat(np.arange(len(n)), n), n)


def _cuts(keys: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """Where each of the parts begins among sorted keys; a part is a range of keys."""
    part = ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(parts + 1).astype(np.uint64))


def _all_keys(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [unpack_sorted(x) for x in column.to_pylist()]


def _all_counts(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [unpack(x).astype(np.int64) for x in column.to_pylist()]


@dataclass
class Models:
    """Both models' counts by part of the keys (``b, keys, good, every``), how many keys are
    words (the start of a text is one), and the sums of their counts: target, background."""

    counts: DataFrame
    parts: int
    bits: int
    words: int
    total: tuple[int, int]


def fit(docs: DataFrame, labels: DataFrame) -> Models:
    """Count both models over all documents."""
    prepare(docs.sparkSession)
    size = _text_bytes(docs)
    parts, bits = _group_count(size), _key_bits(size)
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    good = good.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("g"), "id")
    sent, summed = "b long, keys binary, good binary, every binary", "b long, keys binary, good binary, every binary, words long, n_good long, n_every long"

    def count(rows: pa.Table, own: pa.Table) -> pa.Table:
        k = _keys(rows, bits)
        ids = set(own["id"].to_pylist())
        target = np.array([d in ids for d in rows["doc_id"].to_pylist()], bool)[k.text_of]
        both = []
        for chosen in (target, np.ones(len(target), bool)):
            n = np.bincount(k.word[chosen], minlength=len(k.keys)) + np.bincount(k.pair[chosen], minlength=len(k.keys))
            both.append(n + np.bincount(k.before[k.first[chosen[k.first]]], minlength=len(k.keys)))
        cut = _cuts(k.keys, parts, bits)
        b = np.flatnonzero(np.diff(cut)).tolist()
        return arrow_rows(sent, b, *[[f(x[cut[i] : cut[i + 1]]) for i in b] for f, x in ((pack_sorted, k.keys), *((pack, n) for n in both))])

    def add(blocks: pa.Table) -> pa.Table:
        keys = np.concatenate(_all_keys(blocks["keys"]))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        keys = keys[first]
        both = [np.add.reduceat(np.concatenate(_all_counts(blocks[name]))[order], first) for name in ("good", "every")]
        word = (keys & np.uint64(1)) == 1
        return arrow_rows(summed, [blocks["b"][0].as_py()], [pack_sorted(keys)], *[[pack(n)] for n in both], [int(word.sum())], *[[int(n[word].sum())] for n in both])

    blocks = _grouped(docs, parts).groupBy("g").cogroup(good.groupBy("g")).applyInArrow(count, sent)
    counts = stash(blocks.groupBy("b").applyInArrow(add, summed), "bigrams")
    r = counts.agg(F.sum("words").alias("w"), F.sum("n_good").alias("g"), F.sum("n_every").alias("e")).first()
    return Models(counts.select("b", "keys", "good", "every"), parts, bits, r.w or 0, (r.g or 0, r.e or 0))


def score_documents(docs: DataFrame, models: Models, strength: float = 32.0) -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss`` (mean bits a token) and ``score``."""
    prepare(docs.sparkSession)
    parts, bits, total, size = models.parts, models.bits, models.total, models.words + 1
    rows = _grouped(docs, _group_count(_text_bytes(docs)))
    asked, told = "g long, b long, keys binary", "g long, b long, good binary, every binary"
    out = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"

    def ask(rows: pa.Table) -> pa.Table:
        keys = _keys(rows, bits).keys
        cut = _cuts(keys, parts, bits)
        b = np.flatnonzero(np.diff(cut)).tolist()
        return arrow_rows(asked, [rows["g"][0].as_py()] * len(b), b, [pack_sorted(keys[cut[i] : cut[i + 1]]) for i in b])

    def tell(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        keys = np.concatenate([np.empty(0, np.uint64), *_all_keys(counts["keys"])])
        both = [np.concatenate([np.empty(0, np.int64), *_all_counts(counts[c])]) for c in ("good", "every")]
        answers = [[], []]
        for own in _all_keys(blocks["keys"]):
            at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
            known = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            for n, to in zip(both, answers, strict=True):
                to.append(pack(np.where(known, n[at], 0) if len(keys) else np.zeros(len(own), np.int64)))
        return arrow_rows(told, blocks["g"].to_pylist(), blocks["b"].to_pylist(), *answers)

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        k, answers = _keys(rows, bits), answers.sort_by("b")
        loss = []
        for name, every in zip(("good", "every"), total, strict=True):
            n = np.concatenate([np.empty(0, np.int64), *_all_counts(answers[name])]).astype(float)
            p = (n[k.word] + 1) / (every + size)
            loss.append(-np.log2((n[k.pair] + strength * p) / (n[k.before] + strength)))
        mean = [np.bincount(k.text_of, x, len(k.n)) / np.maximum(k.n, 1) for x in (*loss, loss[1] - loss[0])]
        return arrow_rows(out, rows["doc_id"].to_pylist(), k.n, *mean)

    answers = rows.groupBy("g").applyInArrow(ask, asked).groupBy("b").cogroup(models.counts.groupBy("b")).applyInArrow(tell, told)
    return rows.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(score, out)
