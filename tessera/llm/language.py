"""Hierarchical language identification with linear support vector machines.

Features are hashed byte 2- and 3-grams of the lower-cased letters of a whole text: square
roots of counts, scaled to length 1. A first level separates language families (one
machine for each pair of families); within the family chosen, one machine for each pair of
its languages votes. Machines are trained by dual coordinate descent on a bounded sample of
labelled rows: ``PER_LANGUAGE`` documents of each language, smallest hashes of ``doc_id``
first, and ``SAMPLE_ROWS`` in all, dealt to the languages in turn; so every language is
learnt while there are no more languages than that. Rows that repeat an id and its text
count once there. Features of the sample stay sparse, the driver makes those of one pair of
languages dense at a time. Everything is scored whole, repeated rows each by itself; where
votes are equal the larger sum of margins decides, then the name that comes first.

A text that is null or has no letter is ``und`` with score 0. The score is the product of
both levels' probabilities, from logistic functions of the margins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pick, prepare, slices

DIMS = 1 << 13
PER_LANGUAGE = 250
SAMPLE_ROWS = 16_000
#: Families of ISO 639-1 codes; a language that is in none is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi bn mr gu pa ne ur",
    "turkic": "tr az kk uz ky tk",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "austronesian": "id ms tl jv",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]+")
_CLASS = np.array([32 if i < 128 and not chr(i).isalpha() else i for i in range(256)], np.uint8)


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, f"only {lang}")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for m in _LETTER.finditer(text) for c in m[0])


def _grams(raw: bytes, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of the 2-grams and the 3-grams that start at each byte."""
    shift = np.uint32(32 - dims.bit_length() + 1)
    buf = _CLASS[np.frombuffer(raw, np.uint8)].astype(np.uint32)
    two = buf[:-1] * np.uint32(257) + buf[1:]
    three = two[:-1] * np.uint32(263) + buf[2:] + np.uint32(7)
    return (two * np.uint32(2654435761)) >> shift, (three * np.uint32(2246822519)) >> shift


def features(texts: list[str | None], dims: int = DIMS, piece: int = 1 << 20) -> np.ndarray:
    """A row of hashed n-gram weights for each text; long texts are counted a piece at a time."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        raw = b" " + (t or "").lower().encode("utf-8", "surrogatepass") + b" "
        for lo in range(0, max(1, len(raw) - 2), piece):
            two, three = _grams(raw[lo : lo + piece + 2], dims)
            last = lo + piece + 2 >= len(raw)
            out[i] += np.bincount(two if last else two[:piece], minlength=dims) + np.bincount(three[:piece], minlength=dims)
    np.sqrt(out, out=out)
    return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, epochs: int = 25) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with squared hinge loss, by dual
    coordinate descent; ``y`` is -1 or 1."""
    x = np.concatenate((x, np.ones((len(x), 1), np.float32)), axis=1)
    w = np.zeros(x.shape[1])
    alpha = np.zeros(len(x))
    norm = (x * x).sum(axis=1) + 1 / (2 * c)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(x)):
            g = y[i] * (x[i] @ w) - 1 + alpha[i] / (2 * c)
            new = max(0.0, alpha[i] - g / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                most = max(most, abs(new - alpha[i]))
                alpha[i] = new
        if most < 1e-3:
            break
    return w


class SparseRows:
    """Rows of features by their columns and values; an index of rows gives them dense."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray], dims: int = DIMS):
        self.columns, self.values, self.shape = columns, values, (len(columns), dims)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(rows) if getattr(rows, "dtype", None) == bool else rows
        out = np.zeros((len(at), self.shape[1]), np.float32)
        for i, r in enumerate(at):
            out[i, self.columns[r]] = self.values[r]
        return out

    def part(self, rows: list[int]) -> SparseRows:
        return SparseRows([self.columns[r] for r in rows], [self.values[r] for r in rows], self.shape[1])


class Hierarchy:
    """The trained machines: between families, and between the languages of each."""

    def __init__(self, x: SparseRows, langs: list[str]):
        self.langs = sorted(set(langs))
        families = [family_of(lang) for lang in langs]
        self.levels = {"": self._pairs(x, families)}
        for f in sorted(set(families)):
            own = [i for i, g in enumerate(families) if g == f]
            self.levels[f] = self._pairs(x.part(own), [langs[i] for i in own])

    @staticmethod
    def _pairs(x: SparseRows, labels: list[str]) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
        names = sorted(set(labels))
        at = np.array([names.index(k) for k in labels])
        pairs = list(combinations(range(len(names)), 2))
        weights = []
        for a, b in pairs:
            own = (at == a) | (at == b)
            w = train_svm(x[own], np.where(at[own] == a, 1.0, -1.0))
            weights.append(w)
        return names, pairs, np.array(weights, np.float32).reshape(len(pairs), x.shape[1] + 1)

    @staticmethod
    def _vote(level, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class with most votes (ties: larger sum of margins) and its probability."""
        names, pairs, w = level
        p = 1 / (1 + np.exp(-4.0 * np.clip(x @ w[:, :-1].T + w[:, -1], -15, 15)))
        votes, total = np.zeros((len(x), len(names))), np.zeros((len(x), len(names)))
        for k, (a, b) in enumerate(pairs):
            votes[:, a] += p[:, k] >= 0.5
            votes[:, b] += p[:, k] < 0.5
            total[:, a] += p[:, k]
            total[:, b] += 1 - p[:, k]
        best = np.argmax(votes + total / (len(names) + 1), axis=1)
        return best, total[np.arange(len(x)), best] / max(1, len(names) - 1) if pairs else np.ones(len(x))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        families, score = self._vote(self.levels[""], x)
        out = np.empty(len(x), object)
        score = score.copy()
        for f, name in enumerate(self.levels[""][0]):
            own = np.flatnonzero(families == f)
            if len(own):
                best, p = self._vote(self.levels[name], x[own])
                out[own] = np.array(self.levels[name][0], object)[best]
                score[own] *= p
        return out.tolist(), score


def held_out(column: str = "doc_id"):
    """crc32 of the id's decimal text modulo 4 is 2."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS) -> Hierarchy | None:
    """Learn from ``text`` and non-null ``lang`` of rows that aren't held out; None if no
    row can be learnt from. Texts without a letter and null ids aren't learnt from."""
    spark = docs.sparkSession
    prepare(spark)
    rows = pick(docs, "doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).withColumn("th", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "th")
    first = rows.select("doc_id", "lang", "th").withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= per_language).distinct()
    chosen = first.orderBy("n", F.xxhash64("doc_id"), "lang", "th").limit(sample_rows).select("doc_id", "lang", "th")
    sample = rows.join(F.broadcast(chosen), ["doc_id", "lang", "th"], "left_semi").dropDuplicates(["doc_id", "lang", "th"]).select("doc_id", "lang", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(2).to_pylist()
            own = [i for i, t in enumerate(texts) if has_letter(t)]
            if own:
                x = features([texts[i] for i in own])
                some = [np.flatnonzero(r).astype(np.uint16) for r in x]
                raw = [c.tobytes() + r[c].tobytes() for r, c in zip(x, some, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own)), b.column(1).take(pa.array(own)), pa.array(raw, pa.binary())], ["doc_id", "lang", "x"])

    got = sample.mapInArrow(run, "doc_id long, lang string, x binary").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.doc_id, r.lang, bytes(r.x)))
    size = [len(r.x) // 6 for r in got]  # two bytes for a column, four for its value
    columns = [np.frombuffer(r.x, np.uint16, n) for r, n in zip(got, size, strict=True)]
    values = [np.frombuffer(r.x, np.float32, n, 2 * n) for r, n in zip(got, size, strict=True)]
    return Hierarchy(SparseRows(columns, values), [r.lang for r in got])


def lettered(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (their columns in the struct ``row``) whose text has a letter."""
    prepare(docs.sparkSession)
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [i for i, t in enumerate(b.column(1).to_pylist()) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64()))], ["row"])

    from pyspark.sql import types as T

    return base.mapInArrow(run, T.StructType([base.schema["row"]]))


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """``docs`` (its columns in the struct ``row``) with ``lang_pred`` and ``score``."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            own = [i for i, t in enumerate(texts) if has_letter(t)] if m else []
            if own:
                named, score[own] = m.predict(features([texts[i] for i in own]))
                for i, name in zip(own, named, strict=True):
                    lang[i] = name
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(score)], ["row", "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([base.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return base.mapInArrow(run, schema)
