"""A corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each
result as Parquet in the shared folder and reads it again for the next. All stages but the
last return the columns of ``documents``, extra ones included, whatever their names.
Repeated rows stay until near-dedup; null texts have no language and go in the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, nearcopies, simhash, substrings, tokens, toxicity
from tessera.llm.common import read_table, stash, unstash


def _unpack(df: DataFrame, columns: list[str]) -> DataFrame:
    """The fields of ``row`` as columns, in the documents' order."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found: null, or without a letter. Where no row
    tells its language, there is no model, and all others stay."""
    model = language.train(docs)
    if model is None:
        return _unpack(language.lettered(docs), docs.columns)
    found = language.identify(docs, model)
    return _unpack(found.where("lang_pred <> 'und'"), docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score is 0.5 or more."""
    grammar = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    return _unpack(toxicity.score_documents(docs, grammar).where("score < 0.5"), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, by SimHash and by five-word shingle
    sets with a Jaccard similarity of 0.8 or more: that with the smallest ``doc_id``; of rows
    of the group that repeat it, one: an id on unrelated texts is one row in each of their groups. A row without an id is kept only where its group has no other, one
    for each group."""
    groups = nearcopies.near_copy_groups(docs, words=5)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"))
    # an id whose rows have one fingerprint is in one group; that of others only the fingerprint tells
    ids = stash(groups.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("fp"), F.max("fp").alias("last"), F.min("component_id").alias("component_id")), "ids")
    keep = ids.where("fp = last and component_id = doc_id").select("doc_id")
    several = ids.where("fp <> last").select(F.col("doc_id").alias("id"))
    named = rows.join(keep, rows.id == keep.doc_id, "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    repeated = groups.join(several, groups.doc_id == several.id, "left_semi").where("component_id = doc_id")
    heads = stash(repeated.unionByName(groups.where("component_id is null")).groupBy("label").agg(F.min("fp").alias("least_fp"), F.min("doc_id").alias("own")).select("least_fp", "own"), "heads")
    if heads.isEmpty():
        return _unpack(named, docs.columns)
    rest = docs.where(docs["doc_id"].isNull()).union(docs.join(several, docs["doc_id"] == several.id, "left_semi"))
    with_fp = simhash.with_fingerprint_rows(rest, words=5)
    same = (with_fp.fp == heads.least_fp) & with_fp.row.getField("doc_id").eqNullSafe(heads.own)
    one = with_fp.join(heads, same, "left_semi").groupBy("fp").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return _unpack(named.select("row").unionByName(one.select("row")), docs.columns)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove words covered by a 20-word window that starts earlier elsewhere; texts
    without one stay as they are, texts of which nothing is left go. ``n_chars`` follows."""
    names = docs.columns
    own = next(c for c in (f"text{i}" for i in range(len(names) + 1)) if c not in {n.lower() for n in names})
    kept = substrings.repeated_words(docs.withColumn(own, F.col("text")))
    cut = F.col("n_removed") > 0
    out = {c: F.col("rest").getField(c) for c in names if c != "text"}
    out["text"] = F.when(cut, F.col("kept_text")).otherwise(F.col("rest").getField(own))
    if "n_chars" in out:
        out["n_chars"] = F.when(cut, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    left = kept.where(~cut | (F.col("n_removed") < F.col("n_words")))
    return left.select(*[out[c].alias(c) for c in names])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens by minimum bin slack."""
    packed = tokens.pack_minimum_slack(tokens.document_pieces(docs))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language ID", identify_language),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", remove_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: SQL can express neither the classifiers nor XXH64 nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        done = stash(stage(spark, docs, sf_dir), f"stage{i}")
        unstash(docs)
        docs = done
    return docs
