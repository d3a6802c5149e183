"""The subpackage's queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, lmscore, simhash, spotsigs, substrings, tokens, topk, toxicity
from tessera.llm.common import read_table


def op1_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed id matrices of all documents: segments and digests of ids and positions."""
    packed = tokens.pack_best_fit(read_table(spark, sf_dir, "documents"))
    return packed.select("sequence_id", "n_tokens", "cu_seqlens", "doc_ids", "pieces", "starts", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, grammar).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.repeated_words(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return lmscore.score_documents(docs, lmscore.fit(docs, read_table(spark, sf_dir, "labels")))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_edited(read_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = language.train(docs)
    found = language.identify(docs.select("doc_id", "text"), model).select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score")
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op9_minimum_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = tokens.pack_minimum_slack(tokens.document_pieces(read_table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = tokens.encode_documents(read_table(spark, sf_dir, "documents"))
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_best_fit_decreasing, op2_simhash, op3_toxicity, op4_substrings, op5_cross_entropy_difference, op6_topk, op7_spotsigs, op8_language, op9_minimum_slack, op10_byte_bpe)}
ORACLE_SQL = {"op4_substrings": substrings.ORACLE, "op6_topk": topk.ORACLE}
