"""The queries opN_<name> and their DuckDB SQL.  Each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm import bpe, langid, license_scan, line_dedup, merkle, mixing, order_minhash, quality, rabitq, repair, superminhash, toxicity, warc
from tillcast.llm.common import input_table


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document: token counts and digests of the ids and of the decoded bytes."""
    return bpe.digests(input_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, by capped water-filling over the sources."""
    return mixing.mix(input_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back: payload length and digest, record type, what it revisits."""
    back = warc.round_trip(input_table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by compression distance."""
    docs, labels = input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "labels")
    return toxicity.classify(docs, labels).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document from random Fourier features of its statistics."""
    docs, labels = input_table(spark, sf_dir, "documents"), input_table(spark, sf_dir, "labels")
    return quality.classify(docs, labels).withColumnRenamed("id", "doc_id")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: family, then pairwise linear SVMs."""
    return langid.identify(input_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash of every document and of its edited text, and their likeness."""
    return order_minhash.compare(input_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 2-word shingles at a similarity of 0.8."""
    out = superminhash.near_duplicates(input_table(spark, sf_dir, "documents"), width=2)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op4_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all embeddings at a cosine of 0.98 within a label."""
    return rabitq.near_duplicates(input_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that an earlier line of the corpus nearly repeats; class and links of all similar lines."""
    out = line_dedup.matches(input_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "removed", "matches")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License labels of every document: phrases in their places and notices by an exact set-similarity join."""
    return license_scan.scan(input_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("hits")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents: leaf, subroot, root, proof, and the root that a tampered text leads to."""
    return merkle.op12_manifest(input_table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure repair of all damaged conversations: faults, the cheapest edits, and the repaired text's digest."""
    return repair.op13_repair(input_table(spark, sf_dir, "conversations"))


QUERIES = {"op1_line_dedup": op1_line_dedup, "op4_rabitq": op4_rabitq, "op5_superminhash": op5_superminhash, "op2_order_minhash": op2_order_minhash, "op9_langid": op9_langid, "op3_toxicity": op3_toxicity, "op8_quality": op8_quality, "op6_bpe": op6_bpe, "op7_mixing": op7_mixing, "op10_warc": op10_warc,
           "op11_license_scan": op11_license_scan, "op12_merkle": op12_merkle, "op13_repair": op13_repair}
ORACLE_SQL = {"op7_mixing": mixing.OP7_SQL, "op10_warc": warc.OP10_SQL, "op11_license_scan": license_scan.OP11_SQL, "op12_merkle": merkle.OP12_SQL, "op13_repair": repair.OP13_SQL}
