"""A corpus made ready for training: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, common, minhash, mixing, quality, repeats
from sparkloom.llm.queries import SOURCE_WEIGHTS, table, vocab_path

#: Bytes of a passage that goes when a document with a smaller doc_id has it: prose of over 50 words is longer, and most
#: lines that clean documents share are shorter.
PASSAGE = 150
#: Similarity in percent from which documents are near-duplicates.
NEAR = 80


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    return quality.score(docs, table(spark, sf_dir, "labels")).filter("kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group; rows without doc_id stay.

    Rows equal in doc_id and text count once; different texts of one doc_id are one document, and stay or go together.
    """
    first = minhash.near_duplicates(docs, NEAR).filter("kept").select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller doc_id has; documents of nothing else go.

    Each row gets its other columns back by doc_id (null is a value here) and text; of rows equal in both, those of one.
    """
    left = repeats.Repeats(docs, PASSAGE).kept(characters=True, digests=True)
    left = left.filter("n_removed = 0 or length(trim(cast(kept as string))) > 0")
    left = left.select(F.col("doc_id").alias("_d"), F.col("text_sha256").alias("_s"), F.col("kept").cast("string").alias("_text"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    rest = docs.withColumn("_t", digest).drop("text", "n_chars").dropDuplicates(["doc_id", "_t"])
    both = left.join(rest, F.col("_d").eqNullSafe(F.col("doc_id")) & (F.col("_s") == F.col("_t")))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return both.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, repeated rows too, in the order of the mixture; null and unnamed sources share a class."""
    return mixing.in_order(mixing.mix(docs, SOURCE_WEIGHTS)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row; null and empty texts have no ids and decode to the empty text."""
    return bpe.round_trip(docs, vocab_path())


STAGES = [
    ("quality classifier", reject_low_quality), ("MinHash near-dedup", drop_near_duplicates), ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources), ("BPE encoding and decoding", encode),
]

#: SQL cannot express the classifier or the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
