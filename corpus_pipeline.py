"""A training corpus from raw documents: quality, near-duplicates, personal data, mixing, packing.

Defined cases, for every stage: rows with equal or null ids are rows of their own,
and of rows with equal texts near-duplicate removal leaves one; null texts are
empty, and the quality rules reject them; null languages and sources are values;
texts of any length are taken whole; an empty table gives an empty result; columns
other than those of ``documents`` are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagework.llm.common import settle, table
from passagework.llm.mixing import mix
from passagework.llm.packing import pack
from passagework.llm.pii import personal_data, redacted
from passagework.llm.quality import quality_rules
from passagework.llm.queries import tokenizer_path
from passagework.llm.simhash import distinct_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the row with the smallest id stays; null ids come last."""
    return distinct_documents(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; ``n_chars`` follows."""
    found = personal_data(docs.select(*COLUMNS))
    clean = found.withColumn("text", redacted(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    mixed = mix(docs, COLUMNS)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in sequences."""
    packed = pack(docs, tokenizer_path("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", deduplicate),
    ("pii", redact),
    ("mixing", mixture),
    ("packing", packing),
]

#: The estimates, bit signatures and the linear program are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, f"pipeline-{name}")
    return docs
