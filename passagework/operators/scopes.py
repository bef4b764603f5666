"""Which documents a question may draw on: all of its owner's, a list of any length, or none.

A list is rows (query_id, document_id), not an array, so that a question over ten thousand
documents is no larger than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TOP_PASSAGES
from .retrieval import best, compared
from .screens import SCOPE_IDS

ALL, LIST, NONE = "all", "list", "none"


def of_arrays(questions: DataFrame, column: str = "document_ids") -> tuple[DataFrame, DataFrame]:
    """(questions with ``scope_kind``, their lists): a null or empty array is no restriction."""
    kind = F.when(F.coalesce(F.size(column), F.lit(0)) > 0, LIST).otherwise(ALL)
    lists = questions.select("query_id", F.explode(F.col(column).cast("array<string>")).alias("document_id"))
    return questions.withColumn("scope_kind", kind).drop(column), lists


def over_documents(questions: DataFrame, documents: DataFrame, owner: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(questions, their lists): each over all the given documents of its owner; an owner without any has none."""
    lists = questions.select("query_id", owner).join(documents.select(owner, F.col("document_id").cast("string").alias("document_id")), owner).select("query_id", "document_id")
    owners = documents.select(owner).distinct().withColumn("_any", F.lit(True))
    kind = F.when(F.col("_any"), LIST).otherwise(NONE)
    return questions.drop("document_ids").join(owners, owner, "left").withColumn("scope_kind", kind).drop("_any"), lists


def nearest_in_scope(questions: DataFrame, lists: DataFrame, passages: DataFrame, owner: list[str], k: int = TOP_PASSAGES, exclude_self: bool = False) -> DataFrame:
    """(query_id, passage_id, distance, rank): the ``k`` nearest of the owner's passages in each question's scope.

    ``questions``: (query_id, embedding, scope_kind, *owner); ``passages``: (passage_id, document_id, embedding,
    *owner).  Documents are dealt into so many buckets that the longest list has about ``SCOPE_IDS`` of them in each, and a question
    meets only buckets that its list has something of; whether what is dealt is sent to all tasks or shuffled goes by its
    size.  A list of no documents that exist, and a null kind, find nothing; repeated and null entries of a list change nothing.
    """
    q = questions.select("query_id", F.col("embedding").alias("_v"), "scope_kind", *owner)
    p = passages.select("passage_id", F.col("embedding").alias("_v"), F.col("document_id").cast("string").alias("document_id"), *owner)
    whole = compared(q.where(F.col("scope_kind") == ALL).drop("scope_kind"), p.drop("document_id"), owner, k, exclude_self)
    lists = lists.select("query_id", F.col("document_id").cast("string").alias("document_id")).where("document_id is not null").distinct()
    longest = lists.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    buckets = max(1, -(-longest // SCOPE_IDS))
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")
    # arrays of about SCOPE_IDS entries, whatever the list
    parts = lists.groupBy("query_id", bucket.alias("_bucket")).agg(F.collect_list("document_id").alias("document_ids"))
    listed = q.where(F.col("scope_kind") == LIST).drop("scope_kind").join(parts, "query_id")
    within = compared(listed, p.withColumn("_bucket", bucket), [*owner, "_bucket"], k, exclude_self)
    return best(whole.unionByName(within), k, "query_id")
