"""Rebuilds of passages or of the graph from all Ready documents: in rounds, with a ledger, seen only when they are whole.

A rebuild has a folder of its own, a publication of as many batches as it has rounds; a document's round goes by a hash of its id.
The ledger is what is published there: a rebuild that breaks off goes on with the rounds that are not.
A document that fails is a row of the ledger with its stage and reason, and fails no other.  When every round is done,
and what became Ready meanwhile, one row makes the rebuild the current one; until then readers see the one before.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking
from ..sources.documents import PdfReader, parsed
from ..streaming.library_ingest import EDGES, NODES, PASSAGES, with_failures
from ..streaming.publication import OUTCOMES, Attempt, attempts, outcomes, published, read_or_empty
from .answer import Embedder, embedded_or_reason
from .extraction import extracted, graph_rows
from .provider import EXTRACTION_ATTEMPTS, Call

#: From an attempt and its documents to (document_id, user_id, stage, message, ...) rows; writes its tables.
Step = Callable[[Attempt, DataFrame], DataFrame]
ROUNDS = 16
POINTER = "name string, number long"
_COLUMNS = [c.split(" ")[0] for c in OUTCOMES.split(", ")]


def reindex_step(embedder: Embedder | None = None, pdf_reader: PdfReader | None = None) -> Step:
    """Files (document_id, user_id, filename, file_type, content) to ``passages``."""

    def step(attempt: Attempt, documents: DataFrame) -> DataFrame:
        read = attempt.write("chapters", parsed(documents.select("document_id", "user_id", "filename", "file_type", "content"), pdf_reader))
        made = chunking.with_chunk_ids(chunking.chunks(read.where("stage is null"), "document_id", F.col("chapters"), carry=("user_id",))).withColumnRenamed("id", "document_id")
        if embedder is None:
            made = made.withColumns({"embedding": F.lit(None).cast("array<float>"), "reason": F.lit(None).cast("string")})
        else:
            made = embedded_or_reason(made, "text", "document_id", embedder)
        rows = attempt.write("passages", made)
        states = read.select("document_id", "user_id", "filename", "file_type", "stage", "message")
        return with_failures(states, rows.where("reason is not null").select("document_id", F.col("reason").alias("message")), "indexing")

    return step


def graph_step(passages: DataFrame, call: Call, tries: int = EXTRACTION_ATTEMPTS, sleep: Callable[[float], None] = time.sleep) -> Step:
    """Documents, by what their ``passages`` say, to ``nodes`` and ``edges``; the graph begins from nothing."""

    def step(attempt: Attempt, documents: DataFrame) -> DataFrame:
        own = passages.withColumnRenamed("document_id", "id").join(documents.select(F.col("document_id").alias("id")), "id", "left_semi")
        texts = chunking.extraction_text(own).withColumnRenamed("id", "document_id")
        found = attempt.write("extracted", extracted(documents.select("document_id", "user_id").join(texts, "document_id"), call, tries, sleep))
        nodes, edges = graph_rows(found)
        attempt.write("nodes", nodes)
        attempt.write("edges", edges)
        states = documents.select("document_id", "user_id", "filename", "file_type").withColumns({"stage": F.lit(None).cast("string"), "message": F.lit(None).cast("string")})
        return with_failures(states, found.where("stage is not null").select("document_id", "message"), "extraction")

    return step


def _round(attempt: Attempt, documents: DataFrame, step: Step) -> None:
    done = step(attempt, documents)
    for name in set(_COLUMNS) - set(done.columns):
        done = done.withColumn(name, F.lit(None))
    kinds = {c.split(" ")[0]: c.split(" ")[1] for c in OUTCOMES.split(", ")}
    attempt.write("documents", done.select(*(F.col(c).cast(kinds[c]).alias(c) for c in _COLUMNS)))
    attempt.publish()


def rebuilt(documents: DataFrame, root: str, name: str, step: Step, rounds: int = ROUNDS, again: bool = False) -> DataFrame:
    """The ledger (document_id, stage, message) of the rebuild ``name``, finished and made current; call it again after a failure.

    ``documents``: (document_id, user_id, filename, file_type, status, ...), of which the Ready ones are rebuilt; null ids are no
    documents.  ``again`` also tries those once more that failed before.  ``rounds`` must be the same in every call for a name.
    """
    spark = documents.sparkSession
    folder = f"{root}/rebuilds/{name}"
    ready = documents.where("status = 'Ready' and document_id is not null").withColumn("document_id", F.col("document_id").cast("string"))
    finished = {r["batch"] for r in attempts(spark, folder).select("batch").collect()}  # a row a round
    for k in range(rounds):
        if k not in finished:
            _round(Attempt(spark, folder, k), ready.where(F.pmod(F.xxhash64("document_id"), F.lit(rounds)) == k), step)
    # what came meanwhile, and what may be tried once more
    ledger = outcomes(spark, folder)
    missing = ready.join(ledger.where("stage is null") if again else ledger, "document_id", "left_anti")
    if not missing.select("document_id").isEmpty():
        _round(Attempt(spark, folder, max([rounds - 1, *finished]) + 1), missing, step)
    number = read_or_empty(spark, f"{root}/current", POINTER).agg(F.max("number")).first()[0] or 0
    if current(spark, root) != name:
        spark.createDataFrame([(name, number + 1)], POINTER).coalesce(1).write.mode("append").parquet(f"{root}/current")
    return outcomes(spark, folder).select("document_id", "stage", "message")


def current(spark: SparkSession, root: str) -> str | None:
    """The name of the rebuild that readers see."""
    row = read_or_empty(spark, f"{root}/current", POINTER).orderBy(F.desc("number"), F.desc("name")).first()
    return row["name"] if row else None


def rows(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``passages``, ``nodes`` or ``edges`` of the current rebuild."""
    schema = {"passages": PASSAGES, "nodes": NODES, "edges": EDGES}[table]
    name = current(spark, root)
    return spark.createDataFrame([], schema) if name is None else published(spark, f"{root}/rebuilds/{name}", table, schema)
