"""A chat: questions are answered with the turns before them in mind, kept as turns, and read back page by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import uuid5
from ..functions.text import stripped
from ..operators import conversation, library
from ..schemas import CHAT_MESSAGES, PAGE_SIZE
from ..settings import settled
from .answer import answered, with_history
from .provider import Call

SEGMENTS = "array<struct<text:string,citations:array<struct<chapter:string,document_filename:string,chunk_indexes:array<int>>>>>"
#: Outcomes of which nothing is kept: the question never got so far, or may be asked again.
NOT_KEPT = ("invalid", "unavailable")


def kept_segments(segments: Column) -> Column:
    """Segments of ``answered`` as a message holds them."""

    def citation(c: Column) -> Column:
        return F.struct(c["chapter"].alias("chapter"), c["filename"].alias("document_filename"), c["chunk_indexes"].cast("array<int>").alias("chunk_indexes"))

    made = F.transform(segments, lambda s: F.struct(s["text"].alias("text"), F.transform(s["citations"], citation).alias("citations")))
    return F.coalesce(made.cast(SEGMENTS), F.array().cast(SEGMENTS))


def turns(questions: DataFrame, found: DataFrame, owner: str, at: Column) -> DataFrame:
    """Message rows of answered questions (query_id, question, owner): the question's and the answer's, at one time.

    An owner's turns of one batch are a microsecond apart, by ``query_id``, so that they are told apart.  A refusal or an empty scope is a turn too, with its reason and no segment.
    """
    done = found.where(~F.col("outcome").isin(*NOT_KEPT)).join(questions.select("query_id", F.col(owner).cast("string").alias("user_id"), "question"), "query_id")
    rows = done.select("query_id", "user_id", "question", kept_segments(F.col("segments")).alias("segments"), F.when(F.col("outcome") != "answered", F.col("outcome")).alias("empty_reason"), at.alias("_at"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("query_id")) - 1
    rows = rows.withColumn("created_at", F.timestamp_micros(F.unix_micros(F.col("_at").cast("timestamp")) + place)).drop("_at")
    pairs = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("question"), F.lit(None).cast(SEGMENTS).alias("segments"), F.lit(None).cast("string").alias("empty_reason")),
        F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("question"), F.col("segments"), F.col("empty_reason")),
    )
    flat = rows.select("query_id", "user_id", "created_at", F.explode(pairs).alias("r")).select("query_id", "user_id", "created_at", "r.*")
    name = F.concat_ws(":", F.col("query_id").cast("string"), "role", F.col("created_at").cast("string"))
    return flat.withColumn("id", uuid5(name)).drop("query_id")


def asked(questions: DataFrame, messages: str, passages: DataFrame, documents: DataFrame, provider: Call, scope: list[str], at: Column, use_history: bool = True, **how) -> DataFrame:
    """(query_id, outcome, segments) of a batch of questions, each turn of which is added to the table below ``messages``.

    ``scope`` begins with the owner's column; ``how`` is that of ``answered``.  Questions of a batch do not see each other's turns.  Turns are added
    in one write after all answers are there; without ``use_history`` earlier ones are not read, yet turns are kept.
    """
    from ..streaming.publication import read_or_empty

    owner = scope[0]
    questions = questions.withColumn("question", stripped(F.col("question")))
    if use_history:
        rows = read_or_empty(questions.sparkSession, messages, CHAT_MESSAGES)
        text = F.when(F.col("role") == "user", F.col("question")).otherwise(conversation.turn_text(F.col("segments")))
        ranked = rows.select(F.col("user_id").alias(owner), "created_at", conversation.role_rank(F.col("role")).alias("rank"), "id", "role", F.coalesce(text, F.lit("")).alias("text"))
        questions = with_history(questions.withColumn(owner, F.col(owner).cast("string")), ranked, owner, ["created_at", "rank", "id"])
        passages = passages.withColumn(owner, F.col(owner).cast("string"))
    found = settled(answered(questions, passages, documents, provider, scope, **how), "answers")
    library.inserted(turns(questions, found, owner, at), CHAT_MESSAGES, messages)
    return found


def page(messages: DataFrame, user_id: str, cursor: str | None = None, limit: int = PAGE_SIZE) -> tuple[DataFrame, str | None]:
    """(rows of a page, oldest first; the cursor of the page before it, None if there is none)."""
    if not 1 <= limit <= 50:
        raise ValueError("limit out of range")
    order = ["created_at", "_rank", "id"]
    rows = messages.where(F.col("user_id") == user_id).withColumn("_rank", conversation.role_rank(F.col("role")))
    newest = conversation.page_before(rows, order, None if cursor is None else conversation.decode_cursor(cursor), limit).orderBy(*order)
    # a page is at most 50 rows
    first = newest.select(conversation.encode_cursor(F.col("created_at"), F.col("_rank"), F.col("id")).alias("c"), "has_more").first()
    return newest.drop("_rank", "has_more"), first["c"] if first and first["has_more"] else None
