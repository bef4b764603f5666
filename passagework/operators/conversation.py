"""Conversation history: turns, recency, budget, keyset pages, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_folded, stripped
from ..schemas import HISTORY_CHARS, HISTORY_TURNS, PAGE_SIZE


def role_rank(role: Column) -> Column:
    """Both rows of a turn share a time; the question comes first."""
    return F.when(role == "assistant", 1).otherwise(0)


def recent_rows(messages: DataFrame, key: str, order: list[str], turns: int = HISTORY_TURNS) -> DataFrame:
    """The rows of the newest ``turns`` turns of each key: the limit goes before the shuffle."""
    window = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return messages.withColumn("recency", F.row_number().over(window)).where(F.col("recency") <= 2 * turns)


def turn_pairs(messages: DataFrame, key: str, order: list[str], text: str = "text") -> DataFrame:
    """(key, *order of the question, question, answer): user rows that an assistant row follows."""
    window = Window.partitionBy(key).orderBy(*order)
    ahead = messages.withColumns({"_role": F.lead("role").over(window), "answer": F.lead(text).over(window)})
    return ahead.where((F.col("role") == "user") & (F.col("_role") == "assistant")).select(key, *order, F.col(text).alias("question"), "answer")


def history_window(pairs: DataFrame, key: str, order: str, turns: int = HISTORY_TURNS, budget: int = HISTORY_CHARS) -> DataFrame:
    """The newest ``turns`` pairs of each key with ``kept``: walking back, a pair that would overflow is skipped.

    A skip depends on what was kept before, so it is a fold, over at most ``turns`` pairs.
    """
    window = Window.partitionBy(key).orderBy(F.desc(order))
    newest = pairs.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= turns)
    size = F.length(F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer", F.lit("\n")))
    gathered = newest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", size.alias("size"), F.col(order).alias("at"), "question", "answer"))).alias("turns"))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(state: Column, t: Column) -> Column:
        fits = state["used"] + t["size"] <= budget
        return F.struct(F.when(fits, state["used"] + t["size"]).otherwise(state["used"]).alias("used"), F.when(fits, F.array_append(state["kept"], t["_n"])).otherwise(state["kept"]).alias("kept"))

    folded = gathered.withColumn("_kept", F.aggregate("turns", start, step, lambda s: s["kept"]))
    return folded.select(key, "_kept", F.explode("turns").alias("t")).select(key, F.col("t.at").alias(order), "t.question", "t.answer", F.array_contains("_kept", F.col("t._n")).alias("kept"))


def page_before(messages: DataFrame, order: list[str], cursor: tuple | None, limit: int = PAGE_SIZE) -> DataFrame:
    """One newest-first page strictly before the cursor, with ``has_more``: one row more than asked is read, and dropped.

    The first order column is compared on its own as well, so that the scan can use it.
    """
    rows = messages
    if cursor is not None:
        rows = rows.where(F.col(order[0]) <= F.lit(cursor[0])).where(F.struct(*order) < F.struct(*[F.lit(v).alias(c) for v, c in zip(cursor, order)]))
    page = rows.orderBy(*[F.desc(c) for c in order]).limit(limit + 1)
    newest = Window.orderBy(*[F.desc(c) for c in order])  # over limit + 1 rows
    numbered = page.withColumns({"_n": F.row_number().over(newest), "has_more": F.count(F.lit(1)).over(Window.partitionBy()) > limit})
    return numbered.where(F.col("_n") <= limit).drop("_n")


def encode_cursor(created_at: Column, rank: Column, message_id: Column) -> Column:
    return F.concat_ws("|", F.date_format(created_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"), rank.cast("string"), message_id)


def decode_cursor(cursor: str) -> tuple:
    """(created_at, rank, id); ValueError if malformed, as is an empty cursor."""
    import uuid
    from datetime import datetime

    at, rank, message_id = cursor.split("|", 2)
    if rank not in ("0", "1"):
        raise ValueError(f"no such rank: {rank}")
    return datetime.fromisoformat(at), int(rank), str(uuid.UUID(message_id))


def search(messages: DataFrame, key: str, order: list[str], needle: str, text: str = "text") -> DataFrame:
    """(key, *order, ordinal, of): user and assistant messages that contain the needle, numbered in each key."""
    wanted = stripped(F.lit(needle))
    hits = messages.where(F.col("role").isin("user", "assistant") & (wanted != "") & contains_folded(F.col(text), wanted))
    window = Window.partitionBy(key)
    return hits.select(key, *order, F.row_number().over(window.orderBy(*order)).alias("ordinal"), F.count(F.lit(1)).over(window).alias("of"))


def turn_text(segments: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(segments, lambda s: s["text"]), " "), F.lit(""))


def turn_rows(turns: DataFrame) -> DataFrame:
    """Both rows of each answered question, one write with one time: (user_id, question, segments, empty_reason, created_at)."""
    rows = F.array(
        F.struct(F.lit("user").alias("role"), F.col("question").alias("question"), F.lit(None).cast(turns.schema["segments"].dataType).alias("segments"), F.lit(None).cast("string").alias("empty_reason")),
        F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("question"), F.col("segments").alias("segments"), F.col("empty_reason").alias("empty_reason")),
    )
    return turns.select("user_id", "created_at", F.explode(rows).alias("r")).select("user_id", "created_at", "r.*")
