"""Answer quality and isolation, measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_or_any, percent
from . import scopes


def classified(results: DataFrame) -> DataFrame:
    """Add ``status`` and ``is_refusal`` to (category, outcome, text, must_contain, match, failed).

    An answer out of a broken scope is an error of the harness: the row fails the query.
    """
    answerable = F.col("category") != "unanswerable"
    broken = ~F.col("failed") & F.col("outcome").isin("no_documents", "empty_scope")
    hit = (F.col("outcome") == "answered") & all_or_any(F.col("text"), F.col("must_contain"), F.col("match"))
    status = (
        F.when(F.col("failed"), "error")
        .when(broken, F.raise_error(F.lit("the scope of a question is broken")))
        .when(answerable, F.when(hit, "correct").otherwise("incorrect"))
        .when(F.col("outcome").isin("refusal", "no_answer"), F.col("outcome"))
        .otherwise("violation")
    )
    return results.withColumns({"status": status, "is_refusal": ~F.col("failed") & (F.col("outcome") == "refusal")})


def metrics(scored: DataFrame) -> DataFrame:
    """One row of counts and ratios from (category, status, is_refusal); errors are left out of the ratios."""
    answerable = F.col("category") != "unanswerable"
    ok = F.col("status") != "error"
    counts = scored.agg(
        F.count_if(answerable & ok).alias("answerable"),
        F.count_if(answerable & (F.col("status") == "correct")).alias("correct"),
        F.count_if(answerable & ok & F.col("is_refusal")).alias("over_refused"),
        F.count_if(~answerable & ok).alias("unanswerable"),
        F.count_if(~answerable & (F.col("status") == "refusal")).alias("refused"),
        F.count_if(~answerable & (F.col("status") == "violation")).alias("violations"),
        F.count_if(~ok).alias("errors"),
    )
    return counts.select(
        "*",
        percent(F.col("correct"), F.col("answerable")).alias("accuracy"),
        percent(F.col("refused"), F.col("unanswerable")).alias("refusal_rate"),
        percent(F.col("over_refused"), F.col("answerable")).alias("over_refusal_rate"),
    )


def leaks(owned: DataFrame, owner: str, item: str) -> DataFrame:
    """Items that more than one owner can see."""
    return owned.groupBy(item).agg(F.count_distinct(owner).alias("owners")).where("owners > 1")


def verdict(n_leaks: Column, n_seen: Column) -> Column:
    """Absence proves nothing unless the control was seen."""
    return F.when(n_leaks > 0, "fail").when(n_seen == 0, "inconclusive").otherwise("pass")


def fixture_action(outcome: Column, status: Column) -> Column:
    """What a run does with a fixture that it has uploaded; an outcome that no upload has fails the run."""
    return (
        F.when(outcome.isin("created", "reingested"), "ingest")
        .when((outcome == "duplicate") & (status == "Ready"), "reuse")
        .when(outcome == "duplicate", "poll_or_abort")
        .otherwise(F.raise_error(F.concat(F.lit("no such outcome: "), F.coalesce(outcome, F.lit("null")))))
    )


def not_ready(fixtures: DataFrame, status: DataFrame) -> DataFrame:
    """Fixtures (filename, document_id) without a Ready document: a run starts when there are none."""
    current = status.groupBy("document_id").agg(F.max_by("status", "seq").alias("status"))
    return fixtures.join(current, "document_id", "left").where(F.coalesce(F.col("status") != "Ready", F.lit(True)))


def over_whole_corpus(questions: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, lists) with all of the given documents of their owner in scope, however many, and no history."""
    return scopes.over_documents(questions.drop("history"), documents)


def results(questions: DataFrame, answered: DataFrame) -> DataFrame:
    """Questions with their outcome and text; what has no answer, or none that could be had, has failed."""
    text = F.array_join(F.transform("segments", lambda s: s["text"]), " ")
    joined = questions.join(answered.select("query_id", "outcome", F.coalesce(text, F.lit("")).alias("text")), "query_id", "left")
    return joined.withColumn("failed", F.coalesce(F.col("outcome") == "unavailable", F.lit(True)))
