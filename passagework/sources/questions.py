"""Evaluation questions: a declared JSON source, and its violations as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import QUESTIONS

CATEGORIES, MATCHES = ("factual", "synthesis", "unanswerable"), ("all", "any")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).option("multiLine", True).json(path)


def violations(questions: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(id, rule) for each broken rule; ``fixtures`` has a row for each known ``filename``."""
    missing = [questions.where(F.col(c).isNull()).select("id", F.lit(f"missing {c}").alias("rule")) for c in questions.columns]
    answerable = F.col("category") != "unanswerable"
    rules = [
        *missing,
        questions.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("rule")),
        questions.where(~F.col("category").isin(*CATEGORIES)).select("id", F.lit("unknown category").alias("rule")),
        questions.where(~F.col("match").isin(*MATCHES)).select("id", F.lit("unknown match").alias("rule")),
        questions.where(answerable & (F.size("must_contain") <= 0)).select("id", F.lit("no needle").alias("rule")),
        questions.select("id", F.explode("document_filenames").alias("filename")).join(fixtures, "filename", "left_anti").select("id", F.lit("unknown document").alias("rule")),
    ]
    return reduce(DataFrame.unionByName, rules)
