"""Rows as the screens of the application show them: messages, scopes, graph lists, request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped

QUESTION_CHARS, SCOPE_IDS, PAGE_ROWS = 2_000, 200, 50
#: Distance between the curves of edges that join the same two nodes.
CURVE = 0.22
_TYPE_LABELS = {"pdf": "PDF", "markdown": "Markdown", "html": "HTML"}


# --- messages -----------------------------------------------------------------------------------------


def message_kind(role: Column, empty_reason: Column) -> Column:
    """user, then refusal, then notice (any other reason), else assistant."""
    return F.when(role == "user", "user").when(empty_reason == "refusal", "refusal").when(F.coalesce(empty_reason, F.lit("")) != "", "notice").otherwise("assistant")


def message_text(kind: Column, question: Column, segments: Column) -> Column:
    """What a search may find: the question, or the segments' texts; refusals and notices have none."""
    texts = F.array_join(F.transform(segments, lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    return F.coalesce(F.when(kind == "user", question).when(kind == "assistant", texts), F.lit(""))


def chronological(page: DataFrame, *order: str) -> DataFrame:
    """A newest-first page, oldest first."""
    return page.orderBy(*order)


def request_reason(question: Column, document_ids: Column) -> Column:
    """Why a question is turned away; null if it is not."""
    n = F.length(stripped(F.coalesce(question, F.lit(""))))
    return F.when(n == 0, "blank question").when(n > QUESTION_CHARS, "question too long").when(F.coalesce(F.size(document_ids), F.lit(0)) > SCOPE_IDS, "too many documents")


def page_limit_reason(limit: Column) -> Column:
    return F.when(~F.coalesce(limit.between(1, PAGE_ROWS), F.lit(False)), "limit out of range")


# --- the scope of a chat ------------------------------------------------------------------------------


def toggled(selected: Column, document_id: Column) -> Column:
    """The selection without the id if it holds it, else with the id at its end."""
    return F.when(F.array_contains(selected, document_id), F.filter(selected, lambda x: x != document_id)).otherwise(F.array_append(selected, document_id))


def retained(selected: Column, valid: Column) -> Column:
    """The selected ids that are valid, in their order."""
    return F.filter(selected, lambda x: F.array_contains(valid, x))


def ready_scope(selections: DataFrame, documents: DataFrame, owner: str = "user_id") -> DataFrame:
    """Selections (owner, document_id, ...) whose document is the owner's and Ready: for selections of any length."""
    return selections.join(documents.where("status = 'Ready'").select(owner, F.col("id").alias("document_id")), [owner, "document_id"], "left_semi")


# --- public rows ----------------------------------------------------------------------------------------


def public_documents(documents: DataFrame, is_duplicate: Column | None = None) -> DataFrame:
    """Documents as they are answered: without content, owner and hash."""
    columns = ["id", "filename", "file_type", "file_size_bytes", "status", "created_at", "chapter_breakdown", "failed_reason"]
    return documents.select(*columns, (F.lit(False) if is_duplicate is None else is_duplicate).alias("is_duplicate"), "folder_id")


def public_accounts(users: DataFrame) -> DataFrame:
    return users.select("id", "full_name", "email", "theme", "language", F.col("email_verified_at").isNotNull().alias("email_verified"))


def type_label(file_type: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in _TYPE_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, file_type), file_type)


def date_label(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "MMM d, yyyy"), F.lit("—"))


def passage_total(breakdown: Column) -> Column:
    """Passages of all chapters; none of a document without a breakdown."""
    return F.coalesce(F.aggregate(breakdown, F.lit(0), lambda n, c: n + c["passages"]), F.lit(0))


# --- the graph ----------------------------------------------------------------------------------------


def node_id(type_: Column, name: Column) -> Column:
    return F.concat_ws(":", type_, name)


def node_types(nodes: DataFrame) -> DataFrame:
    """(type, n) of each type, by type: as many rows as there are types."""
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy("type")


def grouped_nodes(nodes: DataFrame, rank: str) -> DataFrame:
    """Nodes of a view with their places: groups by type, inside a group the view's order."""
    return nodes.withColumns({"group": F.dense_rank().over(Window.orderBy("type")), "place": F.row_number().over(Window.partitionBy("type").orderBy(rank))})


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source, target, ...) with the names of their ends; an id without a node stands for itself."""
    for end in ("source", "target"):
        names = nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
        edges = edges.join(names, end, "left").withColumn(f"{end}_name", F.coalesce(f"{end}_name", end))
    return edges


def curved_edges(edges: DataFrame, *order: str) -> DataFrame:
    """Add ``curvature``: edges between the same two nodes spread evenly, all on one side's account.

    An edge without a parallel is straight.  The sign is that of the direction from the lesser end.
    """
    first = F.least("source", "target")
    pair = Window.partitionBy(first, F.greatest("source", "target"))
    n, i = F.count(F.lit(1)).over(pair), F.row_number().over(pair.orderBy(*order)) - 1
    offset = (i - (n - 1) / 2) * CURVE
    return edges.withColumn("curvature", F.when(n < 2, 0.0).when(F.col("source") == first, offset).otherwise(-offset))
