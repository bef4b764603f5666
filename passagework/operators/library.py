"""The document library: views, counts, and updates as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.ids import content_hash
from ..functions.text import contains_folded, expired, size_label, stripped
from ..schemas import FOLDER_COLORS, STATUSES
from ..settings import settled
from ..sources.uploads import media_type
from . import screens
from .versions import Versions


def status_rank(status: Column) -> Column:
    """Place in the life of a document; unknown last."""
    at = F.array_position(F.array(*map(F.lit, STATUSES)), status)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(STATUSES))).cast("int")


def view(docs: DataFrame, file_type: str | None = None, folder: str | None = "all", query: str = "") -> DataFrame:
    """Documents by type, by folder ("all", None for those in no folder, else the folder), by part of the name."""
    found = docs
    if file_type:
        found = found.where(F.col("file_type") == file_type)
    if folder != "all":
        found = found.where(F.col("folder_id").isNull() if folder is None else F.col("folder_id") == folder)
    return found.where(contains_folded(F.col("filename"), F.lit(query.strip()))) if query.strip() else found


def sort_keys(by: str, locale: str = "UNICODE") -> list[Column]:
    newest = [F.desc("created_at"), F.asc("id")]
    if by == "title":
        return [F.collate("filename", locale), F.asc("id")]
    return [status_rank(F.col("status")), *newest] if by == "status" else newest


def folder_counts(docs: DataFrame) -> DataFrame:
    """(folder_id, level, n): a row for each folder and for none (level 0), and one for all (level 1)."""
    return docs.groupingSets([["folder_id"], []], "folder_id").agg(F.grouping("folder_id").cast("int").alias("level"), F.count(F.lit(1)).alias("n"))


def folder_name_reason(name: Column) -> Column:
    s = stripped(name)
    return F.when(s == "", "blank name").when(F.length(s) > 255, "name too long")


def folder_color_reason(color: Column) -> Column:
    return F.when(~F.coalesce(color.isin(*FOLDER_COLORS), F.lit(False)), "unknown color")


def updated_folder(folders: DataFrame, user_id: str, folder_id: str, name: str | None = None, color: str | None = None) -> DataFrame:
    """Null leaves a field as it is."""
    mine = (F.col("user_id") == user_id) & (F.col("id") == folder_id)
    return folders.withColumns({"name": F.when(mine, F.coalesce(F.lit(name), "name")).otherwise(F.col("name")), "color": F.when(mine, F.coalesce(F.lit(color), "color")).otherwise(F.col("color"))})


def without_folder(folders: DataFrame, docs: DataFrame, user_id: str, folder_id: str) -> tuple[DataFrame, DataFrame]:
    """(folders, documents): the folder goes, its documents stay in none."""
    gone = (F.col("user_id") == user_id) & (F.col("id") == folder_id)
    held = (F.col("user_id") == user_id) & F.coalesce(F.col("folder_id") == folder_id, F.lit(False))
    return folders.where(~gone), docs.withColumn("folder_id", F.when(held, F.lit(None).cast("string")).otherwise(F.col("folder_id")))


def assigned(docs: DataFrame, folders: DataFrame, user_id: str, document_id: str, folder_id: str | None) -> DataFrame:
    """The document in the folder, if both are the owner's; null takes it out."""
    mine = (F.col("user_id") == user_id) & (F.col("id") == document_id)
    if folder_id is None:
        return docs.withColumn("folder_id", F.when(mine, F.lit(None).cast("string")).otherwise(F.col("folder_id")))
    owned = folders.where((F.col("user_id") == user_id) & (F.col("id") == folder_id)).select(F.col("id").alias("_folder")).limit(1)
    return docs.join(owned, mine, "left").withColumn("folder_id", F.coalesce("_folder", "folder_id")).drop("_folder")


def claimed(docs: DataFrame, user_id: str, document_id: str) -> DataFrame:
    """Compare and set: a failed document becomes uploaded again, without reason and breakdown; others stay as they are."""
    won = (F.col("user_id") == user_id) & (F.col("id") == document_id) & (F.col("status") == "Failed")
    return docs.withColumns(
        {
            "status": F.when(won, "Uploaded").otherwise(F.col("status")),
            "failed_reason": F.when(~won, F.col("failed_reason")),
            "chapter_breakdown": F.when(~won, F.col("chapter_breakdown")),
        }
    )


def deletable(status: Column) -> Column:
    return status.isin("Ready", "Failed")


def pollable(status: Column) -> Column:
    return status.isin("Uploaded", "Extracting", "Graphing")


def without_document(tables: dict[str, DataFrame], user_id: str, document_id: str) -> dict[str, DataFrame]:
    """Passages, provenance and row of a document go, in that order of writing; other owners' rows never."""
    keys = {"documents": "id"}
    return {name: df.where(~((F.col("user_id") == user_id) & (F.col(keys.get(name, "document_id")) == document_id))) for name, df in tables.items()}


#: What becomes of a request to delete: an item of others looks like one that is not there.
DELETED, NOT_FOUND, IN_WORKS = "deleted", "not_found", "in_works"
#: Order in which the tables of a document, or of an account, are written.
DOCUMENT_TABLES = ("passages", "nodes", "edges", "documents")
ACCOUNT_TABLES = ("passages", "nodes", "edges", "documents", "messages", "folders", "users")


def document_outcomes(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """(user_id, document_id, outcome) of each request (user_id, document_id); equal requests are one."""
    known = documents.select("user_id", F.col("id").cast("string").alias("document_id"), F.col("status").alias("_status"))
    asked = requests.select("user_id", F.col("document_id").cast("string").alias("document_id")).distinct()
    outcome = F.when(F.col("_status").isNull(), NOT_FOUND).when(deletable(F.col("_status")), DELETED).otherwise(IN_WORKS)
    return asked.join(known, ["user_id", "document_id"], "left").select("user_id", "document_id", outcome.alias("outcome"))


def account_outcomes(users: DataFrame, documents: DataFrame, requests: DataFrame) -> DataFrame:
    """(user_id, outcome) of each request (user_id): an account with a document in the works stays, one that is gone already is no error."""
    busy = documents.groupBy("user_id").agg(F.bool_or(pollable(F.col("status"))).alias("_busy"))
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("_known"))
    joined = requests.select("user_id").distinct().join(known, "user_id", "left").join(busy, "user_id", "left")
    outcome = F.when(F.col("_known").isNull(), NOT_FOUND).when(F.coalesce("_busy", F.lit(False)), IN_WORKS).otherwise(DELETED)
    return joined.select("user_id", outcome.alias("outcome"))


def _cascaded(tables: dict[str, DataFrame], order: tuple[str, ...], gone: DataFrame, keys: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    left = {}
    for name in order:
        if name in tables:
            renamed = gone.withColumnsRenamed(keys.get(name, {}))
            left[name] = tables[name].join(renamed, renamed.columns, "left_anti")
    return left


def delete_documents(versions: Versions, requests: DataFrame) -> DataFrame:
    """Outcomes of requests, after the passages, provenance and rows of the documents that go are gone in one change.

    Outcomes and cascade are read from one version, so what is reported is what was done; a change in
    between is a conflict, and nothing is done.
    """
    number, tables = versions.current()
    outcomes = settled(document_outcomes(tables["documents"], requests), "outcomes")
    gone = outcomes.where(F.col("outcome") == DELETED).select("user_id", "document_id")
    versions.change(_cascaded(tables, DOCUMENT_TABLES, gone, {"documents": {"document_id": "id"}}), number)
    return outcomes


def delete_accounts(versions: Versions, requests: DataFrame) -> DataFrame:
    """Outcomes of requests (user_id), after all that the accounts that go had is gone in one change."""
    number, tables = versions.current()
    outcomes = settled(account_outcomes(tables["users"], tables["documents"], requests), "outcomes")
    gone = outcomes.where(F.col("outcome") == DELETED).select("user_id")
    versions.change(_cascaded(tables, ACCOUNT_TABLES, gone, {"users": {"user_id": "id"}}), number)
    return outcomes


def account_deletable(docs: DataFrame) -> DataFrame:
    """(user_id, deletable): no document of the account is in the works."""
    return docs.groupBy("user_id").agg((~F.bool_or(pollable(F.col("status")))).alias("deletable"))


def without_account(tables: dict[str, DataFrame], user_id: str) -> dict[str, DataFrame]:
    return {name: df.where(F.col("id" if name == "users" else "user_id") != user_id) for name, df in tables.items()}


def registered(users: DataFrame, incoming: DataFrame) -> DataFrame:
    """Outcome of each registration by e-mail: conflict with a verified account, reclaim of an unverified one, or created."""
    mail = F.lower(stripped(F.col("email")))
    known = users.select(mail.alias("_mail"), F.col("email_verified_at").isNotNull().alias("_verified"))
    joined = incoming.withColumn("_mail", mail).join(known, "_mail", "left")
    return joined.withColumn("outcome", F.when(F.col("_verified"), "conflict").when(~F.col("_verified"), "reclaimed").otherwise("created")).drop("_mail", "_verified")


def current_status(events: DataFrame, key: str, order: list[str], status: str) -> DataFrame:
    """The newest status of each key: one partial aggregate a task, no sort."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count(F.lit(1)).alias("n"))


def oldest_first(folders: DataFrame) -> DataFrame:
    return folders.orderBy("created_at", "id")


def inserted(rows: DataFrame, schema: str, path: str) -> int:
    """Append rows of the declared schema to a table; the number of rows.  Columns that are missing are null, others are an error."""
    fields = [f.name for f in rows.sparkSession.createDataFrame([], schema).schema]
    if unknown := set(rows.columns) - set(fields):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    typed = rows.sparkSession.createDataFrame([], schema).unionByName(rows, allowMissingColumns=True)
    seen = Observation()  # counts what is written, as it is written
    typed.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def n_changed(rows: DataFrame, which: Column) -> int:
    """Rows that a bulk delete or update would touch, counted before it is written."""
    return rows.where(which).count()


def with_hashes(docs: DataFrame) -> DataFrame:
    """Hashes of the content where there are none yet."""
    return docs.withColumn("content_hash", F.coalesce("content_hash", content_hash(F.col("content"))))


def with_verified(users: DataFrame) -> DataFrame:
    """Accounts from before verification count as verified when they were made."""
    return users.withColumn("email_verified_at", F.coalesce("email_verified_at", "created_at"))


def updated_profile(users: DataFrame, user_id: str, verified_at: Column | None = None, **fields: str | None) -> DataFrame:
    """Null leaves a field as it is; verifying again leaves the first time."""
    mine = F.col("id") == user_id
    for name, value in fields.items():
        users = users.withColumn(name, F.when(mine, F.coalesce(F.lit(value), name)).otherwise(F.col(name)))
    return users if verified_at is None else users.withColumn("email_verified_at", F.when(mine, F.coalesce("email_verified_at", verified_at)).otherwise(F.col("email_verified_at")))


def email_reason(email: Column) -> Column:
    return F.when(F.lower(stripped(email)).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"), F.lit(None).cast("string")).otherwise("malformed e-mail")


def account_reason(full_name: Column, password: Column) -> Column:
    return F.when(stripped(full_name) == "", "blank name").when(~F.length(password).between(8, 128), "password length")


class MixedBatch(ValueError):
    """Passages of more than one document, or of more than one owner, in one write."""


def written_passages(passages: DataFrame, path: str) -> None:
    """Write the passages of one document in place of those it had below ``path``, a folder a document; a batch of more than one is refused."""
    owners = passages.select("user_id", "document_id").distinct().limit(2).collect()
    if len(owners) > 1:
        raise MixedBatch("passages of several documents or owners")
    if owners:
        passages.dropDuplicates(["chunk_id"]).write.mode("overwrite").parquet(f"{path}/user_id={owners[0]['user_id']}/document_id={owners[0]['document_id']}")


def content_of(docs: DataFrame, user_id: str, document_id: str) -> DataFrame:
    """(filename, media_type, content) of the owner's document, or no row: only these columns of one row are read."""
    mine = docs.where((F.col("user_id") == user_id) & (F.col("id") == document_id))
    return mine.select("filename", media_type(F.col("file_type")).alias("media_type"), "content").limit(1)


def documents_of(docs: DataFrame, user_id: str, by: str = "newest", file_type: str | None = None, folder: str | None = "all", query: str = "") -> DataFrame:
    """The owner's documents as the library shows them: filtered, in order, with labels, without content and hash."""
    shown = screens.public_documents(view(docs.where(F.col("user_id") == user_id), file_type, folder, query))
    labels = {"type_label": screens.type_label(F.col("file_type")), "size_label": size_label(F.col("file_size_bytes")), "date_label": screens.date_label(F.col("created_at")), "passages": screens.passage_total(F.col("chapter_breakdown"))}
    return shown.withColumns(labels).orderBy(*sort_keys(by))


def resend_reason(user: DataFrame, sent_at: Column, now: Column, wait: float = 60.0) -> DataFrame:
    """(id, reason) of accounts that ask for their verification again: verified already, or asked again too soon; null if it goes out."""
    soon = sent_at.isNotNull() & ~expired(sent_at, wait, now)
    return user.select("id", F.when(F.col("email_verified_at").isNotNull(), "verified already").when(soon, "too soon").alias("reason"))
