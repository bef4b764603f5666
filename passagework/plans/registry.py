"""The library's operators over the driver's tables, each with its SQL where SQL can express it.

Owners, chats and graphs are read into tables that have none of their own:
an owner is a language or a label, a conversation is a thread, customers and
suppliers are organisations, parts products, nations and regions locations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import content_hash

from ..operators import answers, chunking, conversation, evaluation, graph, library, limits, retrieval, screens
from ..schemas import PASSAGE_CHARS
from ..settings import shared_folder
from ..sources import html, markdown, pdf, uploads


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _hash(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


# --- retrieval and answers --------------------------------------------------------------------------


@query(
    """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (
  SELECT query_id, vec_id, round(list_cosine_distance(q.e, p.embedding::DOUBLE[]), 6) AS distance
  FROM q JOIN embeddings p ON q.label = p.label AND p.vec_id <> q.query_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs
), top AS (SELECT * FROM ranked WHERE rank <= 8),
gate AS (SELECT query_id, CASE WHEN bool_or(distance <= 0.75) THEN 'answer' ELSE 'refusal' END AS outcome FROM top GROUP BY query_id)
SELECT q.query_id, t.vec_id, CAST(t.rank AS INTEGER) AS rank, t.distance, coalesce(g.outcome, 'no_documents') AS outcome
FROM q LEFT JOIN gate g ON q.query_id = g.query_id LEFT JOIN top t ON q.query_id = t.query_id
"""
)
def vector_topk_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    passages = vectors.select(F.col("vec_id").alias("passage_id"), "embedding", "label")
    found = retrieval.gated(queries, retrieval.nearest(queries, passages, ["label"]))
    return found.select("query_id", F.col("passage_id").alias("vec_id"), "rank", "distance", "outcome")


@query(
    """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (
  SELECT query_id, vec_id, round(list_cosine_distance(q.e, p.embedding::DOUBLE[]), 6) AS distance
  FROM q JOIN embeddings p ON q.label = p.label AND p.vec_id <> q.query_id WHERE query_id % 100 = 0 OR p.vec_id % 20 IN (query_id // 50 % 20, 3)
)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 8
"""
)
def vector_topk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other question with a scope of two documents; passages are dealt into twenty."""
    vectors = table(spark, sf_dir, "embeddings")
    mine = F.array(F.concat(F.lit("d"), (F.floor(F.col("vec_id") / 50) % 20).cast("string")), F.lit("d3"))
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label", F.when(F.col("vec_id") % 100 != 0, mine).alias("document_ids"))
    passages = vectors.select(F.col("vec_id").alias("passage_id"), "embedding", "label", F.concat(F.lit("d"), (F.col("vec_id") % 20).cast("string")).alias("document_id"))
    return retrieval.nearest(queries, passages, ["label"]).select("query_id", F.col("passage_id").alias("vec_id"), "rank", "distance")


@query(
    """
SELECT conv_id, turn, CASE WHEN trim(coalesce(text, ''), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) = '' THEN 'blank question'
  WHEN length(trim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)))) > 2000 THEN 'question too long'
  WHEN conv_id % 300 > 200 THEN 'too many documents' END AS reason,
  CASE WHEN turn NOT BETWEEN 1 AND 50 THEN 'limit out of range' END AS page_reason
FROM conversations WHERE role = 'user'
"""
)
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as questions, with a scope of conv_id % 300 documents and pages of ``turn`` rows."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    scope = F.array_repeat(F.lit("d"), (F.col("conv_id") % 300).cast("int"))
    return rows.select("conv_id", "turn", screens.request_reason(F.col("text"), scope).alias("reason"), screens.page_limit_reason(F.col("turn")).alias("page_reason"))


@query(
    """
WITH kinds AS (
  SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'user' WHEN turn % 5 = 1 THEN 'refusal' WHEN turn % 5 = 3 THEN 'notice' ELSE 'assistant' END AS kind
  FROM conversations WHERE role <> 'system'
)
SELECT conv_id, turn, kind, sha256(CASE kind WHEN 'user' THEN text WHEN 'assistant' THEN concat(text, ' ', turn) ELSE '' END) AS text_hash FROM kinds
"""
)
def message_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as shown and searched; answers have two segments, and some a reason to be empty."""
    rows = table(spark, sf_dir, "conversations").where("role <> 'system'")
    empty = F.when((F.col("role") != "user") & (F.col("turn") % 5 == 1), "refusal").when((F.col("role") != "user") & (F.col("turn") % 5 == 3), "no_answer")
    segments = F.array(F.struct(F.col("text").alias("text")), F.struct(F.col("turn").cast("string").alias("text")))
    kind = screens.message_kind(F.col("role"), empty)
    return rows.select("conv_id", "turn", kind.alias("kind"), F.sha2(screens.message_text(kind, F.col("text"), segments), 256).alias("text_hash"))


@query(
    """
WITH states AS (SELECT * FROM (VALUES (false, false), (false, true), (true, false), (true, true)) AS s(has_passages, scoped)),
segments AS (SELECT doc_id % 3 AS n_segments, quality IS NOT NULL AND quality = 1 AS passes FROM labels)
SELECT has_passages, scoped,
  CASE WHEN NOT has_passages AND scoped THEN 'empty_scope' WHEN NOT has_passages THEN 'no_documents'
       WHEN NOT passes THEN 'refusal' WHEN n_segments = 0 THEN 'no_answer' ELSE 'answered' END AS outcome,
  count(*) AS n
FROM states, segments GROUP BY 1, 2, 3
"""
)
def answer_outcome_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = F.explode(F.array(*(F.struct(F.lit(h).alias("has_passages"), F.lit(s).alias("scoped")) for h in (False, True) for s in (False, True)))).alias("s")
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 3).alias("n_segments"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("passes"), states).select("n_segments", "passes", "s.*")
    decided = answers.outcome(F.col("has_passages"), F.col("scoped"), F.col("passes"), F.col("n_segments"))
    return rows.groupBy("has_passages", "scoped", decided.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
WITH mentions AS (
  SELECT conv_id, turn, pos, (conv_id * 3 + turn * 7919 + pos * 7) % (SELECT max(doc_id) + 1 FROM documents) AS document_id, CASE WHEN pos % 2 = 0 THEN 'even' ELSE 'odd' END AS chapter, (turn + pos) % 4 AS chunk_index
  FROM conversations, (VALUES (0), (1), (2), (3), (4)) AS p(pos) WHERE role = 'assistant'
), firsts AS (
  SELECT conv_id, turn, chapter, source AS filename, chunk_index, min(pos) AS pos FROM mentions JOIN documents ON document_id = doc_id GROUP BY ALL
)
SELECT conv_id, turn, chapter, filename, min(pos) AS first_pos, string_agg(CAST(chunk_index AS VARCHAR), ',' ORDER BY pos, chunk_index) AS chunk_indexes
FROM firsts GROUP BY conv_id, turn, chapter, filename
"""
)
def citation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions spread over the ids of all documents."""
    pos = F.explode(F.sequence(F.lit(0), F.lit(4))).alias("pos")
    ids = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("_ids"))  # one row
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", pos).join(F.broadcast(ids))
    mentions = rows.select(
        "conv_id",
        "turn",
        "pos",
        ((F.col("conv_id") * 3 + F.col("turn") * 7919 + F.col("pos") * 7) % F.col("_ids")).alias("document_id"),
        F.when(F.col("pos") % 2 == 0, "even").otherwise("odd").alias("chapter"),
        ((F.col("turn") + F.col("pos")) % 4).alias("chunk_index"),
    )
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("filename"))
    merged = answers.merged_citations(mentions, documents, ["conv_id", "turn"])
    return merged.withColumn("chunk_indexes", F.array_join(F.col("chunk_indexes").cast("array<string>"), ","))


@query(
    """
WITH replies AS (
  SELECT conv_id, turn, CAST(concat('{"segments":[{"text":', to_json(text), ',"passage_numbers":',
    CASE conv_id % 4 WHEN 0 THEN '[1,2]' WHEN 1 THEN '[1,true,1.0,9,"2",-1]' WHEN 2 THEN '[]' ELSE '7' END, '},7]}') AS JSON) AS reply
  FROM conversations WHERE role = 'assistant'
), items AS (SELECT conv_id, turn, unnest(json_extract(reply, '$.segments[*]')) AS item FROM replies),
read AS (
  SELECT conv_id, turn, trim(item ->> '$.text', concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(133), chr(160))) AS text,
    list_filter(list_transform(list_filter(json_extract(item, '$.passage_numbers[*]'), lambda n: json_type(n) IN ('UBIGINT', 'BIGINT')), lambda n: CAST(n AS BIGINT)), lambda n: n BETWEEN 1 AND 3) AS numbers
  FROM items WHERE json_type(item, '$.text') = 'VARCHAR'
)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn) - 1 AS INTEGER) AS segment, text, array_to_string(numbers, ',') AS numbers
FROM read WHERE text <> '' AND len(numbers) > 0
"""
)
def answer_json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of conversation texts, sound and broken in turn."""
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    numbers = F.element_at(F.array(F.lit("[1,2]"), F.lit("[1,true,1.0,9,\"2\",-1]"), F.lit("[]"), F.lit("7")), (F.col("conv_id") % 4 + 1).cast("int"))
    reply = F.concat(F.lit('{"segments":[{"text":'), F.to_json(F.array("text")).substr(F.lit(2), F.length(F.to_json(F.array("text"))) - 2), F.lit(',"passage_numbers":'), numbers, F.lit("},7]}"))
    segments = answers.answer_segments(reply, F.lit(3))
    return rows.select("conv_id", "turn", F.posexplode(segments).alias("segment", "s")).select("conv_id", "turn", "segment", "s.text", F.array_join(F.col("s.numbers").cast("array<string>"), ",").alias("numbers"))


@query(
    """
WITH replies AS (
  SELECT c_custkey, CAST(concat('{"entities":[{"name":" ', c_name, ' ","type":"Organization"},{"name":"', c_mktsegment, '","type":"Segment"},{"name":" ","type":"Person"},3],',
    '"relationships":[{"source":"', c_name, '","target":"x","type":"WORKS_AT"},{"source":"a","target":"b","type":"KNOWS"}]}') AS JSON) AS reply
  FROM customer
), entities AS (
  SELECT c_custkey, concat(e ->> '$.type', ':', trim(e ->> '$.name')) AS e FROM (SELECT c_custkey, unnest(json_extract(reply, '$.entities[*]')) AS e FROM replies)
  WHERE trim(e ->> '$.name') <> '' AND e ->> '$.type' IN ('Person', 'Organization', 'Project', 'Product', 'Location')
), relationships AS (
  SELECT c_custkey, concat(r ->> '$.source', ':', r ->> '$.type', ':', r ->> '$.target') AS r FROM (SELECT c_custkey, unnest(json_extract(reply, '$.relationships[*]')) AS r FROM replies)
  WHERE r ->> '$.type' IN ('WORKS_AT', 'SUPPLIES', 'PART_OF', 'LOCATED_IN', 'RELATED_TO')
)
SELECT c_custkey, coalesce((SELECT string_agg(e, ',') FROM entities x WHERE x.c_custkey = c.c_custkey), '') AS entities,
  coalesce((SELECT string_agg(r, ',') FROM relationships x WHERE x.c_custkey = c.c_custkey), '') AS relationships
FROM customer c
"""
)
def extraction_json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output for each customer, with a bad entity and a bad relationship in each."""
    rows = table(spark, sf_dir, "customer")
    reply = F.concat(
        F.lit('{"entities":[{"name":" '), F.col("c_name"), F.lit(' ","type":"Organization"},{"name":"'), F.col("c_mktsegment"), F.lit('","type":"Segment"},{"name":" ","type":"Person"},3],'),
        F.lit('"relationships":[{"source":"'), F.col("c_name"), F.lit('","target":"x","type":"WORKS_AT"},{"source":"a","target":"b","type":"KNOWS"}]}'),
    )
    return rows.select(
        "c_custkey",
        F.array_join(F.transform(answers.extraction_entities(reply), lambda e: F.concat_ws(":", e["type"], e["name"])), ",").alias("entities"),
        F.array_join(F.transform(answers.extraction_relationships(reply), lambda r: F.concat_ws(":", r["source"], r["type"], r["target"])), ",").alias("relationships"),
    )


# --- library ----------------------------------------------------------------------------------------


@query(
    """
WITH hashed AS (SELECT doc_id, lang, sha256(coalesce(text, '')) AS content_hash FROM documents),
known AS (
  SELECT lang, content_hash, CASE WHEN min(quality) = 0 THEN 'Failed' ELSE 'Ready' END AS status
  FROM hashed JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang, content_hash
), firsts AS (SELECT lang, content_hash, min(doc_id) AS first FROM hashed GROUP BY lang, content_hash)
SELECT h.doc_id, h.lang, h.content_hash,
  CASE WHEN h.doc_id <> f.first THEN 'duplicate' WHEN k.status = 'Failed' THEN 'reingested' WHEN k.status IS NOT NULL THEN 'duplicate' ELSE 'created' END AS outcome
FROM hashed h JOIN firsts f USING (lang, content_hash) LEFT JOIN known k USING (lang, content_hash)
"""
)
def content_dedupe_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").alias("content"))
    labels = table(spark, sf_dir, "labels").where("quality is not null")
    hashed = docs.select("doc_id", "lang", content_hash(F.col("content")).alias("content_hash"))
    known = hashed.join(labels, "doc_id").groupBy("lang", "content_hash").agg(F.when(F.min("quality") == 0, "Failed").otherwise("Ready").alias("status"))
    return uploads.dedupe_outcome(docs, known, "lang", "doc_id").select("doc_id", "lang", "content_hash", "outcome")


@query("SELECT lang, sha256(coalesce(text, '')) AS content_hash, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", content_hash(F.col("text")).alias("content_hash"))
    return uploads.duplicate_guard(rows, "lang", "content_hash")


@query(
    """
WITH uploads AS (
  SELECT doc_id, n_chars, concat('dir/', source, CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.PDF' WHEN 2 THEN '.tar.htm' WHEN 3 THEN '.' WHEN 4 THEN '.docx' ELSE '.html' END) AS filename,
         CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Text/Plain; charset=utf-8' WHEN 2 THEN 'application/octet-stream' ELSE 'application/pdf' END AS content_type
  FROM documents
), kinds AS (
  SELECT *, CASE lower(regexp_extract(filename, '^.*[^/](\\.[^./]+)$', 1)) WHEN '.md' THEN 'markdown' WHEN '.pdf' THEN 'pdf' WHEN '.htm' THEN 'html' WHEN '.html' THEN 'html' END AS file_type,
         lower(trim(split_part(content_type, ';', 1))) AS given
  FROM uploads
)
SELECT doc_id, file_type,
  CASE WHEN file_type IS NULL THEN 'unsupported format'
       WHEN given IS NOT NULL AND given <> 'application/octet-stream'
            AND NOT (file_type = 'markdown' AND given = 'text/plain') AND NOT (file_type = 'pdf' AND given = 'application/pdf') THEN 'content type disagrees'
       WHEN n_chars <= 0 THEN 'empty file' WHEN n_chars > 20971520 THEN 'file too large' END AS reason
FROM kinds
""".replace("\\\\", "\\")
)
def format_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffixes = F.array(*map(F.lit, (".md", ".PDF", ".tar.htm", ".", ".docx", ".html")))
    types = F.array(F.lit(None).cast("string"), *map(F.lit, ("Text/Plain; charset=utf-8", "application/octet-stream", "application/pdf")))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("dir/"), "source", F.get(suffixes, (F.col("doc_id") % 6).cast("int"))).alias("filename"),
        F.get(types, (F.col("doc_id") % 4).cast("int")).alias("content_type"),
        F.col("n_chars").alias("size"),
    )
    return uploads.admission(rows).select("doc_id", "file_type", "reason")


@query(
    """
SELECT doc_id, source AS folder_id, n_chars FROM documents
WHERE lang = 'en' AND source = 'src3' AND contains(lower(text), 'the')
"""
)
def library_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("file_type"), F.col("source").alias("folder_id"), F.col("text").alias("filename"), "n_chars")
    return library.view(docs, "en", "src3", " The ").select("doc_id", "folder_id", "n_chars")


@query("SELECT source AS folder_id, CAST(grouping(source) AS INTEGER) AS level, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), ())")
def library_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.folder_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("folder_id")))


@query("SELECT user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS status, count(*) AS n FROM events GROUP BY user_id")
def status_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.current_status(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(
    """
SELECT 'documents' AS name, count(*) AS n FROM documents WHERE lang IS DISTINCT FROM 'fr'
UNION ALL SELECT 'labels', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'fr')
"""
)
def tenant_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("user_id"))
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id", "left").withColumn("user_id", F.coalesce("user_id", F.lit("")))
    left = library.without_account({"documents": docs, "labels": labels}, "fr")
    counted = [df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, df in left.items()]
    return counted[0].unionByName(counted[1])


# --- chapters and passages --------------------------------------------------------------------------

_CHUNKS_SQL = r"""
words AS (SELECT doc_id, CASE WHEN trim(text, E' \n\t\r\x0b\x0c') = '' THEN [] ELSE string_split_regex(trim(text, E' \n\t\r\x0b\x0c'), '\s+') END AS w FROM documents WHERE text IS NOT NULL),
starts AS (SELECT doc_id, w, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - 250) / 210.0) AS BIGINT)))) AS i FROM words WHERE len(w) > 0),
chunks AS (SELECT doc_id, i AS chunk_index, i = 0 AS is_chapter_start, array_to_string(w[i * 210 + 1 : i * 210 + 250], ' ') AS text FROM starts)
""".replace("E' \\n\\t\\r\\x0b\\x0c'", "concat(' ', chr(10), chr(9), chr(13), chr(11), chr(12))")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return chunking.chunks(docs, "doc_id", chunking.whole_chapter(F.col("text")))


@query(f"WITH {_CHUNKS_SQL} SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, is_chapter_start, sha256(text) AS text_hash FROM chunks")
def chunk_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select(F.col("id").alias("doc_id"), "chunk_index", "is_chapter_start", _hash("text").alias("text_hash"))


@query(
    f"""
WITH {_CHUNKS_SQL},
digests AS (SELECT doc_id, chunk_index, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || CAST(concat(doc_id, ':', chunk_index) AS BLOB)) AS d FROM chunks)
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index,
  concat(d[1:8], '-', d[9:12], '-5', d[14:16], '-', substr('89ab89ab89ab89ab', 1 + CAST(concat('0x', d[17:17]) AS INTEGER), 1), d[18:20], '-', d[21:32]) AS chunk_id
FROM digests
"""
)
def chunk_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_chunk_ids(_chunks(spark, sf_dir)).select(F.col("id").alias("doc_id"), "chunk_index", "chunk_id")


@query(f"WITH {_CHUNKS_SQL} SELECT doc_id, 'Full Document' AS chapter, count(*) AS passages, CAST(min(chunk_index) AS INTEGER) AS first_pos FROM chunks GROUP BY doc_id")
def chapter_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.breakdown(_chunks(spark, sf_dir)).withColumnRenamed("id", "doc_id")


@query(
    f"""
WITH {_CHUNKS_SQL},
pieces AS (SELECT doc_id, chunk_index, CASE WHEN is_chapter_start THEN text ELSE array_to_string(string_split(text, ' ')[41:], ' ') END AS piece FROM chunks),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces),
texts AS (
  SELECT doc_id, string_agg(substr(piece, 1, CAST(12000 - before AS BIGINT)), concat(chr(10), chr(10)) ORDER BY chunk_index) AS t
  FROM placed WHERE before < 12000 AND piece <> '' GROUP BY doc_id
)
SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, sha256(t) AS text_hash FROM texts
"""
)
def extraction_text_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = chunking.extraction_text(_chunks(spark, sf_dir))
    return texts.select(F.col("id").alias("doc_id"), F.length("text").alias("n_chars"), _hash("text").alias("text_hash"))


@query(
    f"""
WITH {_CHUNKS_SQL},
sized AS (SELECT doc_id, chunk_index + 1 AS rank, length(concat('Passage ', chunk_index + 1, ' (Chapter: Full Document): ', text, chr(10))) AS n FROM chunks),
summed AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY rank) AS total FROM sized)
SELECT doc_id, CAST(rank AS INTEGER) AS rank FROM summed WHERE total <= 12000 OR rank = 1
"""
)
def passage_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _chunks(spark, sf_dir).withColumn("rank", F.col("chunk_index") + 1)
    return chunking.within_budget(ranked, "id", "rank", "chapter", "text", PASSAGE_CHARS).select(F.col("id").alias("doc_id"), "rank")


@query()
def markdown_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set as Markdown: each line that starts a paragraph of its own becomes a heading."""
    docs = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("Lead in.\n\n## "), F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n# "), F.lit("\n```\n# no heading\n```\n"))
    found = docs.select("doc_id", F.posexplode(markdown.chapters(text)).alias("chapter_no", "c"))
    return found.select("doc_id", "chapter_no", F.col("c.title").alias("chapter"), F.length("c.body").alias("n_chars"))


@query()
def html_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.chapters(table(spark, sf_dir, "pages"), "page_id", "html")
    return found.select(F.col("id").alias("page_id"), "chapter_no", "chapter", _hash("text").alias("text_hash"))


_APART = "\ufdd0"  # a noncharacter


def _unmarked(c):
    return F.replace(c, F.lit(_APART), F.lit(" "))


@query(
    r"""
WITH given AS (SELECT doc_id, text, regexp_replace(text, ' ', '   ', 'g') AS wide FROM documents WHERE text IS NOT NULL),
apart AS (
  SELECT doc_id, regexp_replace(regexp_replace(wide, '(\S)(\S)', '\1 \2', 'g'), '(\S)(\S)', '\1 \2', 'g') AS page,
    regexp_replace(regexp_replace(regexp_replace(text, '(\S)(\S)', '\1 \2', 'g'), '(\S)(\S)', '\1 \2', 'g'), '(\S) (\s)', '\1\2', 'g') AS spaced
  FROM given
), tokens AS (
  SELECT *, list_filter(string_split_regex(page, '\s+'), lambda t: t <> '') AS pw, list_filter(string_split_regex(spaced, '\s+'), lambda t: t <> '') AS sw FROM apart
), shares AS (
  SELECT *, len(pw) >= 20 AND len(list_filter(pw, lambda t: length(t) = 1)) >= 0.8 * len(pw) AS set_apart,
    CASE WHEN len(sw) > 0 THEN CAST(len(list_filter(sw, lambda t: length(t) = 1)) AS DOUBLE) / len(sw) END AS share
  FROM tokens
)
SELECT doc_id, share, CASE WHEN NOT set_apart THEN page ELSE array_to_string(list_transform(string_split(page, chr(10)), lambda l:
    CASE WHEN trim(l) = '' THEN l ELSE array_to_string(list_filter(list_transform(string_split_regex(trim(l), '\s{2,}'), lambda w: regexp_replace(w, '\s+', '', 'g')), lambda w: w <> ''), ' ') END), chr(10)) END AS repaired
FROM shares
"""
)
def glyph_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents with each glyph set apart, line by line, repaired; and the share of their single-glyph words."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    # a mark that no text holds stands for the spaces that are put in, so that one pass serves both forms
    marked = F.regexp_replace("text", r"(\S)(?=\S)", f"$1{_APART}")
    given = docs.select("doc_id", marked.alias("marked")).select("doc_id", _unmarked(F.replace("marked", F.lit(" "), F.lit("   "))).alias("apart"), _unmarked(F.regexp_replace("marked", r"(\S) (?=\s)", "$1")).alias("spaced"))
    return given.select("doc_id", pdf.repaired_texts(F.col("apart")).alias("repaired"), pdf.share_of_texts(F.col("spaced")).alias("share"))


# --- conversations ----------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS recency FROM conversations) WHERE recency <= 6")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.recent_rows(table(spark, sf_dir, "conversations"), "conv_id", ["turn"]).select("conv_id", "turn", "role", "recency")


_PAIRS_SQL = """
ahead AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (SELECT conv_id, turn, text AS question, next_text AS answer FROM ahead WHERE role = 'user' AND next_role = 'assistant')
"""


@query(f"WITH {_PAIRS_SQL} SELECT conv_id, turn, sha256(question) AS question, sha256(answer) AS answer FROM pairs")
def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = conversation.turn_pairs(table(spark, sf_dir, "conversations"), "conv_id", ["turn"])
    return pairs.select("conv_id", "turn", _hash("question").alias("question"), _hash("answer").alias("answer"))


@query(
    f"""
WITH {_PAIRS_SQL},
newest AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n, length(concat('Q: ', question, chr(10), 'A: ', answer, chr(10))) AS size FROM pairs),
wide AS (SELECT conv_id, max(CASE WHEN n = 1 THEN size END) AS s1, max(CASE WHEN n = 2 THEN size END) AS s2, max(CASE WHEN n = 3 THEN size END) AS s3 FROM newest WHERE n <= 3 GROUP BY conv_id),
one AS (SELECT *, s1 <= 600 AS k1 FROM wide),
two AS (SELECT *, CASE WHEN k1 THEN s1 ELSE 0 END + s2 <= 600 AS k2 FROM one),
three AS (SELECT *, CASE WHEN k1 THEN s1 ELSE 0 END + CASE WHEN k2 THEN s2 ELSE 0 END + s3 <= 600 AS k3 FROM two)
SELECT conv_id, turn, CASE n WHEN 1 THEN k1 WHEN 2 THEN k2 ELSE k3 END AS kept FROM newest JOIN three USING (conv_id) WHERE n <= 3
"""
)
def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With 600 characters, so that pairs are skipped."""
    pairs = conversation.turn_pairs(table(spark, sf_dir, "conversations"), "conv_id", ["turn"])
    return conversation.history_window(pairs, "conv_id", "turn", budget=600).select("conv_id", "turn", "kept")


@query(
    """
WITH ranked AS (SELECT turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS role_rank, conv_id FROM conversations),
page AS (
  SELECT * FROM ranked WHERE turn < 3 OR (turn = 3 AND role_rank < 1) OR (turn = 3 AND role_rank = 1 AND conv_id < 50)
  ORDER BY turn DESC, role_rank DESC, conv_id DESC LIMIT 21
)
SELECT turn, role_rank, conv_id, (SELECT count(*) > 20 FROM page) AS has_more FROM (SELECT * FROM page ORDER BY turn DESC, role_rank DESC, conv_id DESC LIMIT 20)
"""
)
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("turn", conversation.role_rank(F.col("role")).alias("role_rank"), "conv_id")
    return conversation.page_before(rows, ["turn", "role_rank", "conv_id"], (3, 1, 50))


@query(
    """
WITH hits AS (SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant') AND contains(lower(text), 'the'))
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS ordinal, count(*) OVER (PARTITION BY conv_id) AS "of" FROM hits
"""
)
def message_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.search(table(spark, sf_dir, "conversations"), "conv_id", ["turn"], " The ")


# --- graph ------------------------------------------------------------------------------------------

_GRAPH_SQL = """
links AS (
  SELECT 'Organization' AS src_type, c_name AS src_name, 'LOCATED_IN' AS rel_type, 'Location' AS dst_type, n_name AS dst_name FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION SELECT 'Organization', s_name, 'LOCATED_IN', 'Location', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION SELECT 'Location', n_name, 'PART_OF', 'Location', r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT 'Organization', s_name, 'SUPPLIES', 'Product', p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
),
nodes AS (
  SELECT 'Organization' AS type, c_name AS name FROM customer UNION SELECT 'Organization', s_name FROM supplier
  UNION SELECT 'Product', p_name FROM part UNION SELECT 'Location', n_name FROM nation UNION SELECT 'Location', r_name FROM region
),
ends AS (SELECT src_type AS type, src_name AS name FROM links UNION ALL SELECT dst_type, dst_name FROM links WHERE NOT (src_type = dst_type AND src_name = dst_name)),
degrees AS (SELECT type, name, count(*) AS degree FROM ends GROUP BY type, name),
ranked AS (SELECT n.type, n.name, coalesce(d.degree, 0) AS degree FROM nodes n LEFT JOIN degrees d ON n.type = d.type AND n.name = d.name),
top AS (SELECT * FROM ranked ORDER BY degree DESC, name, type LIMIT 150)
"""


def trade_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with provenance; the document of a row is the key of what it was read from."""
    t = {n: table(spark, sf_dir, n) for n in ("customer", "supplier", "part", "nation", "region", "lineitem")}

    def nodes(name: str, type_: str, column: str, key: str) -> DataFrame:
        return t[name].select(F.lit("u").alias("user_id"), F.lit(type_).alias("type"), F.col(column).alias("name"), F.concat(F.lit(name), F.col(key).cast("string")).alias("document_id"))

    def edges(df: DataFrame, src: tuple[str, str], rel: str, dst: tuple[str, str], document) -> DataFrame:
        return df.select(
            F.lit("u").alias("user_id"), F.lit(src[0]).alias("src_type"), F.col(src[1]).alias("src_name"), F.lit(rel).alias("rel_type"), F.lit(dst[0]).alias("dst_type"), F.col(dst[1]).alias("dst_name"), document.alias("document_id")
        )

    every = [nodes("customer", "Organization", "c_name", "c_custkey"), nodes("supplier", "Organization", "s_name", "s_suppkey"), nodes("part", "Product", "p_name", "p_partkey"), nodes("nation", "Location", "n_name", "n_nationkey"), nodes("region", "Location", "r_name", "r_regionkey")]
    supplied = t["lineitem"].select("l_suppkey", "l_partkey", "l_orderkey").join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    links = [
        edges(t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")), ("Organization", "c_name"), "LOCATED_IN", ("Location", "n_name"), F.concat(F.lit("customer"), F.col("c_custkey").cast("string"))),
        edges(t["supplier"].join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")), ("Organization", "s_name"), "LOCATED_IN", ("Location", "n_name"), F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string"))),
        edges(t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")), ("Location", "n_name"), "PART_OF", ("Location", "r_name"), F.concat(F.lit("nation"), F.col("n_nationkey").cast("string"))),
        edges(supplied, ("Organization", "s_name"), "SUPPLIES", ("Product", "p_name"), F.concat(F.lit("order"), F.col("l_orderkey").cast("string"))),
    ]
    all_nodes, all_edges = every[0], links[0]
    for df in every[1:]:
        all_nodes = all_nodes.unionByName(df)
    for df in links[1:]:
        all_edges = all_edges.unionByName(df)
    return all_nodes, all_edges


@query(f"WITH {_GRAPH_SQL} SELECT type, name, degree, (SELECT count(*) FROM nodes) AS total FROM top")
def graph_nodes_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    total = nodes.select(*graph.NODE).distinct().agg(F.count(F.lit(1)).alias("total"))  # one row
    return graph.top_nodes(nodes, edges).select("type", "name", "degree").join(F.broadcast(total))


_INDUCED_SQL = """
inside AS (
  SELECT l.* FROM links l JOIN top a ON a.type = l.src_type AND a.name = l.src_name JOIN top b ON b.type = l.dst_type AND b.name = l.dst_name
),
drawn AS (SELECT * FROM inside ORDER BY src_name, dst_name, rel_type, src_type, dst_type LIMIT 1000)
"""


@query(f"WITH {_GRAPH_SQL}, {_INDUCED_SQL} SELECT src_name, src_type, rel_type, dst_name, dst_type FROM drawn")
def graph_edges_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    return graph.induced_edges(edges, graph.top_nodes(nodes, edges)).select("src_name", "src_type", "rel_type", "dst_name", "dst_type")


@query(
    f"""
WITH {_GRAPH_SQL}, {_INDUCED_SQL}
SELECT src_name, rel_type, dst_name FROM drawn
WHERE (contains(lower(src_name), 'sup') OR contains(lower(dst_name), 'sup') OR contains(lower(replace(rel_type, '_', ' ')), 'sup')) AND (src_type = 'Location' OR dst_type = 'Location')
"""
)
def graph_view_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    drawn = graph.induced_edges(edges, graph.top_nodes(nodes, edges))
    return graph.visible_edges(drawn, " Sup ", "Location").select("src_name", "rel_type", "dst_name")


@query(
    f"""
WITH {_GRAPH_SQL}, {_INDUCED_SQL},
sided AS (SELECT *, concat(src_type, ':', src_name) AS source, concat(dst_type, ':', dst_name) AS target FROM drawn),
placed AS (
  SELECT *, count(*) OVER w AS n, row_number() OVER (w ORDER BY src_name, dst_name, rel_type, src_type, dst_type) - 1 AS i FROM sided
  WINDOW w AS (PARTITION BY least(source, target), greatest(source, target))
)
SELECT source, target, rel_type, round(CASE WHEN n < 2 THEN 0.0 WHEN source <= target THEN (i - (n - 1) / 2.0) * 0.22 ELSE -(i - (n - 1) / 2.0) * 0.22 END, 6)::DOUBLE AS curvature FROM placed
"""
)
def graph_edges_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    drawn = graph.induced_edges(edges, graph.top_nodes(nodes, edges))
    ends = {"source": screens.node_id(F.col("src_type"), F.col("src_name")), "target": screens.node_id(F.col("dst_type"), F.col("dst_name"))}
    curved = screens.curved_edges(drawn.withColumns(ends), "src_name", "dst_name", "rel_type", "src_type", "dst_type")
    return curved.select("source", "target", "rel_type", F.round("curvature", 6).alias("curvature"))


@query(
    f"""
WITH {_GRAPH_SQL}
SELECT type, name, CAST(dense_rank() OVER (ORDER BY type) AS INTEGER) AS "group", CAST(row_number() OVER (PARTITION BY type ORDER BY degree DESC, name) AS INTEGER) AS place FROM top
"""
)
def graph_nodes_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_graph(spark, sf_dir)
    ranked = graph.top_nodes(nodes, edges).withColumn("rank", F.struct((-F.col("degree")).alias("d"), F.col("name").alias("n")))
    return screens.grouped_nodes(ranked, "rank").select("type", "name", "group", "place")


_MENTIONS_SQL = """
mentions AS (
  SELECT DISTINCT 'Organization' AS type, c_name AS name, o_orderkey AS document_id, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey
)
"""


@query(f"WITH {_MENTIONS_SQL} SELECT type, name, count(DISTINCT document_id) AS n_documents, min(document_id) AS first_document FROM mentions GROUP BY type, name")
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders are written first, then all of them again: what was there does not double."""
    rows = _mentions(spark, sf_dir)
    merged = graph.upsert(rows.where("o_orderstatus = 'O'"), rows, graph.NODE)
    return merged.groupBy("type", "name").agg(F.count(F.lit(1)).alias("n_documents"), F.min("document_id").alias("first_document"))


@query(f"WITH {_MENTIONS_SQL} SELECT type, name, count(DISTINCT document_id) AS n_documents FROM mentions WHERE o_orderstatus <> 'F' GROUP BY type, name")
def graph_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders are pruned; customers who have no other order are gone."""
    rows = _mentions(spark, sf_dir)
    left = graph.prune(rows.select(*graph.NODE, "document_id").distinct(), rows.where("o_orderstatus = 'F'"))
    return left.groupBy("type", "name").agg(F.count(F.lit(1)).alias("n_documents"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.lit("u").alias("user_id"), F.lit("Organization").alias("type"), F.col("c_name").alias("name"), F.col("o_orderkey").alias("document_id"), "o_orderstatus")


# --- limits, evaluation, isolation -------------------------------------------------------------------

DAY = 86_400.0


@query(
    """
WITH RECURSIVE numbered AS (
  SELECT user_id, event_id, epoch(ts) AS secs, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), walk AS (
  SELECT user_id, event_id, n, true AS admitted, [secs] AS stamps FROM numbered WHERE n = 1
  UNION ALL
  SELECT m.user_id, m.event_id, m.n, len(list_filter(w.stamps, lambda x: x > m.secs - 86400)) < 3,
    CASE WHEN len(list_filter(w.stamps, lambda x: x > m.secs - 86400)) < 3 THEN list_append(list_filter(w.stamps, lambda x: x > m.secs - 86400), m.secs) ELSE list_filter(w.stamps, lambda x: x > m.secs - 86400) END
  FROM walk w JOIN numbered m ON m.user_id = w.user_id AND m.n = w.n + 1
)
SELECT user_id, event_id, admitted FROM walk
"""
)
def rate_limiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    attempts = table(spark, sf_dir, "events").select("user_id", "event_id", seconds.alias("at"))
    return limits.sliding_log(attempts, "user_id", "at", "event_id", 3, DAY).select("user_id", "event_id", "admitted")


@query(
    """
WITH steps AS (
  SELECT user_id, epoch(ts) AS secs, 1 AS d FROM events UNION ALL SELECT user_id, epoch(ts) + (event_id % 7 + 1) * 36000.0, -1 FROM events
), net AS (SELECT user_id, secs, sum(d) AS d FROM steps GROUP BY user_id, secs),
running AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY secs) AS open FROM net)
SELECT user_id, CAST(max(open) AS BIGINT) AS peak FROM running GROUP BY user_id
"""
)
def in_flight_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    spans = table(spark, sf_dir, "events").select("user_id", at.alias("start"), (at + (F.col("event_id") % 7 + 1) * 36000.0).alias("end"))
    return limits.in_flight(spans, "user_id", "start", "end")


@query(
    """
WITH asked AS (
  SELECT CASE WHEN quality = 1 THEN 'factual' ELSE 'unanswerable' END AS category,
         CASE doc_id % 4 WHEN 0 THEN 'refusal' WHEN 1 THEN 'no_answer' ELSE 'answered' END AS outcome, doc_id % 11 = 0 AS failed, contains(lower(text), 'the') AS hit
  FROM labels JOIN documents USING (doc_id)
), counted AS (
  SELECT count(*) FILTER (category = 'factual' AND NOT failed) AS answerable,
         count(*) FILTER (category = 'factual' AND NOT failed AND outcome = 'answered' AND hit) AS correct,
         count(*) FILTER (category = 'factual' AND NOT failed AND outcome = 'refusal') AS over_refused,
         count(*) FILTER (category <> 'factual' AND NOT failed) AS unanswerable,
         count(*) FILTER (category <> 'factual' AND NOT failed AND outcome = 'refusal') AS refused,
         count(*) FILTER (category <> 'factual' AND NOT failed AND outcome = 'answered') AS violations,
         count(*) FILTER (failed) AS errors
  FROM asked
)
SELECT *, CASE WHEN answerable = 0 THEN 'n/a' ELSE printf('%.1f%%', 100.0 * correct / answerable) END AS accuracy,
  CASE WHEN unanswerable = 0 THEN 'n/a' ELSE printf('%.1f%%', 100.0 * refused / unanswerable) END AS refusal_rate,
  CASE WHEN answerable = 0 THEN 'n/a' ELSE printf('%.1f%%', 100.0 * over_refused / answerable) END AS over_refusal_rate
FROM counted
"""
)
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    results = rows.select(
        F.when(F.col("quality") == 1, "factual").otherwise("unanswerable").alias("category"),
        F.when(F.col("doc_id") % 4 == 0, "refusal").when(F.col("doc_id") % 4 == 1, "no_answer").otherwise("answered").alias("outcome"),
        "text",
        F.array(F.lit("The")).alias("must_contain"),
        F.lit("all").alias("match"),
        (F.col("doc_id") % 11 == 0).alias("failed"),
    )
    return evaluation.metrics(evaluation.classified(results))


@query(
    """
WITH leaks AS (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(DISTINCT lang) > 1)
SELECT (SELECT count(*) FROM leaks) AS leaks, (SELECT count(DISTINCT lang) FROM documents) AS tenants,
  CASE WHEN (SELECT count(*) FROM leaks) > 0 THEN 'fail' WHEN (SELECT count(DISTINCT lang) FROM documents) = 0 THEN 'inconclusive' ELSE 'pass' END AS verdict
"""
)
def isolation_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaks = evaluation.leaks(docs, "lang", "doc_id").agg(F.count(F.lit(1)).alias("leaks"))  # one row, as is the next
    tenants = docs.agg(F.count_distinct("lang").alias("tenants"))
    return leaks.join(F.broadcast(tenants)).withColumn("verdict", evaluation.verdict(F.col("leaks"), F.col("tenants")))


@query(f"WITH {_CHUNKS_SQL} SELECT doc_id, count(*) AS passages FROM chunks GROUP BY doc_id")
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the streaming ingest, until none is left; counts of what it wrote."""
    import uuid

    from ..streaming.ingest import ingest

    target = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    path = f"{sf_dir}/documents.parquet"
    # a pattern reads a single file and a folder of files alike
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    ingest(stream.where("text is not null"), "doc_id", "text", target, f"{target}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{target}/passages").groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("passages"))


# --- streams with state -------------------------------------------------------------------------------

ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def streamed(spark: SparkSession, rows: DataFrame, make, **conf: str) -> DataFrame:
    """``rows``, written to the shared folder, as a stream through ``make`` until none is left; what came out."""
    import uuid

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        out = make(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
        out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(SQL["rate_limiter"])
def rate_limiter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sliding log as state of a stream."""
    from ..streaming import admission

    attempts = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    found = streamed(spark, attempts, lambda s: admission.sliding_log(s, "user_id", "ts", "event_id", 3, DAY))
    return found.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "admitted")


@query(
    """
WITH RECURSIVE numbered AS (
  SELECT user_id, event_id, epoch(ts) AS s, epoch(ts) + (event_id % 7 + 1) * 36000.0 AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events
), walk AS (
  SELECT user_id, event_id, n, true AS admitted, [e] AS open FROM numbered WHERE n = 1
  UNION ALL
  SELECT m.user_id, m.event_id, m.n, len(list_filter(w.open, lambda x: x > m.s)) < 2,
    CASE WHEN len(list_filter(w.open, lambda x: x > m.s)) < 2 THEN list_append(list_filter(w.open, lambda x: x > m.s), m.e) ELSE list_filter(w.open, lambda x: x > m.s) END
  FROM walk w JOIN numbered m ON m.user_id = w.user_id AND m.n = w.n + 1
)
SELECT user_id, event_id, admitted FROM walk
"""
)
def slots_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two slots a user, taken and freed by events of a stream."""
    from ..streaming import admission

    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    ends = F.explode(F.array(F.struct(F.lit("start").alias("kind"), at.alias("at")), F.struct(F.lit("end").alias("kind"), (at + (F.col("event_id") % 7 + 1) * 36000.0).alias("at")))).alias("e")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", ends).select("user_id", "event_id", "e.kind", "e.at")
    found = streamed(spark, rows, lambda s: admission.gauge(s, "user_id", "event_id", "kind", "at", most=2))
    return found.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "admitted")


@query(
    """
WITH RECURSIVE moves AS (SELECT * FROM (VALUES (NULL, 'Uploaded'), ('Uploaded', 'Extracting'), ('Uploaded', 'Failed'), ('Extracting', 'Graphing'), ('Extracting', 'Failed'),
  ('Graphing', 'Ready'), ('Graphing', 'Failed'), ('Failed', 'Uploaded')) AS m(a, b)),
given AS (
  SELECT CAST(user_id % 20 AS VARCHAR) || '-' || CAST(event_id // 40 AS VARCHAR) AS document_id, CAST(value AS BIGINT) // 4 AS round, event_id % 4 AS seq,
    CASE event_type WHEN 'signup' THEN 'Uploaded' WHEN 'view' THEN 'Extracting' WHEN 'click' THEN 'Graphing' WHEN 'purchase' THEN 'Ready' ELSE 'Failed' END AS status
  FROM events
), numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY round, seq, status) AS n FROM given),
walk AS (
  SELECT document_id, round, seq, status, n, CASE WHEN status = 'Uploaded' THEN 'accepted' ELSE 'illegal' END AS verdict, CASE WHEN status = 'Uploaded' THEN status END AS current,
    CASE WHEN status = 'Uploaded' THEN round ELSE -1000000 END AS r, CASE WHEN status = 'Uploaded' THEN seq ELSE 0 END AS s
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT document_id, round, seq, status, n, verdict, CASE verdict WHEN 'accepted' THEN status ELSE current END, CASE verdict WHEN 'accepted' THEN round ELSE r END, CASE verdict WHEN 'accepted' THEN seq ELSE s END
  FROM (
    SELECT m.*, w.current, w.r, w.s, CASE WHEN (m.round, m.seq) <= (w.r, w.s) THEN CASE WHEN m.round = w.r AND m.seq = w.s AND m.status = w.current THEN 'repeated' ELSE 'late' END
      WHEN EXISTS (SELECT 1 FROM moves WHERE a IS NOT DISTINCT FROM w.current AND b = m.status) THEN 'accepted' ELSE 'illegal' END AS verdict
    FROM walk w JOIN numbered m ON m.document_id = w.document_id AND m.n = w.n + 1
  )
)
SELECT document_id, round, CAST(seq AS INTEGER) AS seq, status, verdict, current FROM walk
"""
)
def status_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status events of documents, in and out of order, repeated and illegal, through the state machine."""
    from ..streaming import status

    kinds = F.create_map(*map(F.lit, ("signup", "Uploaded", "view", "Extracting", "click", "Graphing", "purchase", "Ready", "error", "Failed")))
    rows = table(spark, sf_dir, "events").select(
        F.concat((F.col("user_id") % 20).cast("string"), F.lit("-"), F.floor(F.col("event_id") / 40).cast("string")).alias("document_id"),
        F.floor(F.round("value").cast("long") / 4).alias("round"),
        (F.col("event_id") % 4).cast("int").alias("seq"),
        F.element_at(kinds, F.col("event_type")).alias("status"),
        F.lit(None).cast("string").alias("reason"),
    )
    return streamed(spark, rows, status.lives).select("document_id", "round", "seq", "status", "verdict", "current")


# --- ingestion to a library ---------------------------------------------------------------------------


class RecordedProvider:
    """Replies that a text decides: an entity of its first and one of its last characters, and how they relate; some calls fail."""

    def __call__(self, prompt: str, text: str, seconds: float):
        import json

        from .provider import Reply

        if len(text) % 7 == 0:
            return Reply(500)
        if len(text) % 7 == 1:
            return Reply(401)
        if len(text) % 7 == 2:
            return Reply(200, "no object")
        first, last = text[:12], text[-12:]
        entities = [{"name": first, "type": "Person"}, {"name": last, "type": "Organization"}, {"name": "x", "type": "Planet"}]
        return Reply(200, json.dumps({"entities": entities, "relationships": [{"source": first.strip(), "target": last.strip(), "type": "WORKS_AT"}, {"source": first.strip(), "target": "nobody", "type": "SUPPLIES"}]}))


class RecordedEmbedder:
    """Vectors of lengths; calls with a text of certain lengths fail."""

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if any(len(t) % 101 == 0 for t in texts):
            raise OSError("no vectors")
        return [[float(len(t)), 1.0] for t in texts]


class RecordedStore:
    """A graph outside that takes no document whose number 13 divides."""

    def prune(self, document_id: str, user_id: str) -> None:
        pass

    def write(self, document_id: str, user_id: str, entities: list, relationships: list) -> None:
        if int(document_id.split("-")[-1]) % 13 == 0:
            raise ConnectionError("closed")


def _library(spark: SparkSession, sf_dir: str, name: str, uploads_: DataFrame) -> DataFrame:
    """Uploads through the ingest; what each document came to, and what of it is seen."""
    import uuid

    from ..streaming import library_ingest as ingest
    from ..streaming.publication import outcomes

    target = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    uploads_.write.parquet(f"{target}/in")
    stream = spark.readStream.schema(uploads_.schema).parquet(f"{target}/in")
    how = {"embedder": RecordedEmbedder(), "store": RecordedStore(), "attempts": 2, "sleep": _no_wait}
    ingest.ingest_library(stream, target, f"{target}/state", RecordedProvider(), **how).awaitTermination()
    passages = ingest.passages(spark, target).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_passages"))
    nodes = ingest.nodes(spark, target).groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "type", "name"))), "|").alias("nodes"))
    edges = ingest.edges(spark, target).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_edges"))
    ends = outcomes(spark, target).select("document_id", "user_id", "stage", "message", "chapter_breakdown")
    found = ends.join(passages, "document_id", "left").join(nodes, "document_id", "left").join(edges, "document_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_passages", "n_edges")}
    chapters = F.array_join(F.transform("chapter_breakdown", lambda c: F.concat_ws("=", c["chapter"], c["passages"].cast("string"))), "|")
    return found.withColumns({**zero, "nodes_hash": F.sha2(F.coalesce("nodes", F.lit("")), 256), "chapters": chapters}).select("document_id", "user_id", "stage", "message", "n_passages", "n_edges", "nodes_hash", "chapters")


def _no_wait(seconds: float) -> None:
    """Recorded providers ask for no patience."""


_TRIM = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(133), chr(160))"


@query(
    f"""
WITH uploads AS (
  SELECT doc_id, lang, replace(coalesce(text, ''), '#', '') AS text, CASE doc_id % 5 WHEN 2 THEN 'docx' WHEN 1 THEN 'html' WHEN 4 THEN 'html' ELSE 'md' END AS kind,
    CASE WHEN doc_id % 15 = 4 THEN 'text/plain' END AS content_type FROM documents
), judged AS (
  SELECT *, CASE WHEN kind = 'docx' THEN 'unsupported format' WHEN content_type IS NOT NULL THEN 'content type disagrees' WHEN kind = 'md' AND text = '' THEN 'empty file' END AS refusal FROM uploads
),
{_CHUNKS_SQL.replace("FROM documents WHERE text IS NOT NULL", "FROM judged WHERE refusal IS NULL")},
pieces AS (SELECT doc_id, chunk_index, text, CASE WHEN is_chapter_start THEN text ELSE array_to_string(string_split(text, ' ')[41:], ' ') END AS piece FROM chunks),
placed AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces),
texts AS (
  SELECT doc_id, count(*) AS n, bool_or(length(text) % 101 = 0) AS no_vectors,
    string_agg(substr(piece, 1, CAST(12000 - before AS BIGINT)), concat(chr(10), chr(10)) ORDER BY chunk_index) FILTER (before < 12000 AND piece <> '') AS t FROM placed GROUP BY doc_id
), ends AS (SELECT *, length(t) AS l, trim(substr(t, 1, 12), {_TRIM}) AS first, trim(substr(t, greatest(1, length(t) - 11)), {_TRIM}) AS last FROM texts),
staged AS (
  SELECT j.doc_id, j.lang, e.*, CASE WHEN refusal IS NOT NULL THEN refusal WHEN n IS NULL THEN 'no extractable text' END AS parsing,
    CASE l % 7 WHEN 0 THEN 'status 500' WHEN 1 THEN 'status 401' WHEN 2 THEN 'malformed reply' END AS extraction
  FROM judged j LEFT JOIN ends e ON j.doc_id = e.doc_id
), decided AS (
  SELECT *, CASE WHEN parsing IS NOT NULL THEN 'parsing' WHEN no_vectors THEN 'indexing' WHEN extraction IS NOT NULL THEN 'extraction' WHEN doc_id % 13 = 0 THEN 'graph_write' END AS stage FROM staged
)
SELECT CAST(doc_id AS VARCHAR) AS document_id, lang AS user_id, stage,
  CASE stage WHEN 'parsing' THEN parsing WHEN 'indexing' THEN 'OSError: no vectors' WHEN 'extraction' THEN extraction WHEN 'graph_write' THEN 'ConnectionError: closed' END AS message,
  CASE WHEN stage IS NULL THEN n ELSE 0 END AS n_passages, CASE WHEN stage IS NULL AND first <> last AND first <> '' AND last <> '' THEN 1 ELSE 0 END::BIGINT AS n_edges,
  sha256(CASE WHEN stage IS NOT NULL THEN '' ELSE concat_ws('|', CASE WHEN last <> '' THEN concat('Organization:', last) END, CASE WHEN first <> '' THEN concat('Person:', first) END) END) AS nodes_hash,
  CASE WHEN stage IS NULL THEN concat('Full Document=', n) END AS chapters
FROM decided
"""
)
def ingest_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as uploads of three types, without the sign of Markdown headings; providers of every stage fail some."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("#"), F.lit(""))
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    kind = F.element_at(F.array(*map(F.lit, ("md", "html", "docx", "md", "html"))), (F.col("doc_id") % 5 + 1).cast("int"))
    content = F.when(kind == "html", F.concat(F.lit("<html><body><p>"), safe, F.lit("</p></body></html>"))).otherwise(text)
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.col("lang").alias("user_id"),
        F.concat_ws(".", F.lit("file"), kind).alias("filename"),
        content.cast("binary").alias("content"),
        F.when(F.col("doc_id") % 15 == 4, "text/plain").alias("content_type"),
    )
    return _library(spark, sf_dir, "library", files)


@query()
def ingest_graph_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw web pages as uploads of HTML; a page's host is its owner."""
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("document_id"),
        F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit("")).alias("user_id"),
        F.lit("page.html").alias("filename"),
        F.col("html").cast("binary").alias("content"),
    )
    return _library(spark, sf_dir, "library-pages", pages)


# --- an index of vectors ------------------------------------------------------------------------------


def _indexed(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    import uuid

    from ..operators import vector_index

    vectors = table(spark, sf_dir, "embeddings")
    passages = vectors.select(F.col("vec_id").alias("passage_id"), "embedding", "label")
    index = vector_index.build(passages, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    found = vector_index.search(index, queries, how.pop("scope"), **how)
    return found.select("query_id", F.col("passage_id").alias("vec_id"), "rank", "distance")


@query()
def vector_index_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight nearest vectors of every fiftieth, from the lists that a question probes."""
    return _indexed(spark, sf_dir, scope=[])


@query(
    """
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 50 = 0),
pairs AS (SELECT query_id, vec_id, round(list_cosine_distance(q.e, p.embedding::DOUBLE[]), 6) AS distance FROM q JOIN embeddings p ON p.vec_id <> q.query_id)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 8
"""
)
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, going on to all lists that may hold a nearer vector."""
    return _indexed(spark, sf_dir, scope=[], probes=4, exact=True)


# --- asking -------------------------------------------------------------------------------------------

_SCOPED_SQL = """
q AS (
  SELECT vec_id AS query_id, embedding::DOUBLE[] AS e, label, CASE vec_id // 50 % 4 WHEN 0 THEN 'all' WHEN 3 THEN 'none' ELSE 'list' END AS kind FROM embeddings WHERE vec_id % 50 = 0
), lists AS (
  SELECT DISTINCT query_id, concat('d', CASE WHEN query_id // 50 % 4 = 1 THEN query_id // 50 % 7 + 40 * i ELSE i END) AS document_id FROM q, range(400) AS r(i) WHERE kind = 'list' AND (query_id // 50 % 4 = 2 OR i < 3)
), p AS (SELECT vec_id, embedding::DOUBLE[] AS e, label, concat('d', vec_id % 400) AS document_id FROM embeddings),
pairs AS (
  SELECT query_id, vec_id, document_id, round(list_cosine_distance(q.e, p.e), 6) + 0.0 AS distance FROM q JOIN p ON q.label = p.label
  WHERE kind = 'all' OR (kind = 'list' AND EXISTS (SELECT 1 FROM lists l WHERE l.query_id = q.query_id AND l.document_id = p.document_id))
), top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM pairs) WHERE rank <= 8)
"""


def _scoped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, lists, passages): a quarter of the questions over all documents, one over three, one over four hundred, one over none."""
    vectors = table(spark, sf_dir, "embeddings")
    turn = F.floor(F.col("vec_id") / 50)
    kind = F.when(turn % 4 == 0, "all").when(turn % 4 == 3, "none").otherwise("list")
    questions = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").cast("string").alias("label"), kind.alias("scope_kind"))
    few, many = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.floor(F.col("query_id") / 50) % 7 + 40 * i), F.sequence(F.lit(0).cast("long"), F.lit(399).cast("long"))
    numbers = F.explode(F.when(F.floor(F.col("query_id") / 50) % 4 == 1, few).otherwise(many)).alias("n")
    lists = questions.where("scope_kind = 'list'").select("query_id", numbers).select("query_id", F.concat(F.lit("d"), F.col("n").cast("string")).alias("document_id"))
    passages = vectors.select(F.col("vec_id").alias("passage_id"), "embedding", F.col("label").cast("string").alias("label"), F.concat(F.lit("d"), (F.col("vec_id") % 400).cast("string")).alias("document_id"))
    return questions, lists, passages


@query(f"WITH {_SCOPED_SQL} SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, distance FROM top")
def vector_topk_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest passages in scopes of every kind and of any length."""
    from ..operators import scopes

    questions, lists, passages = _scoped(spark, sf_dir)
    return scopes.nearest_in_scope(questions, lists, passages, ["label"]).select("query_id", F.col("passage_id").alias("vec_id"), "rank", "distance")


class RecordedAnswers:
    """Two segments, of which the second cites the first two passages, the later one first; some questions fail or have no answer."""

    def __call__(self, prompt: str, question: str, seconds: float):
        import json

        from .provider import Reply

        n = int(question.split()[1])
        if n % 250 == 0:
            return Reply(503)
        segments = [] if n % 350 == 0 else [{"text": f"{prompt.count('Passage ')} passages", "passage_numbers": [1]}, {"text": " second ", "passage_numbers": [2, 1, 99, "1"]}, {"text": " ", "passage_numbers": [1]}]
        return Reply(200, json.dumps({"segments": segments}))


@query(
    f"""
WITH {_SCOPED_SQL},
gate AS (SELECT query_id, count(*) AS n, bool_or(distance <= 0.75) AS passes FROM top GROUP BY query_id),
ends AS (
  SELECT q.query_id, label, CASE WHEN n IS NULL AND kind <> 'all' THEN 'empty_scope' WHEN n IS NULL THEN 'no_documents' WHEN NOT passes THEN 'refusal' WHEN q.query_id % 250 = 0 THEN 'unavailable'
    WHEN q.query_id % 350 = 0 THEN 'no_answer' ELSE 'answered' END AS outcome, n FROM q LEFT JOIN gate g ON q.query_id = g.query_id
), cited AS (
  SELECT query_id, rank, concat('c', vec_id % 3) AS chapter, concat('f', vec_id % 400, '.md') AS filename, vec_id % 5 AS i FROM top WHERE rank <= 2
), first AS (SELECT query_id, concat(chapter, ' ', filename, ' ', i) AS c FROM cited WHERE rank = 1),
firsts AS (SELECT query_id, chapter, filename, i, min(2 - rank) AS pos FROM cited GROUP BY ALL),
merged AS (SELECT query_id, chapter, filename, min(pos) AS pos, string_agg(CAST(i AS VARCHAR), '+' ORDER BY pos, i) AS ids FROM firsts GROUP BY query_id, chapter, filename),
second AS (SELECT query_id, string_agg(concat(chapter, ' ', filename, ' ', ids), ', ' ORDER BY pos, chapter, filename) AS c FROM merged GROUP BY query_id),
kept AS (SELECT * FROM ends WHERE outcome <> 'unavailable')
SELECT CAST(label AS VARCHAR) AS user_id, 'user' AS role, concat('question ', query_id) AS question, CAST(NULL AS VARCHAR) AS answer, CAST(NULL AS VARCHAR) AS empty_reason FROM kept
UNION ALL SELECT CAST(label AS VARCHAR), 'assistant', NULL, CASE WHEN outcome = 'answered' THEN concat(n, ' passages [', f.c, '] | second [', s.c, ']') ELSE '' END, CASE WHEN outcome <> 'answered' THEN outcome END
FROM kept k LEFT JOIN first f ON f.query_id = k.query_id LEFT JOIN second s ON s.query_id = k.query_id
"""
)
def ask_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of questions in scopes of every kind, asked of a recorded provider; the turns that are kept of it."""
    import uuid

    from ..schemas import CHAT_MESSAGES
    from . import chat

    questions, lists, passages = _scoped(spark, sf_dir)
    questions = questions.withColumn("question", F.concat(F.lit(" question "), F.col("query_id").cast("string"), F.lit("\u2003")))
    more = {"chapter": F.concat(F.lit("c"), (F.col("passage_id") % 3).cast("string")), "chunk_index": (F.col("passage_id") % 5).cast("int"), "text": F.concat(F.lit("text "), F.col("passage_id").cast("string"))}
    documents = passages.select("document_id", F.concat(F.lit("f"), F.substring("document_id", 2, 9), F.lit(".md")).alias("filename")).distinct()
    folder = f"{shared_folder(spark)}/chat-{uuid.uuid4().hex}"
    chat.asked(questions, folder, passages.withColumns(more), documents, RecordedAnswers(), ["label"], F.lit("2026-01-01 00:00:00").cast("timestamp"), lists=lists, sleep=_no_wait)
    rows = spark.read.schema(CHAT_MESSAGES).parquet(folder)

    def cited(s):
        each = F.transform(s["citations"], lambda c: F.concat_ws(" ", c["chapter"], c["document_filename"], F.array_join(c["chunk_indexes"].cast("array<string>"), "+")))
        return F.concat(s["text"], F.lit(" ["), F.array_join(each, ", "), F.lit("]"))

    return rows.select("user_id", "role", "question", F.array_join(F.transform("segments", cited), " | ").alias("answer"), "empty_reason")


# --- rebuilds and deletions ---------------------------------------------------------------------------


@query(
    f"""
WITH {_CHUNKS_SQL.replace("FROM documents WHERE text IS NOT NULL", "FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 3").replace("trim(text,", "trim(replace(text, '#', ''),")},
made AS (SELECT doc_id, count(*) AS n, bool_or(length(text) % 101 = 0) AS no_vectors FROM chunks GROUP BY doc_id)
SELECT CAST(d.doc_id AS VARCHAR) AS document_id, CASE WHEN n IS NULL THEN 'parsing' WHEN no_vectors THEN 'indexing' END AS stage,
  CASE WHEN n IS NULL THEN 'no extractable text' WHEN no_vectors THEN 'OSError: no vectors' END AS message, CASE WHEN n IS NULL OR no_vectors THEN 0 ELSE n END AS n_passages
FROM documents d LEFT JOIN made m ON d.doc_id = m.doc_id WHERE d.doc_id % 7 <> 3
"""
)
def rebuild_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all Ready documents, rebuilt in a run that breaks off in its third round and in one that goes on."""
    import uuid

    from . import rebuild

    text = F.replace(F.coalesce("text", F.lit("")), F.lit("#"), F.lit(""))
    documents = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("lang").alias("user_id"), F.lit("a.md").alias("filename"), F.lit("markdown").alias("file_type"),
        F.when(F.col("doc_id") % 7 == 3, "Failed").otherwise("Ready").alias("status"), text.cast("binary").alias("content"),
    )
    root = f"{shared_folder(spark)}/rebuild-{uuid.uuid4().hex}"
    step = rebuild.reindex_step(RecordedEmbedder())

    def broken(attempt, rows):
        if attempt.batch == 2:
            raise ConnectionError("the run breaks off")
        return step(attempt, rows)

    try:
        rebuild.rebuilt(documents, root, "first", broken, rounds=4)
    except ConnectionError:
        pass
    ledger = rebuild.rebuilt(documents, root, "first", step, rounds=4)
    counts = rebuild.rows(spark, root, "passages").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_passages"))
    return ledger.join(counts, "document_id", "left").withColumn("n_passages", F.coalesce("n_passages", F.lit(0)))


_DELETE_SQL = """
documents_ AS (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(lang, '') AS user_id, CASE doc_id % 5 WHEN 0 THEN 'Uploaded' WHEN 1 THEN 'Extracting' WHEN 2 THEN 'Failed' ELSE 'Ready' END AS status FROM documents),
requests AS (SELECT DISTINCT CASE WHEN doc_id % 9 = 0 THEN 'xx' ELSE coalesce(lang, '') END AS user_id, CAST(doc_id + CASE WHEN doc_id % 8 = 1 THEN 1000000000 ELSE 0 END AS VARCHAR) AS document_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 8 = 1),
outcomes AS (
  SELECT r.user_id, document_id, CASE WHEN status IS NULL THEN 'not_found' WHEN status IN ('Ready', 'Failed') THEN 'deleted' ELSE 'in_works' END AS outcome
  FROM requests r LEFT JOIN documents_ d ON d.user_id = r.user_id AND d.id = r.document_id
)
"""


@query(
    f"""
WITH {_DELETE_SQL},
gone AS (SELECT user_id, document_id FROM outcomes WHERE outcome = 'deleted')
SELECT o.user_id, document_id, outcome, (SELECT count(*) FROM documents_ d WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = d.user_id AND g.document_id = d.id)) AS documents_left,
  (SELECT count(*) FROM labels l JOIN documents_ d ON CAST(l.doc_id AS VARCHAR) = d.id WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.user_id = d.user_id AND g.document_id = d.id)) AS passages_left
FROM outcomes o
"""
)
def document_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to delete documents, of which some are others', some are not there and some are in the works; what is left."""
    import uuid

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("user_id"))
    status = F.element_at(F.array(*map(F.lit, ("Uploaded", "Extracting", "Failed", "Ready", "Ready"))), (F.col("doc_id") % 5 + 1).cast("int"))
    owned = docs.select(F.col("doc_id").cast("string").alias("id"), "user_id", status.alias("status"))
    passages = table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("doc_id").cast("string").alias("document_id"), "user_id")
    there = library.Versions(spark, f"{shared_folder(spark)}/library-{uuid.uuid4().hex}")
    there.change({"documents": owned, "passages": passages}, 0)
    far = F.when(F.col("doc_id") % 8 == 1, 1_000_000_000).otherwise(0)
    requests = docs.where("doc_id % 3 = 0 or doc_id % 8 = 1").select(F.when(F.col("doc_id") % 9 == 0, "xx").otherwise(F.col("user_id")).alias("user_id"), (F.col("doc_id") + far).cast("string").alias("document_id"))
    found = library.delete_documents(there, requests)
    left = there.current()[1]
    counts = left["documents"].agg(F.count(F.lit(1)).alias("documents_left")).join(F.broadcast(left["passages"].agg(F.count(F.lit(1)).alias("passages_left"))))  # one row each
    return found.join(F.broadcast(counts))


@query(
    """
WITH users AS (SELECT DISTINCT user_id FROM events), documents_ AS (SELECT user_id, arg_max(event_type, struct_pack(ts := ts, event_id := event_id)) AS status FROM events GROUP BY user_id, event_id % 2),
busy AS (SELECT user_id, bool_or(status IN ('view', 'click', 'signup')) AS b FROM documents_ GROUP BY user_id),
requests AS (SELECT DISTINCT user_id * 2 AS user_id FROM events),
outcomes AS (SELECT r.user_id, CASE WHEN u.user_id IS NULL THEN 'not_found' WHEN b THEN 'in_works' ELSE 'deleted' END AS outcome FROM requests r LEFT JOIN users u ON u.user_id = r.user_id LEFT JOIN busy b ON b.user_id = r.user_id)
SELECT CAST(user_id AS VARCHAR) AS user_id, outcome, (SELECT count(*) FROM users u WHERE u.user_id NOT IN (SELECT user_id FROM outcomes WHERE outcome = 'deleted')) AS users_left FROM outcomes
"""
)
def account_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to delete accounts; an account's documents are in the states of its last events."""
    import uuid

    events = table(spark, sf_dir, "events")
    last = library.current_status(events.withColumn("half", F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 2).cast("string"))), "half", ["ts", "event_id"], "event_type")
    kinds = F.create_map(*map(F.lit, ("view", "Uploaded", "click", "Extracting", "signup", "Graphing", "purchase", "Ready", "error", "Failed")))
    documents = last.select(F.col("half").alias("id"), F.split_part("half", F.lit("-"), F.lit(1)).alias("user_id"), F.element_at(kinds, F.col("status")).alias("status"))
    there = library.Versions(spark, f"{shared_folder(spark)}/accounts-{uuid.uuid4().hex}")
    there.change({"users": events.select(F.col("user_id").cast("string").alias("id")).distinct(), "documents": documents}, 0)
    found = library.delete_accounts(there, events.select((F.col("user_id") * 2).cast("string").alias("user_id")))
    left = there.current()[1]["users"].agg(F.count(F.lit(1)).alias("users_left"))  # one row
    return found.join(F.broadcast(left))
