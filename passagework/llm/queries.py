"""The registered ``opN_*`` queries: thin digests of the operators' own outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixing, topk, warc
from .common import table
from .decontamination import contaminated_words, n_hit
from .packing import pack
from .pii import KINDS, counted, listed, personal_data
from .quality import quality_rules
from .resampling import resampled
from .simhash import near_duplicates
from .spelling import spelling_variants
from .suffixes import without_repeats
from .token_counts import token_counts
from .toxicity import third, toxicity


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.capture_index(warc.captures_of(table(spark, sf_dir, "pages")))
    return index.select(
        F.col("id").alias("page_id"),
        F.col("n_bytes").alias("payload_bytes"),
        F.col("sha1").alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.col("refers").alias("refers_to"),
    )


SQL_WARC = """
WITH bodies AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
newest AS (SELECT digest, max(page_id) AS response FROM bodies WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, b.digest AS payload_digest,
  CASE WHEN response <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN response <> page_id THEN response END AS refers_to
FROM bodies b LEFT JOIN newest w ON b.digest = w.digest AND n >= 1000
"""


#: Where the installed package of public tokenizer files keeps them; nothing is copied.
def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), F.col("sequence").alias("sequence_id"), "offset")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the third of ids that is held out are never read by the fit."""
    labels = table(spark, sf_dir, "labels").where(third("doc_id") != 1)
    scored = toxicity(table(spark, sf_dir, "documents"), labels, carry=["doc_id"])
    held_out = F.coalesce(third("doc_id") == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "offending")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select(
        "doc_id",
        *(counted("base", k).alias(f"n_{k}") for k in KINDS),
        F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes that go by the 400-byte rule; ``n_passages`` also counts repeated passages of over 50 words, which stay."""
    cut = without_repeats(table(spark, sf_dir, "documents"), with_bytes=False)
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", F.size("passages").cast("long").alias("n_passages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted_rows = token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return counted_rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.rounded_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    found = topk.top_k(rows, rows.where(F.col("id") % 50 == 0))
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


SQL_TOPK = """
WITH given AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM given q JOIN given c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = n_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL_DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
placed AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS t FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows))),
met AS (SELECT doc_id, k, i, item_id FROM placed JOIN windows USING (k, t)),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""

#: CRC-32 of the texts ``f`` of a relation ``given``: a byte of each text in every round.
_CRC_SQL = """
crc_bits(k, v, r) AS (SELECT k, k, 0 FROM range(256) AS t(k) UNION ALL SELECT k, xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), r + 1 FROM crc_bits WHERE r < 8),
crc_bytes AS (SELECT k, v FROM crc_bits WHERE r = 8),
crc_steps(f, h, i, state) AS (
  SELECT f, hex(f), 0, CAST(4294967295 AS BIGINT) FROM given
  UNION ALL SELECT f, h, i + 1, xor(state >> 8, v) FROM crc_steps JOIN crc_bytes ON k = xor(state & 255, CAST(concat('0x', substr(h, 2 * i + 1, 2)) AS BIGINT)) WHERE 2 * i < length(h)
),
crcs AS (SELECT f, xor(state, 4294967295) AS crc FROM crc_steps WHERE 2 * i = length(h))
"""


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


SQL_RESAMPLING = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
corpus AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS f FROM docs),
target AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS f FROM (SELECT {_WORDS_SQL} AS w FROM benchmark)),
given AS (SELECT f FROM corpus UNION SELECT f FROM target), {_CRC_SQL},
buckets AS (SELECT f, crc % 10000 AS b FROM crcs),
s AS (SELECT b, count(*) AS n FROM corpus JOIN buckets USING (f) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM target JOIN buckets USING (f) GROUP BY b),
gains AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM range(10000) AS r(b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)
),
sums AS (SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM corpus JOIN buckets USING (f) JOIN gains USING (b) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', sha256(concat('7:', doc_id))[1:8]) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM docs LEFT JOIN sums USING (doc_id)
),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM ranked) * 25 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


SQL_SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT concat(doc_id, ':', r) AS f, r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL
), given AS (SELECT f FROM runs), {_CRC_SQL},
results AS (SELECT CASE WHEN crc % 97 = 0 THEN concat(substr(r, 1, crc % length(r)), substr(r, crc % length(r) + 2)) ELSE r END AS word, n FROM runs JOIN crcs USING (f)),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
without AS (SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM without a JOIN without b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM words a JOIN without b ON a.word = b.v UNION SELECT b.word, a.word FROM words a JOIN without b ON a.word = b.v
),
best AS (SELECT a AS word, count(*) AS n_near, max(n) AS most, arg_min(b, struct_pack(m := -n, w := encode(b))) AS near FROM pairs JOIN words ON b = word GROUP BY a),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * w.n THEN near END AS form, CASE WHEN most >= 2 * w.n THEN most END AS form_n FROM words w LEFT JOIN best USING (word)
),
up(word, place, depth) AS (SELECT word, form, 1 FROM forms WHERE form IS NOT NULL UNION ALL SELECT up.word, form, depth + 1 FROM up JOIN forms ON place = forms.word WHERE form IS NOT NULL),
roots AS (SELECT word, arg_max(place, depth) AS root FROM up GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN roots USING (word)
"""


QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_toxicity": op4_toxicity,
    "op5_simhash": op5_simhash,
    "op6_pii": op6_pii,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_topk": op9_topk,
    "op10_quality_rules": op10_quality_rules,
    "op11_decontamination": op11_decontamination,
    "op12_resampling": op12_resampling,
    "op13_spelling": op13_spelling,
}

ORACLES = {
    "op1_warc": SQL_WARC,
    "op3_mixing": mixing.SQL,
    "op9_topk": SQL_TOPK,
    "op11_decontamination": SQL_DECONTAMINATION,
    "op12_resampling": SQL_RESAMPLING,
    "op13_spelling": SQL_SPELLING,
}
