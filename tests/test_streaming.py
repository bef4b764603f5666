"""Streams give what the batch gives, and leave nothing behind when run again."""

from __future__ import annotations

from pyspark.sql import functions as F

from passagework.operators import chunking, limits
from passagework.streaming import ingest, limiter


def test_ingest_equals_batch_and_does_not_double(spark, sf_dir, tmp_path):
    source = str(tmp_path / "in")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(40)
    docs = docs.unionByName(spark.createDataFrame([(-1, " ")], "doc_id long, text string"))
    docs.write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    target = str(tmp_path / "out")
    for _ in range(2):
        ingest.ingest(stream, "doc_id", "text", target, str(tmp_path / "state")).awaitTermination(60)
    got = spark.read.parquet(f"{target}/passages").drop("batch")
    want = chunking.chunks(spark.read.parquet(source), "doc_id", chunking.whole_chapter(F.col("text")))
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    status = spark.read.parquet(f"{target}/status")
    last = {r.document_id: r.s for r in status.groupBy("document_id").agg(F.max_by("status", "seq").alias("s")).collect()}
    assert last[-1] == "Failed" and set(last.values()) == {"Ready", "Failed"}
    again = ingest.reindexed(spark.read.parquet(source), status, "doc_id", "text")
    assert again.count() == want.count()


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = [(k, float(t * 17 % 200), i) for i, (k, t) in enumerate((k, t) for k in range(3) for t in range(30))]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "k int, at double, i int").write.parquet(source)
    stream = spark.readStream.schema("k int, at double, i int").parquet(source + "*")
    # a timeout by processing time asks for batches without data for as long as these are allowed
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        query = limiter.limited(stream, "k", "at", 3, 60.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = sorted((r.key, r["at"], r.admitted) for r in spark.sql("select * from limited").collect())
    batch = limits.sliding_log(spark.read.parquet(source), "k", "at", "i", 3, 60.0)
    assert got == sorted((r.k, r["at"], r.admitted) for r in batch.collect())


def test_files_of_every_type(spark, tmp_path):
    """Chapters by type, vectors, and a reason for each upload that fails; others are not touched by it."""
    files = [
        ("m", "u", "a.md", b"intro\n# One\nfirst words\n", None),
        ("h", "u", "b.html", b"<body><h1>Head</h1><p>some text</p></body>", "text/html"),
        ("x", "u", "c.md", b"\xff\xfe", None),
        ("e", "v", "d.html", b"<body><!-- nothing --></body>", None),
        ("z", "v", "e.docx", b"data", None),
        ("t", "v", "f.md", b"text", "application/pdf"),
        ("p", "v", "g.pdf", b"%PDF", None),
    ]
    source = str(tmp_path / "in")
    spark.createDataFrame(files, "document_id string, user_id string, filename string, content binary, content_type string").write.parquet(source)
    schema = "document_id string, user_id string, filename string, content binary, content_type string"

    def run(name, **options):
        target = str(tmp_path / name)
        ingest.ingest_files(spark.readStream.schema(schema).parquet(source), target, f"{target}-state", **options).awaitTermination(120)
        passages, status = spark.read.parquet(f"{target}/passages"), spark.read.parquet(f"{target}/status")
        last = status.groupBy("document_id").agg(F.max_by(F.struct("status", "reason"), "seq").alias("s"))
        return {r.document_id: tuple(r.s) for r in last.collect()}, passages.orderBy("id", "chunk_index").collect()

    status, rows = run("fine", embedder=lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert [(r.id, r.user_id, r.chapter, r.text, list(r.embedding)) for r in rows] == [
        ("h", "u", rows[0].chapter, rows[0].text, [float(len(rows[0].text)), 1.0]),
        ("m", "u", "Full Document", "intro", [5.0, 1.0]),
        ("m", "u", "One", "first words", [11.0, 1.0]),
    ]
    assert rows[0].id == "h" and "some text" in rows[0].text
    read = "Could not read this document: "
    assert status == {
        "m": ("Ready", None), "h": ("Ready", None), "x": ("Failed", read + "not valid UTF-8"), "e": ("Failed", read + "no extractable text"),
        "z": ("Failed", read + "unsupported format"), "t": ("Failed", read + "content type disagrees"), "p": ("Failed", read + "no parser for pdf"),
    }

    def pages(df):
        return df.select("document_id", F.array(F.lit("page one"), F.lit("page two")).alias("pages"), F.array(F.struct(F.lit("Part").alias("title"), F.lit(1).alias("page"))).alias("outline"))

    status, rows = run("pdf", pdf_reader=pages)
    assert status["p"] == ("Ready", None) and [(r.chapter, r.text) for r in rows if r.id == "p"] == [("Full Document", "page one"), ("Part", "page two")]

    def broken(texts):
        raise RuntimeError("no vectors")

    status, rows = run("broken", embedder=broken)
    assert rows == [] and status["m"][0] == "Failed" and status["m"][1].startswith("Could not index this document's content: ") and status["x"][1] == read + "not valid UTF-8"
