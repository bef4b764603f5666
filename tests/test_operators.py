"""Library operators on small exact tables."""

from __future__ import annotations

import json
import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from passagework.operators import answers, chunking, conversation, evaluation, graph, library, limits, retrieval, screens
from passagework.plans import answer, provider
from passagework.tenancy import TenantScope, filters_on


def test_windows_cover_all_words_without_a_tail_of_overlap(spark):
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in (0, 1, 249, 250, 251, 460, 461, 1000)]
    made = chunking.chunks(spark.createDataFrame(rows, "id int, t string"), "id", chunking.whole_chapter(F.col("t")))
    got = {}
    for r in made.orderBy("id", "chunk_index").collect():
        got.setdefault(r.id, []).append(r.text.split(" "))
    for n, _ in rows:
        want, at = [], 0
        while n and (not want or at + 40 < n):
            want.append([f"w{i}" for i in range(at, min(at + 250, n))])
            at += 210
        assert got.get(n, []) == want


def chapters(*parts):
    return F.array(*(F.struct(F.lit(t).alias("title"), F.lit(b).alias("body")) for t, b in parts))


def test_extraction_text_drops_overlap_once_a_chapter(spark):
    body = " ".join(f"w{i}" for i in range(300))
    df = spark.range(1).select("id")
    made = chunking.chunks(df, "id", chapters(("A", body), ("A", body)))
    rows = made.orderBy("chunk_index").collect()
    assert [r.is_chapter_start for r in rows] == [True, False, True, False]
    text = chunking.extraction_text(made).first().text
    assert text.split("\n\n")[1] == " ".join(f"w{i}" for i in range(250, 300))
    assert chunking.extraction_text(made, budget=10).first().text == body[:10]
    assert [tuple(r) for r in chunking.breakdown_arrays(made).first().chapter_breakdown] == [("A", 4)]


def test_passage_budget_stops_and_keeps_the_first(spark):
    rows = [("q", 1, "c", "x" * 50), ("q", 2, "c", "y" * 500), ("q", 3, "c", "z"), ("r", 1, "c", "x" * 900)]
    df = spark.createDataFrame(rows, "q string, rank int, chapter string, text string")
    assert sorted((r.q, r["rank"]) for r in chunking.within_budget(df, "q", "rank", "chapter", "text", 200).collect()) == [("q", 1), ("r", 1)]


def test_gate_is_inclusive_and_no_filter(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, 10, 0.75, 1), (1, 11, 0.9, 2), (2, 12, None, 1)], "query_id int, passage_id int, distance double, rank int")
    got = sorted((r.query_id, r.passage_id or 0, r.outcome) for r in retrieval.gated(queries, hits).collect())
    assert got == [(1, 10, "answer"), (1, 11, "answer"), (2, 12, "refusal"), (3, 0, "no_documents")]


def test_answer_validation(spark):
    reply = json.dumps({"segments": [{"text": " a ", "passage_numbers": [1, True, 1.0, 9, "2", -1, 1]}, {"text": " ", "passage_numbers": [1]}, {"text": "b", "passage_numbers": "1"}, {"text": "c", "passage_numbers": [9]}, 5, {"text": 3, "passage_numbers": [1]}, {"text": "d", "passage_numbers": [2]}]})
    df = spark.createDataFrame([(reply,), ("not json",), ('{"segments": 4}',), (None,)], "j string").select(answers.answer_segments(F.col("j"), F.lit(3)).alias("s"))
    got = [[(x.text, list(x.numbers)) for x in r.s or []] for r in df.collect()]
    assert got == [[("a", [1, 1]), ("d", [2])], [], [], []]


def test_extraction_validation(spark):
    reply = json.dumps({"entities": [{"name": " Ann ", "type": "Person"}, {"name": "", "type": "Person"}, {"name": "X", "type": "Alien"}, {"type": "Person"}, 3], "relationships": [{"source": "Ann", "target": "B", "type": "WORKS_AT"}, {"source": " ", "target": "B", "type": "WORKS_AT"}, {"source": "A", "target": "B", "type": "LIKES"}]})
    df = spark.createDataFrame([(reply,)], "j string").select(answers.extraction_entities(F.col("j")).alias("e"), answers.extraction_relationships(F.col("j")).alias("r"))
    row = df.first()
    assert [tuple(x) for x in row.e] == [("Ann", "Person")] and [tuple(x) for x in row.r] == [("Ann", "B", "WORKS_AT")]


def test_citations_merge_in_order_of_mention(spark):
    mentions = spark.createDataFrame([(0, 0, "d1", "B", 4), (0, 1, "d1", "A", 2), (0, 2, "d1", "B", 1), (0, 3, "d1", "B", 4), (0, 4, "other", "A", 9), (1, 0, "d1", "B", 4)], "seg int, pos int, document_id string, chapter string, chunk_index int")
    documents = spark.createDataFrame([("d1", "f.md")], "document_id string, filename string")
    rows = answers.merged_citations(mentions, documents, ["seg"]).orderBy("seg", "first_pos").collect()
    assert [(r.seg, r.chapter, list(r.chunk_indexes)) for r in rows] == [(0, "B", [4, 1]), (0, "A", [2]), (1, "B", [4])]


def test_whole_answers(spark):
    passages = spark.createDataFrame([(1, "d1", "C", 0, "the sky is blue", [1.0, 0.0], "u"), (2, "d1", "C", 1, "grass is green", [0.9, 0.1], "u"), (3, "d2", "C", 0, "secret", [1.0, 0.0], "v")], "passage_id int, document_id string, chapter string, chunk_index int, text string, embedding array<float>, user_id string")
    documents = spark.createDataFrame([("d1", "f.md")], "document_id string, filename string")
    asked = spark.createDataFrame([(1, "sky?", [1.0, 0.0], "u"), (2, "far?", [-1.0, 0.0], "u"), (3, "none?", [1.0, 0.0], "w"), (4, "fail?", [1.0, 0.0], "u"), (5, "mute?", [1.0, 0.0], "u")], "query_id int, question string, embedding array<float>, user_id string")

    def call(prompt, question, seconds):
        assert "secret" not in prompt and "Passage 1 (Chapter: C)" in prompt
        assert ("Q: before\nA: then" in prompt) == (question == "sky?")
        reply = {"sky?": '{"segments":[{"text":"blue","passage_numbers":[1,2]}]}', "mute?": '{"segments":[]}'}.get(question)
        return provider.Reply(200, reply) if reply else provider.Reply(400)

    more = [(6, " ", [1.0, 0.0], "u"), (7, "x" * 2001, [1.0, 0.0], "u")]
    asked = asked.unionByName(spark.createDataFrame(more, asked.schema)).withColumn("document_ids", F.when(F.col("query_id") == 3, F.array(F.lit("d1"))))
    history = F.when(F.col("query_id") == 1, F.array(F.struct(F.lit("before").alias("question"), F.lit("then").alias("answer")))).otherwise(F.array().cast(answer.TURN))
    rows = {r.query_id: r for r in answer.answered(asked.withColumn("history", history), passages, documents, call, ["user_id"]).collect()}
    assert {k: r.outcome for k, r in rows.items()} == {1: "answered", 2: "refusal", 3: "empty_scope", 4: "unavailable", 5: "no_answer", 6: "invalid", 7: "invalid"}
    citation = rows[1].segments[0].citations[0]
    assert (citation.filename, list(citation.chunk_indexes)) == ("f.md", [0, 1])


def test_document_scope_and_history(spark):
    passages = spark.createDataFrame([(i, f"d{i % 3}", [1.0, i / 100], "u") for i in range(30)], "passage_id int, document_id string, embedding array<float>, user_id string")
    asked = spark.createDataFrame([(1, [1.0, 0.0], "u", ["d1"]), (2, [1.0, 0.0], "u", []), (3, [1.0, 0.0], "u", None), (4, [1.0, 0.0], "u", ["d9"])], "query_id int, embedding array<float>, user_id string, document_ids array<string>")
    rows = retrieval.nearest(asked, passages, ["user_id"], k=4, exclude_self=False).collect()
    got = {q: [r.passage_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2, 3, 4)}
    assert got == {1: [1, 4, 7, 10], 2: [0, 1, 2, 3], 3: [0, 1, 2, 3], 4: []}
    messages = [("u", t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(10)] + [("v", 0, "user", "alone")]
    questions = spark.createDataFrame([(1, "now?", "u"), (2, "new?", "v")], "query_id int, question string, user_id string")
    found = {r.query_id: [tuple(t) for t in r.history] for r in answer.with_history(questions, spark.createDataFrame(messages, "user_id string, t int, role string, text string"), "user_id", ["t"]).collect()}
    assert found == {1: [("m4", "m5"), ("m6", "m7"), ("m8", "m9")], 2: []}
    vectors = answer.embedded(questions, "question", lambda texts: [[float(len(t))] for t in texts]).collect()
    assert all(list(r.embedding) == [float(len(r.question))] for r in vectors)


def test_attempts_and_waiting():
    good = '{"segments": []}'

    def run(replies, attempts=3):
        waits, made = [], iter(replies)

        def call(prompt, text, seconds):
            x = next(made)
            if isinstance(x, Exception):
                raise x
            return x

        return *provider.attempted(call, "p", "t", attempts, 45.0, provider.is_object_with("segments"), waits.append), waits

    R = provider.Reply
    assert run([R(200, good)]) == (good, 1, None, [])
    assert run([R(500), TimeoutError("slow"), R(200, good)]) == (good, 3, None, [3.0, 6.0])
    assert run([R(429, None, 7.5), R(429), R(200, good)]) == (good, 3, None, [7.5, 6.0])
    assert run([R(429, None, 99.0), R(200, good)]) == (good, 2, None, [30.0])
    assert run([R(401)]) == (None, 1, "status 401", [])
    assert run([R(200, "no json"), R(200, '{"segments": 3}'), R(200, "[]")]) == (None, 3, "malformed reply", [3.0, 6.0])
    assert run([R(503), R(503)], 2) == (None, 2, "status 503", [3.0])


def test_screens(spark):
    rows = [("user", None, "q?", None), ("assistant", "refusal", None, None), ("assistant", "no_answer", None, None), ("assistant", None, None, [("a",), (None,), ("b",)])]
    df = spark.createDataFrame(rows, "role string, empty_reason string, question string, segments array<struct<text:string>>")
    kind = screens.message_kind(F.col("role"), F.col("empty_reason"))
    got = [tuple(r) for r in df.select(kind, screens.message_text(kind, F.col("question"), F.col("segments"))).collect()]
    assert got == [("user", "q?"), ("refusal", ""), ("notice", ""), ("assistant", "a  b")]
    one = spark.range(1)
    ids = F.array(F.lit("a"), F.lit("b"))
    row = one.select(screens.toggled(ids, F.lit("a")), screens.toggled(ids, F.lit("c")), screens.retained(ids, F.array(F.lit("b"), F.lit("z"))), screens.node_id(F.lit("Person"), F.lit("Ann")), screens.type_label(F.lit("pdf")), screens.type_label(F.lit("odd")), screens.date_label(F.lit("2026-08-10").cast("timestamp")), screens.date_label(F.lit(None).cast("timestamp"))).first()
    assert list(map(lambda x: list(x) if isinstance(x, list) else x, row)) == [["b"], ["a", "b", "c"], ["b"], "Person:Ann", "PDF", "odd", "Aug 10, 2026", "—"]
    limits_ = one.select(*(screens.page_limit_reason(F.lit(n)) for n in (0, 1, 50, 51))).first()
    assert list(limits_) == ["limit out of range", None, None, "limit out of range"]
    edges = spark.createDataFrame([("a", "b", 0), ("b", "a", 1), ("a", "b", 2), ("a", "c", 3)], "source string, target string, i int")
    assert [(r.i, round(r.curvature, 2)) for r in screens.curved_edges(edges, "i").orderBy("i").collect()] == [(0, -0.22), (1, 0.0), (2, 0.22), (3, 0.0)]
    nodes = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], "id string, name string")
    assert {(r.source_name, r.target_name) for r in screens.named_edges(edges.drop("i"), nodes).collect()} == {("Ann", "Bob"), ("Bob", "Ann"), ("Ann", "c")}


def test_library_writes(spark, tmp_path):
    schema = "id string, user_id string, name string, color string, created_at timestamp"
    path = str(tmp_path / "folders")
    assert library.inserted(spark.createDataFrame([("1", "u", "A")], "id string, user_id string, name string"), schema, path) == 1
    library.inserted(spark.createDataFrame([("2", "u", "B")], "id string, user_id string, name string"), schema, path)
    table = spark.read.parquet(path)
    assert table.count() == 2 and table.columns == ["id", "user_id", "name", "color", "created_at"]
    assert library.n_changed(table, F.col("name") == "A") == 1
    with pytest.raises(ValueError):
        library.inserted(spark.range(1).toDF("other"), schema, path)
    users = spark.createDataFrame([("u", "x", None, "2024-01-01"), ("v", "y", "2025-01-01", "2024-01-01")], "id string, theme string, v string, c string").select("id", "theme", F.col("v").cast("timestamp").alias("email_verified_at"), F.col("c").cast("timestamp").alias("created_at"))
    done = library.updated_profile(users, "v", F.lit("2026-01-01").cast("timestamp"), theme="dark")
    assert {(r.id, r.theme, str(r.email_verified_at)[:4]) for r in done.collect()} == {("u", "x", "None"), ("v", "dark", "2025")}
    assert {str(r.email_verified_at)[:4] for r in library.with_verified(users).collect()} == {"2024", "2025"}
    assert [tuple(r) for r in spark.createDataFrame([(" ", "12345678"), ("A", "short"), ("A", "12345678")], "n string, p string").select(library.account_reason(F.col("n"), F.col("p"))).collect()] == [("blank name",), ("password length",), (None,)]


def test_concurrent_slots_against_a_loop(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(3), i, float(s := rnd.randrange(60)), float(s + rnd.randrange(1, 40))) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, i int, s double, e double")
    got = {r.i: r.admitted for r in limits.concurrent(df, "k", "s", "e", "i", 5).collect()}
    want, live = {}, {}
    for k, i, s, e in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        open_now = [x for x in live.get(k, []) if x > s]
        want[i] = len(open_now) < 5
        live[k] = open_now + [e] * want[i]
    assert got == want and False in want.values()
    peaks = {r.k: r.peak for r in limits.in_flight(df, "k", "s", "e", window=7.0).collect()}
    assert peaks == {k: max(sum(1 for kk, _, s, e in rows if kk == k and s <= t < e) for t in range(100)) for k in range(3)}


def pairs_of(rows):
    out, i = [], 0
    while i + 1 < len(rows):
        if rows[i][1] == "user" and rows[i + 1][1] == "assistant":
            out.append(rows[i][0])
            i += 2
        else:
            i += 1
    return out


def test_turn_pairs_skip_malformed_rows(spark):
    rnd = random.Random(2)
    rows = {k: [(t, rnd.choice(["user", "assistant", "system"])) for t in range(rnd.randint(0, 12))] for k in range(120)}
    df = spark.createDataFrame([(k, t, r, f"{r}{t}") for k, v in rows.items() for t, r in v], "k int, t int, role string, text string")
    got = {}
    for r in conversation.turn_pairs(df, "k", ["t"]).orderBy("k", "t").collect():
        got.setdefault(r.k, []).append(r.t)
    assert got == {k: p for k, v in rows.items() if (p := pairs_of(v))}


def test_history_skips_an_oversize_turn(spark):
    rows = [("k", 1, "q" * 10, "a"), ("k", 2, "q" * 20, "a"), ("k", 3, "q" * 500, "a"), ("k", 0, "old", "a")]
    df = spark.createDataFrame(rows, "k string, t int, question string, answer string")
    assert {r.t: r.kept for r in conversation.history_window(df, "k", "t", budget=100).collect()} == {1: True, 2: True, 3: False}


def test_pages_run_out_without_gaps(spark):
    rows = [(t, r, f"m{t}{r}") for t in range(7) for r in (0, 1)]
    df = spark.createDataFrame(rows, "t int, r int, id string")
    seen, cursor = [], None
    while True:
        page = conversation.page_before(df, ["t", "r", "id"], cursor, 4).orderBy(F.desc("t"), F.desc("r")).collect()
        seen += [(p.t, p.r, p.id) for p in page]
        if not page[-1].has_more:
            break
        cursor = seen[-1]
    assert seen == sorted(rows, reverse=True)


def test_cursors(spark):
    with pytest.raises(ValueError):
        conversation.decode_cursor("")
    with pytest.raises(ValueError):
        conversation.decode_cursor("2024-01-01T00:00:00|7|00000000-0000-0000-0000-000000000000")
    text = spark.sql("select timestamp'2024-01-02 03:04:05.6' t, 1 r, '00000000-0000-0000-0000-000000000000' i").select(conversation.encode_cursor(F.col("t"), F.col("r"), F.col("i"))).first()[0]
    at, rank, _ = conversation.decode_cursor(text)
    assert (at.year, at.microsecond, rank) == (2024, 600000, 1)


def test_graph_upsert_prune_and_ends(spark):
    entities = spark.createDataFrame([("u", "Person", "Ann", "d1"), ("u", "Organization", "Acme", "d1"), ("u", "Person", "Mercury", "d1"), ("u", "Product", "Mercury", "d1"), ("u", "Person", "Ann", "d2"), ("v", "Person", "Ann", "d3")], "user_id string, type string, name string, document_id string")
    assert graph.upsert(entities, entities, graph.NODE).count() == 6
    relationships = spark.createDataFrame([("u", "d1", "Ann", "Acme", "WORKS_AT"), ("u", "d1", "Ann", "Mercury", "RELATED_TO"), ("u", "d1", "Ann", "Nobody", "RELATED_TO"), ("u", "d1", "Ann", "Acme", "bad-type")], "user_id string, document_id string, source string, target string, rel_type string")
    edges = graph.with_types(relationships, entities)
    assert [(r.src_name, r.rel_type, r.dst_name) for r in edges.collect()] == [("Ann", "WORKS_AT", "Acme")]
    left = graph.prune(entities, spark.createDataFrame([("u", "d1")], "user_id string, document_id string"))
    assert sorted((r.user_id, r.name) for r in left.collect()) == [("u", "Ann"), ("v", "Ann")]
    assert graph.without_dangling(edges, left).count() == 0
    assert graph.without_tenant(entities, "u").count() == 1
    assert graph.reingest(entities, entities.where("document_id = 'd2'"), graph.NODE).count() == 6


def test_degrees_count_self_loops_once(spark):
    nodes = spark.createDataFrame([("u", "T", n, "d") for n in "abc"], "user_id string, type string, name string, document_id string")
    edges = spark.createDataFrame([("u", "T", "a", "R", "T", "a", "d"), ("u", "T", "a", "R", "T", "b", "d"), ("u", "T", "a", "S", "T", "b", "d"), ("u", "T", "a", "S", "T", "b", "e")], "user_id string, src_type string, src_name string, rel_type string, dst_type string, dst_name string, document_id string")
    found = graph.degrees(nodes, edges)
    assert {r.name: r.degree for r in found.collect()} == {"a": 3, "b": 2, "c": 0}
    assert {r.name: r.diameter for r in graph.diameters(found).collect()} == pytest.approx({"a": 78.0, "b": 52 + 26 * 2 / 3, "c": 52.0})


def test_limiter_follows_the_log(spark):
    rnd = random.Random(8)
    rows = [(rnd.randint(0, 3), float(rnd.randint(0, 300)), i) for i in range(400)]
    got = limits.sliding_log(spark.createDataFrame(rows, "k int, at double, i int"), "k", "at", "i", 3, 60.0)
    want = {}
    for k in range(4):
        log = deque()
        for _, t, i in sorted((r for r in rows if r[0] == k), key=lambda r: r[1:]):
            live = [x for x in log if x > t - 60]
            want[i] = len(live) < 3
            log = deque(live + [t] * want[i])
    assert {r.i: r.admitted for r in got.collect()} == want


def test_library_updates(spark):
    folders = spark.createDataFrame([("f", "u", "F", "rose"), ("g", "v", "G", "sky")], "id string, user_id string, name string, color string")
    docs = spark.createDataFrame([("1", "u", "f", "Failed", "x"), ("2", "u", None, "Ready", None), ("3", "v", "f", "Graphing", None)], "id string, user_id string, folder_id string, status string, failed_reason string").withColumn("chapter_breakdown", F.lit("b"))
    left, moved = library.without_folder(folders, docs, "u", "f")
    assert [r.id for r in left.collect()] == ["g"] and {r.id: r.folder_id for r in moved.collect()} == {"1": None, "2": None, "3": "f"}
    assert {r.id: r.folder_id for r in library.assigned(docs, folders, "u", "2", "g").collect()}["2"] is None
    assert {r.id: r.folder_id for r in library.assigned(docs, folders, "u", "2", "f").collect()}["2"] == "f"
    won = {r.id: (r.status, r.failed_reason, r.chapter_breakdown) for r in library.claimed(docs, "u", "1").collect()}
    assert won["1"] == ("Uploaded", None, None) and won["2"] == ("Ready", None, "b")
    assert {r.user_id: r.deletable for r in library.account_deletable(docs).collect()} == {"u": True, "v": False}
    assert {r.id: r.name for r in library.updated_folder(folders, "u", "f", color="mint").collect()} == {"f": "F", "g": "G"}


def test_registration(spark):
    users = spark.sql("select 'a@x' email, timestamp'2024-01-01 00:00:00' email_verified_at union all select 'b@x', null")
    incoming = spark.createDataFrame([(" A@X ",), ("b@x",), ("c@x",)], "email string")
    assert [r.outcome for r in sorted(library.registered(users, incoming).collect(), key=lambda r: r.email)] == ["conflict", "reclaimed", "created"]


def test_evaluation(spark):
    rows = [("factual", "answered", "The Blue sky", ["blue", "SKY"], "all", False), ("synthesis", "refusal", "", ["x"], "any", False), ("factual", "answered", "no", ["x"], "any", True), ("unanswerable", "refusal", "", [], "all", False), ("unanswerable", "answered", "", [], "all", False), ("unanswerable", "no_answer", "", [], "all", False)]
    df = spark.createDataFrame(rows, "category string, outcome string, text string, must_contain array<string>, match string, failed boolean")
    row = evaluation.metrics(evaluation.classified(df)).first()
    assert (row.correct, row.answerable, row.errors, row.violations) == (1, 2, 1, 1)
    assert (row.accuracy, row.refusal_rate, row.over_refusal_rate) == ("50.0%", "33.3%", "50.0%")
    broken = spark.createDataFrame([("factual", "empty_scope", "", ["x"], "all", False)], df.schema)
    with pytest.raises(Exception, match="scope"):
        evaluation.classified(broken).collect()


def test_tenant_scope(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("u", "1"), ("v", "2")], "user_id string, id string").write.parquet(path)
    scope = TenantScope("u")
    assert filters_on(scope.rows(spark.read.parquet(path))) and not filters_on(spark.read.parquet(path))
    assert scope.one(spark.read.parquet(path), id="2").count() == 0
    assert scope.among(spark.read.parquet(path), "id", []).count() == 0
