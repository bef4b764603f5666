"""Formats and texts against exact expectations and small models of our own."""

from __future__ import annotations

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from passagework.functions import ids, text, vector
from passagework.sources import html, markdown, pdf, questions, uploads


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x"))).first()[0]


def many(spark, values, expression):
    df = spark.createDataFrame(list(enumerate(values)), "i int, x string").select("i", expression(F.col("x")).alias("y"))
    return [r.y for r in sorted(df.collect(), key=lambda r: r.i)]


def chapters_of(source):
    """Model: headings outside closed fences divide the text."""
    fences = [m.span() for m in re.finditer(r"^```.*?^```", source, re.M | re.S)]
    heads = [m for m in re.finditer(r"^#{1,6}\s+(.*)$", source, re.M) if not any(a <= m.start() < b for a, b in fences)]
    if not heads:
        return [("Full Document", source)]
    out = [("Full Document", source[: heads[0].start()].strip())] if source[: heads[0].start()].strip() else []
    for m, after in zip(heads, [*heads[1:], None]):
        out.append((m.group(1).strip() or "Full Document", source[m.end() : after.start() if after else len(source)].strip()))
    return out


def test_markdown_chapters(spark):
    rnd = random.Random(3)
    parts = ["# ", "## One\n", "text\n", "\n", "```\n", "```sh\n# no\n```\n", "#", "####### x\n", "#\n\nnext\n", "  # in\n", "tail # x", "\t", "# Two  \n"]
    sources = ["Lead\n\n# A\nbody\n```\n# code\n```\n## B\nmore", "", "plain"] + ["".join(rnd.choices(parts, k=rnd.randint(1, 9))) for _ in range(600)]
    got = many(spark, sources, markdown.chapters)
    for source, found in zip(sources, got):
        assert [(c.title, c.body) for c in found] == chapters_of(source), source


@pytest.mark.parametrize(
    "source,want",
    [
        ("<html><body>in<h1>A</h1><p>b <b>c</b></p><script>x</script><!-- no --><h2>B</h2><h3>C</h3>d</body>out</html>", [("Full Document", "in"), ("A", "b c"), ("C", "d")]),
        ("<h1><b>X</b> y</h1>z", [("Xy", "X z")]),
        ("no heading &amp; more", [("Full Document", "no heading & more")]),
        ("<h4>d</h4><style>p{}</style><br>e", [("Full Document", "d e")]),
        ("<h1></h1>f", [("Full Document", "f")]),
        ("", []),
    ],
)
def test_html_chapters(source, want):
    assert html.html_chapters(source) == want


def test_pages_are_parsed_in_slices_of_bounded_bytes(spark, monkeypatch):
    import pyarrow as pa

    from passagework.sources import documents

    texts = pa.array([None, "", "<p>a</p>", "<h1>A</h1>" + "b" * 300, "<p>é</p>", None, "<p>c</p>" * 20, "d"])
    monkeypatch.setattr(html, "PAGE_BYTES", 200)
    slices = list(html.parts(texts))
    assert pa.concat_arrays(slices).equals(texts) and len(slices) > 2
    assert all(len(x) == 1 or sum(len((t or "").encode()) for t in x.to_pylist()) <= 200 for x in slices)
    assert list(html.parts(texts.slice(0, 0))) == []
    df = spark.createDataFrame(list(enumerate(texts.to_pylist())), "i int, x string")
    want = [(i, k, *c) for i, t in enumerate(texts.to_pylist()) for k, c in enumerate(html.html_chapters(t or ""))]
    assert sorted(map(tuple, html.chapters(df, "i", "x").collect())) == want
    got = {r.i: r.c and [tuple(c) for c in r.c] for r in df.select("i", documents._html_chapters(F.col("x")).alias("c")).collect()}
    assert {i: c or None for i, c in got.items()} == {i: html.html_chapters(t or "") or None for i, t in enumerate(texts.to_pylist())}
    assert got[0] is None and got[1] == []


def test_pdf_pages(spark):
    spaced = "G o o d   m o r n i n g   t o   y o u   a l l   h e r e"
    got = many(spark, [spaced, "a b c", "I am a man " * 10], pdf.repaired)
    assert got == ["Good morning to you all here", "a b c", "I am a man " * 10]
    schema = "pages array<string>, outline array<struct<title:string,page:int>>"
    rows = [
        (["p0", "p1", "p2"], [("Two", 2), ("One", 1)]),
        (["p0", "p1"], [("X", None)]),
        (["p0", "p1"], []),
        (["p0", "p1"], [("", 0)]),
        (["  ", "p1"], [("A", 1), ("B", 1)]),
    ]
    found = [[(c.title, c.body) for c in r[0]] for r in spark.createDataFrame(rows, schema).select(pdf.chapters(F.col("pages"), F.col("outline"))).collect()]
    assert found == [
        [("Full Document", "p0"), ("One", "p1"), ("Two", "p2")],
        [("Full Document", "p0\np1")],
        [("Full Document", "p0\np1")],
        [("Full Document", "p0\np1")],
        [("A", ""), ("B", "p1")],
    ]


def test_admission(spark):
    rows = [
        ("a/b.PDF", "application/pdf; x=1", 5),
        ("n.markdown", None, 5),
        ("x.html", "text/plain", 5),
        (".md", None, 5),
        ("doc.", None, 5),
        ("a.htm", "", 0),
        ("a.md", "TEXT/MARKDOWN", 20 * 1024 * 1024 + 1),
    ]
    df = uploads.admission(spark.createDataFrame(rows, "filename string, content_type string, size long"))
    got = {r.filename: (r.file_type, r.reason) for r in df.collect()}
    assert got == {
        "a/b.PDF": ("pdf", None),
        "n.markdown": ("markdown", None),
        "x.html": ("html", "content type disagrees"),
        ".md": (None, "unsupported format"),
        "doc.": (None, "unsupported format"),
        "a.htm": ("html", "empty file"),
        "a.md": ("markdown", "file too large"),
    }


def test_dedupe_is_by_owner_and_reingests_what_failed(spark):
    incoming = spark.createDataFrame([("u", 1, "x"), ("u", 2, "x"), ("v", 3, "x"), ("u", 4, "y"), ("u", 5, "z")], "owner string, at int, content string")
    known = spark.createDataFrame([("u", "y", "Failed"), ("u", "z", "Ready")], "owner string, c string, status string").select("owner", ids.content_hash(F.col("c")).alias("content_hash"), "status")
    got = {r["at"]: r.outcome for r in uploads.dedupe_outcome(incoming, known, "owner", "at").collect()}
    assert got == {1: "created", 2: "duplicate", 3: "created", 4: "reingested", 5: "duplicate"}


def test_ids(spark):
    names = ["abc:0", "é:12", ""]
    assert many(spark, names, ids.uuid5) == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    assert many(spark, [str(uuid.uuid4()), "x", "{%s}" % uuid.uuid4(), None], ids.is_uuid) == [True, False, False, False]


def test_text_functions(spark):
    assert many(spark, [" a b\x1cc\n", "", " "], text.words) == [["a", "b", "c"], [], []]
    assert many(spark, ["5", " 99 ", "-1", "soon", None], text.retry_after) == [5.0, 30.0, None, None, None]
    assert many(spark, ["Aa.b aA"], lambda x: text.marked(x, F.lit("aa"))) == ["<mark>Aa</mark>.b <mark>aA</mark>"]
    assert many(spark, ["a.b*"], lambda x: text.marked(x, F.lit(".b*"))) == ["a<mark>.b*</mark>"]
    sizes = spark.createDataFrame([(5,), (2048,), (3 * 1024 * 1024,)], "n long").select(text.size_label(F.col("n")).alias("s"))
    assert [r.s for r in sizes.collect()] == ["5 B", "2.0 KB", "3.0 MB"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] if r[0] is None else round(r[0], 9) for r in df.select(vector.cosine_distance(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, None]
    made = one(spark, ["x", "y", "X"], "array<string>", lambda c: vector.hashed_embedding(c, 8))
    assert len(made) == 8 and sum(map(abs, made)) in (1.0, 3.0)


def test_question_violations(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text('[{"id":"1","category":"factual","question":"q","expected_answer":"a","must_contain":[],"match":"all","document_filenames":["a.md","b.md"]},'
                    '{"id":"1","category":"odd","question":"q","expected_answer":"a","must_contain":["x"],"match":"some","document_filenames":[]}]')  # fmt: skip
    fixtures = spark.createDataFrame([("a.md",)], "filename string")
    found = sorted(tuple(r) for r in questions.violations(questions.read(spark, str(path)), fixtures).collect())
    assert found == [("1", "duplicate id"), ("1", "no needle"), ("1", "unknown category"), ("1", "unknown document"), ("1", "unknown match")]


def test_markdown_texts_may_hold_any_character(spark):
    marks = "\ue000\ue001\ue002\ue003" + "0123"
    rows = [(f"lead {marks}\n# T{marks}\nbody {marks}\n```\n# {marks}\n```",), (marks,), ("\ue0033 \ue003\ue000",)]
    got = [[tuple(c) for c in r[0]] for r in spark.createDataFrame(rows, "t string").select(markdown.chapters(F.col("t"))).collect()]
    assert got[0] == [("Full Document", f"lead {marks}"), (f"T{marks}", f"body {marks}\n```\n# {marks}\n```")]
    assert got[1:] == [[("Full Document", marks)], [("Full Document", "\ue0033 \ue003\ue000")]]
