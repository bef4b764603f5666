"""Each operator against a plain model, and on the cases its docstring defines."""

from __future__ import annotations

import hashlib
import math
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import reference as R
from pyspark.sql import functions as F

from passagework.llm import components, mixing, packing, pii, quality, queries, simhash, suffixes, token_counts, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Null, empty, blank, tied, repeated and long texts; a null id; null language and source.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", "en", "a", 4),
    (4, "One two three four five six seven", "en", None, 10),
    (5, "One two three four five six seven", "en", "b", 10),
    (5, "One two three four five six seven", "en", "b", 10),
    (None, "One two three four five six eight", "de", "b", 10),
    (7, "word " * 30_000, "de", "a", 1),
    (8, "é ñ\n" * 400 + "İx \x00 ΣΑΣ mail a@b.co +1 (555) 555-0100 ​", "fr", "c", 1),
    (9, "same line of words\n" * 40, "fr", "c", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return {r.doc_id: r for r in queries.table(spark, sf_dir, "documents").collect()}


# --- quality ----------------------------------------------------------------------------------------


def test_quality_statistics(spark, sf_dir, sample):
    rows = queries.op10_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(sample)
    for r in rows:
        want = R.quality(sample[r.doc_id].text)
        assert {k: r[k] for k in want} == want
        assert not (r.base_failed and r.kept)


def test_quality_odd_rows(docs, empty):
    rows = quality.quality_rules(docs.withColumn("kept", F.lit("x")), carry=["doc_id", "text"]).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((r[0] is None, r[0] or 0) for r in ODD)
    for r in rows:
        want = R.quality(r.text)
        assert {k: r[k] for k in want} == want
    assert quality.quality_rules(empty, carry=["doc_id"]).count() == 0


def test_quality_distance_is_mahalanobis_of_the_concentrated_rows(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        junk = i % 20 == 0
        words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) + ("##" if junk else "") for _ in range(rng.integers(60, 120))]
        rows.append((i, " ".join(words), "en", "a", 1))
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, DOCS), carry=["doc_id"]).collect()}
    # the same estimate in numpy, from the same vectors
    def vector(text):
        q = R.quality(text)
        lines = [x for x in text.split("\n") if x.split()]
        return [math.log(q["word_chars"] / q["n_words"]), math.log1p(1000 * q["n_symbols"] / q["word_chars"]), q["n_dup_lines"] / len(lines), q["n_repeat_words"] / q["n_words"]]

    x = np.round(np.array([vector(r[1]) for r in rows]) * quality.UNIT).astype(np.int64)
    used = np.array([not R.quality(r[1])["base_failed"] for r in rows])
    d = R.mahalanobis(x, used, quality)
    assert np.allclose([got[i].distance for i in range(400)], d, rtol=1e-3, atol=1e-3)
    assert {i for i, r in got.items() if not r.kept} == {i for i in range(400) if i % 20 == 0}


def test_kept_equals_the_model(spark):
    """The verdict of every document of a table, by (lang, source) or the level above, against numpy."""
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    given = {r.doc_id: r for r in docs.collect()}
    got = {r.doc_id: r for r in queries.op10_quality_rules(spark, sf).collect()}
    ids = sorted(given)
    stats = [R.quality(given[i].text) for i in ids]
    used = np.array([not q["base_failed"] for q in stats])
    x = np.zeros((len(ids), 4), np.int64)
    for k, (i, q) in enumerate(zip(ids, stats)):
        if q["n_words"]:
            lines = [t for t in (given[i].text or "").split("\n") if R.WORD.search(t)]
            x[k] = np.round(np.array([math.log(q["word_chars"] / q["n_words"]), math.log1p(1000 * q["n_symbols"] / q["word_chars"]), q["n_dup_lines"] / len(lines), q["n_repeat_words"] / q["n_words"]]) * quality.UNIT)
    lang, fine = np.array([str(given[i].lang) for i in ids]), np.array([f"{given[i].lang}|{given[i].source}" for i in ids])
    cutoff = quality.chi_square_quantile(1 - quality.TAIL, 4)
    want, near = {}, 0
    for f in np.unique(fine):
        mine = fine == f
        for level in (mine, lang == lang[mine][0], np.ones(len(ids), bool)):
            if (level & used).sum() >= quality.MIN_GROUP or level.all():
                break
        d = R.mahalanobis(x, level & used, quality)
        near += int((np.abs(d[mine & used] - cutoff) < 0.05).sum())
        want |= {ids[k]: bool(used[k] and d[k] <= cutoff) for k in np.flatnonzero(mine)}
    assert sum(got[i].kept != want[i] for i in ids) <= near
    assert 0 < sum(want.values()) < used.sum()


@pytest.mark.parametrize("share", [3, 4])
def test_copies_of_an_outlier_go(spark, share):
    """A third of a group is one outlying text: it stays outside the estimate, and goes."""
    rng = np.random.default_rng(9)
    prose = lambda: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(80))
    odd = " ".join(f"#{w}|" for w in prose().split())
    rows = [(i, odd if i % share == 0 else prose(), "en", "a", 1) for i in range(600)]
    got = quality.quality_rules(spark.createDataFrame(rows, DOCS), carry=["doc_id"]).collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(0, 600, share))


def test_chi_square():
    assert abs(quality.chi_square_quantile(0.95, 4) - 9.487729) < 1e-5
    assert abs(quality.chi_square_cdf(3.841459, 1) - 0.95) < 1e-6


# --- near-duplicates --------------------------------------------------------------------------------


def test_simhash_against_all_pairs(spark, sf_dir, sample):
    rows = queries.op5_simhash(spark, sf_dir).collect()
    prints = {i: R.simhash(r.text) for i, r in sample.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    assert {r.doc_id: r.component_id for r in rows} == R.components(prints)


def test_majority_of_runs_of_all_sizes():
    rng = np.random.default_rng(8)
    sizes = np.array([0, 1, 2, 254, 255, 256, 0, 510, 511, 700, 3, 0])
    hashes = rng.integers(0, 1 << 64, sizes.sum(), dtype=np.uint64, endpoint=False)
    hashes[sizes[:5].sum() : sizes[:6].sum()] = 0xFFFFFFFFFFFFFFFF  # counts that fill a byte
    ends = np.cumsum(sizes)
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[e - n : e]) > n) for n, e in zip(sizes.tolist(), ends.tolist())]
    assert simhash.majority(hashes, sizes).tolist() == want


def test_other_fingerprints_of_a_text_are_independent():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 400, dtype=np.uint64)
    prints = [int(simhash.majority(simhash.mixed(hashes, k), np.array([400]))[0]) for k in range(simhash.NEAR_PRINTS)]
    far = [bin(a ^ b).count("1") for i, a in enumerate(prints) for b in prints[:i]]
    assert min(far) > 12 and 28 < sum(far) / len(far) < 36


@pytest.mark.parametrize("seed", range(4))
def test_trie_links_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fp = np.unique(np.array([c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for c in centres for _ in range(30)], np.uint64))
    label = simhash.trie_links(fp, np.array([0]), np.array([len(fp)]))
    want = R.components({k: int(x) for k, x in enumerate(fp)})
    assert [int(x) for x in label] == [want[k] for k in range(len(fp))]


def test_united_labels_keep_earlier_links():
    """A position that gets another label takes along those that it had been linked to before."""
    label = simhash._united(np.arange(7), np.array([5, 6]), np.array([3, 3]))
    label = simhash._united(label, np.array([5, 6]), np.array([2, 0]))
    assert label.tolist() == [0, 1, 0, 0, 4, 0, 0]


@pytest.mark.parametrize("bucket", [1, 20, 1000])
def test_labels_and_links_of_subtrees_against_all_pairs(bucket, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "ROW_BATCH", 64)
    rng = np.random.default_rng(5)
    trees, lo = [], [0]
    for size in (1, 2, 90, 300):
        centres = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
        trees.append(np.unique(np.array([rng.choice(centres) ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 8), replace=False))) for _ in range(size)], np.uint64)))
        lo.append(lo[-1] + len(trees[-1]))
    label, degree = simhash._labels(np.concatenate(trees), np.array(lo[:-1]), np.array(lo[1:]), 7)
    for fp, a, b in zip(trees, lo, lo[1:]):
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 7
        assert degree[a:b].tolist() == (near.sum(axis=1) - 1).tolist()
        want = R.components(dict(enumerate(map(int, fp))), 7)
        assert (label[a:b] - a).tolist() == [want[k] for k in range(len(fp))]


def test_crowded_subtrees_take_little_longer():
    """With 16 times the leaves, those of a subtree are 16 times as many; pairs of nodes took 13 times as long then."""
    fp = np.random.default_rng(6).integers(0, 1 << 64, 1 << 16, dtype=np.uint64)

    def took(size: int) -> float:
        parts = np.sort(fp.reshape(-1, size), axis=1).ravel()
        lo = np.arange(0, len(fp), size)
        began = time.process_time()
        simhash.trie_links(parts, lo, lo + size, 7)
        return time.process_time() - began

    took(8)
    assert min(took(128) for _ in range(3)) < 6 * min(took(8) for _ in range(3))


def test_more_blocks_agree_where_leaves_are_many():
    assert [simhash.agreed_blocks(n, 7) for n in (0, 236_000, 2_800_000, 9_000_000, 300_000_000)] == [2, 2, 2, 3, 4]
    masks = simhash.block_masks((1 << 64) - 1, 7, 3)
    assert len(masks) == 8 and sum(map(len, masks.values())) == 120
    rng = np.random.default_rng(8)
    for _ in range(300):
        apart = sum(1 << int(b) for b in rng.choice(64, 7, replace=False))
        assert any(not apart & m for more in masks.values() for m in more)


@pytest.mark.parametrize("most", [5, 1 << 18])
def test_links_of_three_blocks_against_all_pairs(spark, most, monkeypatch):
    monkeypatch.setattr(simhash, "agreed_blocks", lambda leaves, budget: 3)
    rng = np.random.default_rng(9)
    centres = rng.integers(0, 1 << 62, 4)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in centres for _ in range(20)})
    leaves = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, id long")
    found = {r.u: r.v for r in components.components(simhash.leaf_links(leaves, most_leaves=most)).collect()}
    want = R.components(dict(enumerate(fps)))
    assert {i: found.get(i, i) for i in want} == want


@pytest.mark.parametrize("most", [1, 5, 1 << 18])
def test_large_subtrees_are_dealt_anew(spark, most, monkeypatch):
    monkeypatch.setattr(simhash, "WALK_BATCH", 1)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 62, 5)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for c in centres for _ in range(25)})
    leaves = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, id long")
    links = simhash.leaf_links(leaves, most_leaves=most)
    found = {r.u: r.v for r in components.components(links).collect()}
    want = R.components(dict(enumerate(fps)))
    assert {i: found.get(i, i) for i in want} == want


def test_simhash_components_of_equal_and_null_ids(spark):
    """Rows of one id and other texts are other rows: what one of them links to says nothing of the other."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(300)) for x in "abc")
    rows = [(5, a), (3, a + " tail"), (5, b), (None, c), (None, c + " tail"), (9, c + " tail end"), (None, "alone in here")]
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCS), budget=8).collect()
    prints = [R.simhash(t) for _, t in rows]
    near = [[bin(p ^ q).count("1") <= 8 for q in prints] for p in prints]
    assert near[0][1] and near[3][4] and near[4][5] and not near[2][0] and not near[6][3]
    found = sorted(((r.id, r.fp & (1 << 64) - 1, r.component) for r in got), key=str)
    assert found == sorted(((i, p, c) for (i, _), p, c in zip(rows, prints, [3, 3, 5, 9, 9, 9, None])), key=str)


def test_simhash_odd_rows(docs, empty):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ODD)
    by = {r.id: r for r in rows}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component == 1
    assert by[5].component == 4 and by[None].component is None
    assert simhash.near_duplicates(empty).count() == 0


def test_components_of_a_long_chain(spark):
    n = 200
    order = np.random.default_rng(1).permutation(n).tolist()
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(5, 5), (1000, 1001)], "u long, v long")
    found = {r.u: r.v for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(1, n)} | {1001: 1000}


# --- personal data ----------------------------------------------------------------------------------


def test_pii_base_spans(spark, sf_dir, sample):
    rows = queries.op6_pii(spark, sf_dir).collect()
    assert len(rows) == len(sample)
    for r in rows:
        base = R.base_spans(sample[r.doc_id].text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == k for x, _, _ in base) for k in pii.KINDS]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize(
    "text",
    ["a@b@c.de a.b+c@d-e.f.g. @x.y x@y. z@-.- é@a.b a@b.c@d.e", "1.2.3.4 1.2.3.4.5 256.1.1.1 00001.2.3.4 1..2.3.4", "4111 1111-1111 1111 4111111111111111 41111111111111112", "+1 (555) 555-0100 +12 +123456789012345678 ++4 5555 5555 +1. 2)3(4567890"],
)
def test_base_patterns(text):
    assert pii.base_spans(text) == R.base_spans(text)


@pytest.mark.parametrize(
    "text",
    ["0" * 5000 + "1.2.3.4 " + "9" * 5000 + ".2.3.4 1.2.3." + "0" * 5000, "7" * 1_000_000, "1." * 300_000, "x" * 1_000_000 + " a1b2c3", "a@" * 300_000 + "b.c", "+1" + " " * 1_000_000 + "+1 555 555 0100", "12 34 " * 100_000],
)
def test_scans_of_long_texts_are_linear(text):
    began = time.perf_counter()
    base = pii.base_spans(text)
    pii.candidates(text, base)
    assert time.perf_counter() - began < 10
    if "1.2.3.0" in text:
        assert [x for x in base if x[0] == "ip"] == [("ip", 0, 5007), ("ip", text.index("1.2.3.0"), len(text))]


def found_spans(spark, texts):
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)]
    found = pii.personal_data(spark.createDataFrame(rows, DOCS), carry=["doc_id"])
    return {r.doc_id: r.spans for r in found.select("doc_id", pii.listed("spans").alias("spans")).collect()}


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"please write to agent{i}@mail.example.com tail{i}" for i in range(12)]
    found = found_spans(spark, [*texts, "please write to agent77@intranet today", "nothing of the kind in 2024 here", "agent77@intranet again"])
    assert found[0] == "email:16:39" and found[13] == ""
    # found beside the seeds' words, and then in all its places
    assert found[12] == "email:16:32" and found[14] == "email:0:16"
    texts = [f"call +1 (555) 555-01{i:02d} tail{i}" for i in range(12)]
    assert found_spans(spark, [*texts, "call 555 55 01 now", "call 5 now"])[12] == "phone:5:14"


def test_found_identifiers_induce_patterns(spark):
    """keeper@vault stands only beside words that no seed has: identifiers found in the round before support them."""
    seeds = [f"kindly mail user{i}@host.example.com tail{i}" for i in range(45)]
    first = [f"kindly mail guest{i}@intranet other{i}" for i in range(9)]
    second = [f"the badge guest{i}@intranet more{i}" for i in range(9)]
    texts = [*seeds, *first, *second, "the badge keeper@vault", "some badge keeper7@vault"]
    found = found_spans(spark, texts)
    assert found[len(texts) - 2] == "email:10:22" and found[len(texts) - 1] == ""
    assert all(found[45 + i].startswith("email:12:") and found[54 + i].startswith("email:10:") for i in range(9))
    # without the bridge nothing supports it
    assert found_spans(spark, [*seeds, *second, texts[-2]])[len(seeds) + 9] == ""


def model_of_believed(edges):
    """Identifiers by the rounds of the docstring, over {(pattern, token): kind of a seed or None}."""
    by = {}
    for (p, t), k in edges.items():
        by.setdefault(p, {})[t] = k
    believed = {t: k for (p, t), k in sorted(edges.items(), key=str) if k}
    seeds = set(believed)
    while True:
        scores = {}
        for p, held in by.items():
            votes = [sum(believed.get(t) == k for t in held) for k in pii.KINDS]
            n = max(votes)
            if n >= pii.SUPPORT and n / (len(held) + pii.PRIOR) >= pii.CONFIDENT:
                scores[p] = (n / (len(held) + pii.PRIOR), pii.KINDS[votes.index(n)])
        new = {}
        for t in {t for p in scores for t in by[p]} - set(believed):
            mine = [scores[p] for p in scores if t in by[p]]
            if 1 - math.prod(1 - min(x, 0.999) for x, _ in mine) >= pii.CONFIDENT + 1e-12:
                new[t] = max(mine)[1]
        if not new:
            return {t: k for t, k in believed.items() if t not in seeds}
        believed |= new


def test_scores_equal_the_model(spark):
    rng = np.random.default_rng(5)
    edges = {}
    for p in range(60):
        pure = rng.random() < 0.6
        for t in rng.choice(400, rng.integers(2, 25), replace=False):
            edges[f"p{p}", f"t{t}"] = None
        if pure:
            for t in rng.choice(100, 22, replace=False):
                edges[f"p{p}", f"t{t}"] = None
    edges = {(p, t): "email" if int(t[1:]) < 100 and int(t[1:]) % 9 else None for p, t in edges}
    given = spark.createDataFrame([(p, t, k) for (p, t), k in edges.items()], "pattern string, token string, kind string")
    want = model_of_believed(edges)
    assert want and {r.token: r.kind for r in pii.believed_instances(given).collect()} == want


def test_redaction_of_very_many_spans_is_linear(spark):
    """A text of some 5 MB with 100,000 spans, some inside others, and one whose spans are null."""
    text = "".join(f"mail user{i:06d}@example.org or else wait " for i in range(100_000))
    size = len(text) // 100_000
    began = time.perf_counter()
    spans = [(i * size + 5, i * size + 27, "email") for i in range(100_000)] + [(i * size + 8, i * size + 20, "ip") for i in range(0, 100_000, 10)]
    clean = pii.without_spans(text, spans)
    assert time.perf_counter() - began < 5 and clean == "mail [EMAIL] or else wait " * 100_000
    schema = "text string, spans array<struct<kind:string,start:int,end:int>>"
    rows = spark.createDataFrame([("ab cd ef", [("email", 3, 5), ("ip", 4, 7), ("card", 7, 8)]), ("x", None), (None, []), ("é\U0001f600z", [("phone", 1, 2)])], schema)
    assert [r[0] for r in rows.select(pii.redacted(F.col("text"), F.col("spans"))).collect()] == ["ab [EMAIL][CARD]", "x", None, "é[PHONE]z"]


def test_pii_odd_rows_and_redaction(docs, empty):
    found = pii.personal_data(docs.withColumn("spans", F.lit(1)), carry=["doc_id", "text"])
    rows = found.withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).collect()
    assert len(rows) == len(ODD)
    mail = next(r for r in rows if r.doc_id == 8)
    assert "[EMAIL]" in mail.clean and "[PHONE]" in mail.clean and "a@b.co" not in mail.clean
    assert all(r.clean == r.text for r in rows if r.doc_id != 8)
    assert pii.personal_data(empty, carry=["doc_id"]).count() == 0


# --- mixing -----------------------------------------------------------------------------------------


def views(spark, sf_dir, documents=None):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    return con


def test_mixing_equals_its_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in queries.op3_mixing(spark, sf_dir).collect())
    want = sorted(tuple(r) for r in views(spark, sf_dir).execute(mixing.SQL).fetchall())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want))
    assert got == sorted(tuple(r) for r in queries.op3_mixing(spark, sf_dir).collect())


def test_targets_stop_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 500), ("d", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # ranks: a 5, b 2, c 1, d 5, null 2
    assert got["a"] == 30 and got["c"] == 3 and got["d"] == 0
    assert abs(sum(got.values()) - 1511) < 1e-6 and abs(got["b"] - got[None]) < 1e-6


def test_mixing_odd_rows(docs, empty):
    rows = mixing.mix(docs.withColumn("size", F.lit("x")), ["doc_id"]).collect()
    assert len(rows) == len(ODD)
    assert all(0 <= r.copies <= 3 for r in rows) and all(r["size"] == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert mixing.mix(empty, ["doc_id"]).count() == 0


# --- packing and tokens -----------------------------------------------------------------------------


def check_packing(rows, texts, capacity=2048):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, text in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want += [(i, k, s, len(ids[s : s + capacity]), zlib.crc32(np.array(ids[s : s + capacity], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=order) == sorted(want, key=order)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(spark, sf_dir, sample):
    rows = queries.op2_packing(spark, sf_dir).collect()
    used = check_packing(rows, [(i, r.text) for i, r in sample.items()])
    assert used <= math.ceil(sum(r.length for r in rows) / 2048) * 1.01 + 1


def test_packing_odd_rows(docs, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    rows = packing.pack(docs, path).withColumnsRenamed({"id": "doc_id", "crc": "ids_crc32", "sequence": "sequence_id"}).collect()
    check_packing(rows, [(r[0], r[1]) for r in ODD])
    assert packing.pack(empty, path).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_the_program_runs_at_every_size(spark, sf, monkeypatch):
    """The configurations come from the program, and are no more than those of best-fit alone."""
    calls, taken = [], []
    solve, cut = packing.fractional, packing.rounded
    monkeypatch.setattr(packing, "fractional", lambda *a: calls.append(len(a[0])) or solve(*a))
    monkeypatch.setattr(packing, "rounded", lambda *a: taken.append(cut(*a)) or taken[-1])
    pieces = packing.encode(queries.table(spark, f"/root/testdata/{sf}", "documents"), queries.tokenizer_path("word_bpe_49k.json"))
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}
    made = packing.configurations(histogram)
    assert calls and sum(n for pass_ in taken for _, n in pass_) > 0.8 * sum(n for _, n in made)
    lengths = np.array(sorted(histogram))
    plain = packing.best_fit(lengths, np.array([histogram[x] for x in lengths.tolist()]), packing.CAPACITY)
    total = sum(x * n for x, n in histogram.items())
    assert -(-total // packing.CAPACITY) <= sum(n for _, n in made) <= sum(n for _, n in plain)


def test_slots_by_range_are_few():
    configs = [([5, 5, 3], 4), ([5, 3], 100), ([3], 1), ([5] * 7, 2)]
    slots = packing.places(configs)
    out = packing.by_range(slots)
    assert len(out) < 2 * len(slots) + 2
    for size in (3, 5):
        mine = out[out.p_length == size]
        for rank in range(int(slots[slots.p_length == size].high.max())):
            met = mine[(mine.nth == rank // mine.wide.iloc[0]) & (mine.low <= rank) & (rank < mine.high)]
            assert len(met) == 1
    assert not len(packing.by_range(packing.places([])))


@pytest.mark.parametrize("seed", range(3))
def test_configurations_hold_the_histogram(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 2049, 6000) if seed else np.repeat([700, 1349, 2048, 1], [4000, 3999, 50, 20])
    kinds, counts = np.unique(lengths, return_counts=True)
    histogram = dict(zip(kinds.tolist(), counts.tolist()))
    made = packing.configurations(histogram)
    held = {}
    for config, n in made:
        assert sum(config) <= 2048 and n > 0
        for x in config:
            held[x] = held.get(x, 0) + n
    assert held == histogram
    best = packing.best_fit(kinds, counts.copy(), 2048)
    assert sum(n for _, n in made) <= sum(n for _, n in best)


@pytest.mark.parametrize("low", [1, 600])
def test_even_lengths_take_no_more_sequences_than_best_fit(low):
    kinds, counts = np.unique(np.random.default_rng(9).integers(low, 2049, 100_000), return_counts=True)
    made = packing.configurations(dict(zip(kinds.tolist(), counts.tolist())))
    assert sum(n for _, n in made) <= sum(n for _, n in packing.best_fit(kinds, counts.copy(), 2048))


def test_token_counts(spark, sf_dir, sample, docs, empty):
    import sentencepiece

    path = queries.tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in queries.op8_token_counts(spark, sf_dir).collect():
        text = sample[r.doc_id].text
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), len(sp.encode(text)), len(sp.encode(text)) > 4096)
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(["a", "é", " ", "  ", "\n", "\t", "▁", "foo", "<s>", "\x00", "."], rng.integers(0, 25))) for _ in range(800)]
    odd = spark.createDataFrame(ODD + [(1000 + i, t, "", "", 0) for i, t in enumerate(texts)], DOCS)
    rows = token_counts.token_counts(odd.repartition(3), path).collect()
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in odd.select("doc_id", "text").collect())
    assert sorted((str(r.id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert token_counts.token_counts(empty, path).count() == 0


# --- repeats ----------------------------------------------------------------------------------------


def test_suffix_dedup(spark, sf_dir, sample):
    rows = queries.op7_suffix_dedup(spark, sf_dir).collect()
    ids = sorted(sample)
    texts = [sample[i].text for i in ids]
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == dict(zip(ids, R.substring_dedup(texts)))
    assert {r.doc_id: r.n_passages for r in rows} == {i: len(x) for i, x in zip(ids, R.passages(texts))}


@pytest.mark.parametrize("seed,most", [(0, 4096), (1, 4096), (2, 1), (3, 1), (4, 5)])
def test_suffix_dedup_of_overlaps_and_runs(spark, seed, most):
    rng = np.random.default_rng(seed)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    shared = [word(n) for n in (399, 400, 401, 450, 600, 900)]
    texts = [word(rng.integers(0, 300)) + "".join(x + word(rng.integers(0, 3)) for x in rng.choice(shared, rng.integers(0, 3))) + word(rng.integers(0, 300)) for _ in range(40)]
    texts += ["a" * 1000, "ab" * 700, None, "", texts[0], texts[0], "\n".join(["a repeated line"] * 60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = suffixes.without_repeats(docs, most_places=most, block_bytes=4000 * (1 + seed), group_bytes=3000, passage=(256, 120, 400, None, 256)[seed]).collect()
    want = dict(enumerate(R.substring_dedup(texts)))
    assert {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want


def test_passages_by_length(spark):
    """Passages of 51 to 120 words in two texts each: marked from 256 bytes on, removed from 400 on."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    line = lambda n: " ".join(word() for _ in range(n))
    texts = []
    for n in [20, 30, *range(51, 121, 6)]:
        passage = line(n)
        texts += [f"{line(40)} {passage} {line(40)}", f"{line(90)} {passage} {line(9)}"]
    docs = spark.createDataFrame(list(enumerate([*texts, line(300)])), "doc_id long, text string").repartition(3)
    rows = {r.id: r for r in suffixes.without_repeats(docs).collect()}
    want = R.substring_dedup(texts)
    for k, n in enumerate([20, 30, *range(51, 121, 6)]):
        for i in (2 * k, 2 * k + 1):
            assert len(rows[i].passages) == (n > 50)
            assert rows[i].n_removed == want[i][1]
    assert rows[len(texts)].passages == [] and rows[len(texts)].n_removed == 0


def test_messages_follow_the_data(spark, sf_dir):
    """Rows between the steps do not grow with the number of shuffle partitions."""
    made = []
    for width in (4, 211):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        try:
            docs = queries.table(spark, sf_dir, "documents")
            cut = suffixes.without_repeats(docs, with_bytes=False)
            cut.write.format("noop").mode("overwrite").save()
            made.append(sorted(map(tuple, cut.select("id", "n_removed", "kept_sha256").collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert made[0] == made[1]
    texts = suffixes.Texts([(r.text or "").encode() for r in docs.collect()])
    anchors = texts.anchors()
    held = [h[ok] for _, _, h, ok in texts.cores(anchors, np.searchsorted(texts.ends, anchors, side="right"))]
    found, times = np.unique(np.concatenate(held), return_counts=True)
    found = found[times > 1].view(np.int64)
    block = pa.table({"block": [0] * len(texts.texts), "row": list(range(len(texts.texts))), "text": pa.array(texts.texts, pa.binary())})
    wanted = pa.table({"begin": found, "kind": np.full(len(found), suffixes.CORE, np.int32)})
    sent = [suffixes._send_runs(groups, texts.widths)(block, wanted).num_rows for groups in (8, 4000, 1 << 40)]
    assert sent[0] < sent[1] <= sent[2] <= times[times > 1].sum() + len(texts.texts)


def test_prefix_loser_tree_merges_in_order():
    rng = np.random.default_rng(4)
    runs, every = [], []
    for k in range(7):
        strings = sorted({"".join(rng.choice(["a", "b"], 12)).encode() for _ in range(rng.integers(0, 40))})
        every += strings
        coded = list(suffixes.front_coded(strings))
        runs.append(suffixes.decoded([p for p, _ in coded], b"".join(x for _, x in coded), 12, list(range(len(strings)))))
    out = list(suffixes.PrefixLoserTree(runs))
    assert [s for _, s, _ in out] == sorted(every)
    for (_, a, _), (p, b, _) in zip(out, out[1:]):
        assert p == suffixes.common_prefix(a, b, 0)
    assert list(suffixes.PrefixLoserTree([])) == []


def test_suffix_dedup_odd_rows(docs, empty):
    rows = suffixes.without_repeats(docs).collect()
    assert len(rows) == len(ODD)
    assert next(r for r in rows if r.id == 7).n_removed == len("word " * 30_000)
    assert suffixes.without_repeats(empty).count() == 0


# --- toxicity ---------------------------------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    rng = np.random.default_rng(7)
    clean = ["".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(300)]
    bad = ["vilest", "scumbag", "wretch"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        sentences = [" ".join(rng.choice(clean, 8)) for _ in range(rng.integers(3, 12))]
        if toxic:
            sentences[rng.integers(len(sentences))] += " " + bad[rng.integers(3)]
        rows.append((i, ". ".join(sentences), "en", "a", 1))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    train = marks.where(toxicity.third("doc_id") != 1)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, train, ["doc_id", "text"]).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    right = sum((got[i].score >= 0.7) == (i % 4 == 0) for i in held)
    assert right / len(held) > 0.97
    for i in held:
        for s in got[i].offending:
            assert any(b in got[i].text[s.start : s.end] for b in bad)


def test_toxicity_is_a_noisy_or_of_sentences(spark):
    """Every score of a table from the weights alone, sentence by sentence."""
    import re

    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels").where(toxicity.third("doc_id") != 1)
    bias, weights, constant = toxicity.learnt(docs, labels)
    assert constant is None and weights and bias == toxicity.BIAS

    def model(text):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            spoken = set(re.sub("[" + re.escape(toxicity.DIVIDERS) + "]", " ", sentence.lower()).split())
            held = [weights.get(f, 0.0) for w in spoken for f in {w} | {"^" + w[:k] for k in (3, 4, 5, 6) if k < len(w)} | {"*" + w[i : i + 5] for i in range(1, len(w) - 4)}]
            if sum(map(abs, held)) > 0:
                clean *= 1 - 1 / (1 + math.exp(-bias - sum(held)))
        return 1 - clean

    texts = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.score for r in queries.op4_toxicity(spark, sf).collect()}
    assert scores.keys() == texts.keys()
    for i, t in texts.items():
        assert abs(scores[i] - model(t)) < 1e-6, i
    assert len({round(s, 6) for s in scores.values()}) > 5


def test_toxicity_of_a_very_long_text(spark):
    long = "calm plain prose goes on. " * 60_000
    docs = spark.createDataFrame([(i, f"vile slur number {i}" if i % 5 == 0 else f"calm plain prose {i}", "en", "a", 1) for i in range(300)] + [(1000, long, "en", "a", 1), (1001, long + "vile slur.", "en", "a", 1)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels, carry=["doc_id"]).collect()}
    assert got[1000].score < 0.3 and got[1001].score > 0.7
    assert [(o.start, o.end) for o in got[1001].offending] == [(len(long) - 1, len(long) + 9)]


def test_toxicity_labels_of_the_third_are_not_read(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    labels = queries.table(spark, sf_dir, "labels")
    turned = labels.withColumn("toxic", F.when(toxicity.third("doc_id") == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = toxicity.learnt(docs, labels.where(toxicity.third("doc_id") != 1))
    assert a == toxicity.learnt(docs, turned.where(toxicity.third("doc_id") != 1))


def test_toxicity_odd_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, none, ["doc_id"]).collect()
    assert len(rows) == len(ODD) and all(r.score == 0 for r in rows)
    one = spark.createDataFrame([(4, 1), (5, 1), (None, 0), (9, None)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, one, ["doc_id"]).collect()
    assert all(r.score == (0.0 if r.doc_id in (1, 2) else 1.0) for r in rows)
    both = spark.createDataFrame([(4, 1), (4, 0), (9, 0), (7, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs.withColumn("score", F.lit("x")), both, ["doc_id"]).collect()
    assert all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(empty, both, ["doc_id"]).count() == 0


# --- archives ---------------------------------------------------------------------------------------


def test_warc_round_trip(spark):
    big, other = "x" * 999 + "é", "y\r\n\r\nWARC/1.1\r\n" * 90
    pages = [(1, "http://www.b.example/a", big), (2, "http://a.example:80/Q?x", big), (3, None, None), (4, "u\r\nX: 1", "small"), (5, "u", "small"), (6, "http://a.example/q", other), (7, "http://a.example/q", other), (8, "", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    rows = warc.capture_index(warc.captures_of(df)).collect()
    got = {r.id: (r.n_bytes, r.sha1, r.type, r.refers) for r in rows}
    refers = {1: 2, 6: 7}
    for i, _, html in pages:
        data = (html or "").encode()
        assert got[i] == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if i in refers else "response", refers.get(i))
    keys = [(r.url_key.encode(), r.time, r.id) for r in rows]
    assert keys == sorted(keys)
    assert warc.capture_index(warc.captures_of(df.where("false"))).count() == 0


def test_warc_of_pages(spark, sf_dir):
    pages = {r.page_id: (r.html or "").encode() for r in queries.table(spark, sf_dir, "pages").collect()}
    newest = {}
    for i, data in pages.items():
        if len(data) >= 1000:
            newest[data] = max(i, newest.get(data, i))
    rows = queries.op1_warc(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        data = pages[r.page_id]
        refers = newest.get(data) if newest.get(data, r.page_id) != r.page_id else None
        assert (r.payload_bytes, r.payload_digest, r.refers_to, r.record_type) == (len(data), hashlib.sha1(data).hexdigest(), refers, "revisit" if refers is not None else "response")


@pytest.mark.parametrize("width", [1, 3, 40])
def test_runs_merge_by_their_slices(spark, width, monkeypatch):
    """Sorted runs with ties, repeats, null ids and one key that holds a third of all rows."""
    rng = np.random.default_rng(width)
    rows = []
    for run in range(6):
        mine = [(f"run{run}", "hot" if rng.random() < 0.33 else f"k{rng.integers(0, 9)}é", f"2024-01-0{rng.integers(1, 4)}", int(rng.integers(0, 50)) if rng.random() < 0.9 else None, 1, "s", "response", None, o, 1) for o in range(100)]
        rows += sorted(mine, key=warc._order)
    runs = spark.createDataFrame(rows, warc.RUN).coalesce(2)
    merged = [tuple(r) for r in warc.merge_runs(runs, width).collect()]
    assert merged == sorted(rows, key=warc._order)
    # only packed slices are put in order by Spark: no more than a row for each run and range
    slices = runs.mapInArrow(warc._cut_runs(warc.range_bounds(runs, width)), warc.SLICES).count()
    assert slices <= 6 * width
    assert warc.range_bounds(runs.where("false"), width) == []


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8])
def test_loser_tree(k):
    rng = np.random.default_rng(k)
    runs = [sorted(rng.integers(0, 50, rng.integers(0, 20)).tolist()) for _ in range(k)]
    assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


# --- top k ------------------------------------------------------------------------------------------


def test_topk(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in queries.table(spark, sf_dir, "embeddings").collect()}
    got = {}
    for r in sorted(queries.op9_topk(spark, sf_dir).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == R.top_k(vectors)


@pytest.mark.parametrize("block,group", [(4, 2), (64, 64)])
def test_topk_odd_vectors(spark, block, group):
    rng = np.random.default_rng(9)
    vectors = {i: [float(x) for x in rng.choice([-1.5, -0.1, 0.0, 0.1, 0.7], 3)] for i in range(120)}
    vectors |= {200: None, 201: [None, 1.0, 2.0], 202: [float("nan"), 0.0, 0.0], 203: [float("inf"), 0.0, 0.0], 250: [1.0, 2.0], 204: [], 300: [0.5, 0.5]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    rows = topk.rounded_vectors(df, "vec_id", "embedding")
    got = {}
    for r in sorted(topk.top_k(rows, rows.where("id % 50 = 0"), 5, block, group).collect(), key=lambda r: (r.query, r["rank"])):
        got.setdefault(r.query, []).append((r.id, r.score))
    vectors.pop(204)
    single = {i: v if v is None else [None if x is None else float(np.float32(x)) for x in v] for i, v in vectors.items()}
    assert got == {q: w for q, w in R.top_k(single).items() if w}
    nothing = rows.where("false")
    assert topk.top_k(nothing, nothing).count() == 0


def test_topk_of_repeated_ids(spark):
    """A query's own row is no candidate, other rows of its id are; each row of an id is a query of its own."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [0.5, 0.5]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<float>")
    numbered = topk.rounded_vectors(df, "vec_id", "v")
    found = topk.top_k(numbered, numbered.where("id % 50 = 0"), 2).collect()
    want = []
    for k, (q, v) in enumerate(rows):
        if q == 50:
            scores = sorted((-int(256 * 256 * (v[0] * w[0] + v[1] * w[1])), i) for j, (i, w) in enumerate(rows) if i is not None and j != k)
            want += [(q, n + 1, i, -x) for n, (x, i) in enumerate(scores[:2])]
    assert sorted(map(tuple, found)) == sorted(want)


# --- extra columns ------------------------------------------------------------------------------------

CLASH = ["id", "row", "block", "part", "body", "fp", "component", "kept", "spans", "base", "score", "offending", "rank", "v", "length", "piece", "crc", "sequence", "size", "copies", "target", "_q_key", "_p_row", "_t_text", "name", "u", "start", "stays"]


@pytest.mark.parametrize(
    "make",
    [
        lambda d: packing.pack(d, queries.tokenizer_path("word_bpe_49k.json")).select("id", "piece", "length", "crc"),
        lambda d: mixing.mix(d, ["doc_id"]).select("doc_id", "size", "target", "copies"),
        lambda d: simhash.near_duplicates(d),
        lambda d: simhash.distinct_documents(d).select("doc_id", "text"),
        lambda d: pii.personal_data(d, carry=["doc_id"]).select("doc_id", pii.listed("spans").alias("s")),
        lambda d: suffixes.without_repeats(d, with_bytes=False).select("id", "n_removed", "kept_sha256"),
        lambda d: token_counts.token_counts(d, queries.tokenizer_path("piece_bpe_32k.model")),
        lambda d: quality.quality_rules(d, carry=["doc_id"]),
        lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([(4, 1), (5, 0)], "doc_id long, toxic int"), carry=["doc_id"]).select("doc_id", "score"),
    ],
)
def test_extra_columns_do_not_matter(docs, make):
    more = docs.select("*", *(F.lit("x").alias(c) for c in CLASH))
    plain = sorted(map(str, make(docs).collect()))
    assert plain and sorted(map(str, make(more).collect())) == plain


def test_topk_and_warc_with_extra_columns(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], "x", 3, "y") for i in range(60)], "vec_id long, embedding array<float>, id string, row int, v string")
    rows = topk.rounded_vectors(df, "vec_id", "embedding")
    plain = topk.rounded_vectors(df.select("vec_id", "embedding"), "vec_id", "embedding")
    assert sorted(map(tuple, topk.top_k(rows, rows.where("id = 50")).collect())) == sorted(map(tuple, topk.top_k(plain, plain.where("id = 50")).collect()))
    pages = [(1, "http://a.b/", "x" * 1200), (1, "http://a.b/", "x" * 1200), (None, "http://a.b/c", "x" * 1200), (2, None, None), (3, "http://a.b/", "x" * 1200), (4, "u", "é" * 400_000)]
    df = spark.createDataFrame([(*p, "z", "z", "z") for p in pages], "page_id long, url string, html string, id string, sha1 string, run string")
    found = sorted(((r.id or -1, r.type, r.refers, r.n_bytes) for r in warc.capture_index(warc.captures_of(df)).collect()), key=str)
    assert found == sorted([(1, "revisit", 3, 1200), (1, "revisit", 3, 1200), (-1, "revisit", 3, 1200), (2, "response", None, 0), (3, "response", None, 1200), (4, "response", None, 800_000)], key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    from oracle import connection, rows

    got = queries.QUERIES[name](spark, sf_dir)
    cursor = connection(sf_dir).execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, cursor.fetchall())


def test_encoder_equals_the_tokenizer_on_odd_texts():
    """Whole texts of letters, marks, special strings and white space of all kinds, one after another in one memory."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from passagework.llm.packing import _Encoder
    from passagework.llm.queries import tokenizer_path

    path = tokenizer_path("word_bpe_49k.json")
    plain, encoder, pick = Tokenizer.from_file(path), _Encoder(path), random.Random(7)
    odd = [*map(chr, range(0x250)), "\u0301", "\u0308", "\u200b", "\u2009", "\u3000", "\ufeff", "\u8a9e", "\ufb01", "\u1e9e", "</w>", "<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL"]
    known = ["the", "The", "don't", "I'LL", "3.14", "e.g.", "stra\u00dfe", "na\u00efve,", "end.", "a,b"]
    for _ in range(10):
        texts = ["".join(pick.choice(odd) if pick.random() < 0.5 else pick.choice(known) + pick.choice(["", " ", "\n"]) for _ in range(pick.randint(0, 14))) for _ in range(300)]
        for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text
