"""The pipeline's stages, each on what the one before kept, against plain models."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
import reference as R
from test_corpus_operators import check_packing

import corpus_pipeline
from passagework.llm import mixing, queries, simhash
from passagework.llm.common import settle


def test_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "pii", "mixing", "packing"]
    kept = {"": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir), "test-stage")
        kept[name] = docs
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
    rows = {n: [r.asDict() for r in df.collect()] for n, df in kept.items()}
    given = {r["doc_id"]: r for r in rows[""]}
    after = {r["doc_id"]: r for r in rows["quality_rules"]}
    assert after and all(after[i] == given[i] for i in after)
    assert not any(R.quality(r["text"])["base_failed"] for r in after.values())
    judged = {r.doc_id for r in queries.op10_quality_rules(spark, sf_dir).where("kept").collect()}
    assert set(after) == judged

    ids = sorted(after)
    single = {r["doc_id"]: r for r in rows["simhash_near_dedup"]}
    assert set(single) == {ids[k] for k in R.distinct([(i, after[i]["text"]) for i in ids])}
    assert len(single) < len(after) and all(single[i] == after[i] for i in single)

    clean = {r["doc_id"]: r for r in rows["pii"]}
    assert set(clean) == set(single)
    for i, r in clean.items():
        spans = R.base_spans(single[i]["text"])
        assert (r["text"] == single[i]["text"]) == (not spans)
        assert r["n_chars"] == len(r["text"]) and not any(k == "email" for k, _, _ in R.base_spans(r["text"]))

    copies = Counter(r["doc_id"] for r in rows["mixing"])
    want = {r.doc_id: r.copies for r in mixing.mix(kept["pii"], ["doc_id"]).collect()}
    assert copies == Counter({i: n for i, n in want.items() if n})
    assert all(r == clean[r["doc_id"]] for r in rows["mixing"])

    packed = kept["packing"].collect()
    used = check_packing(packed, [(r["doc_id"], r["text"]) for r in rows["mixing"]])
    assert used <= sum(r.length for r in packed) / 2048 * 1.02 + 1


PROSE = [" ".join("".join(np.random.default_rng(100 * k + i).choice(list("abcdefgh"), 6)) for i in range(80)) for k in range(6)]
#: Repeated and null ids, nulls, exact and near copies, a very long text, clashing names.
ODD = [
    (5, PROSE[0], "en", "a", 1),
    (5, PROSE[0], "en", "a", 1),
    (None, PROSE[0], "en", None, 1),
    (None, PROSE[1], None, "b", None),
    (None, PROSE[1], None, "b", None),
    (7, PROSE[2], "en", "a", 1),
    (7, PROSE[3], "en", "a", 1),
    (8, PROSE[3].replace(PROSE[3].split()[40], "changed"), "en", "a", 1),
    (9, " ".join(PROSE[4].split()[:40] + PROSE[5].split()[:40]), "en", "a", 1),
    (10, PROSE[4] + " mail a@b.example.com", "en", "a", 1),
    (11, None, None, None, None),
    (12, "", "en", "a", 0),
    (13, " ".join(f"w{i}" for i in range(300_000)), "de", "c", 1),
]


def test_odd_rows(spark, sf_dir):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, _s_row string, kept int").repartition(3)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir), "test-stage")
        out[name] = docs.collect()
        if name == "quality_rules":
            assert docs.columns == corpus_pipeline.COLUMNS
    judged = Counter((r.doc_id, r.text) for r in out["quality_rules"])
    assert judged == Counter((i, t) for i, t, *_ in ODD if i not in (11, 12))
    single = sorted((r.doc_id or 0, r.text[:40]) for r in out["simhash_near_dedup"])
    left = [r for r in ODD if r[0] not in (11, 12)]
    want = [left[k] for k in R.distinct([(r[0], r[1]) for r in left])]
    assert single == sorted((r[0] or 0, r[1][:40]) for r in want)
    # of the exact copies one stays each, though ids repeat or are null; equal ids with different texts both stay
    assert [i for i, _ in single if i != 8] == [0, 5, 7, 7, 9, 10, 13]
    assert sum("[EMAIL]" in r.text for r in out["pii"]) == 1 and len(out["pii"]) == len(single)
    check_packing(out["packing"], [(r.doc_id, r.text) for r in out["mixing"]])


def test_distinct_documents_against_all_pairs(spark):
    """Copies with a few changed words, in chains."""
    rng = np.random.default_rng(2)
    texts = []
    for k in range(12):
        words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(150)]
        for _ in range(6):
            texts.append(" ".join(words))
            for at in rng.integers(0, 150, rng.integers(0, 3)):
                words[at] = "".join(rng.choice(list("xyz"), 5))
    rows = [(int(i) if i % 17 else None, t) for i, t in zip(rng.permutation(len(texts)), texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    stays = {(r.doc_id, r.text) for r in simhash.distinct_documents(docs).collect()}
    assert stays == {rows[k] for k in R.distinct(rows)}


def test_a_leaf_is_shuffled_once_for_each_block_but_the_last(spark, monkeypatch):
    """Not once for each two blocks, which would be 36 times."""
    fps = [int(x) for x in np.random.default_rng(4).integers(0, 1 << 62, 90)]
    leaves = spark.createDataFrame([(f, i, i % 9) for i, f in enumerate(fps)], "fp long, id long, trie int")
    dealt = []
    repartition = type(leaves).repartition
    monkeypatch.setattr(type(leaves), "repartition", lambda self, *by: dealt.append(self.count()) or repartition(self, *by))
    simhash.leaf_links(leaves, 7)
    assert dealt == [8 * 90]
    walked = [m for both in simhash.block_masks((1 << 64) - 1, 7).values() for m in both]
    assert len(set(walked)) == 36 and sum(bin(m).count("1") for m in walked) == 64 * 8


def changed_copies(n, seed=6):
    """Copies of one text of 150 words, each with up to 12 words changed, so that many are similar to some of the others alone."""
    rng = np.random.default_rng(seed)
    base = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(150)]
    texts = []
    for _ in range(n):
        words = list(base)
        for at in rng.integers(0, 150, rng.integers(1, 13)):
            words[at] = "".join(rng.choice(list("xyzuvw"), 5))
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("size", [400, 1600])
def test_links_of_a_large_group_stay_in_proportion(spark, size):
    """A leaf gets one link for each time that it is dealt out, not one for each refinement, whatever the size of its group."""
    rng = np.random.default_rng(7)
    centre = int(rng.integers(0, 1 << 62))
    fps = sorted({centre ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(1, 7), replace=False)) for _ in range(size)})
    links = simhash.leaf_links(spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, id long"), 7)
    assert len(fps) - 1 <= links.count() <= 8 * len(fps)
    found = {r.u for r in simhash.components(links).collect()}
    assert found == set(range(1, len(fps)))


def test_a_text_that_is_similar_to_others_than_its_link_goes(spark):
    """Every similar pair of a group counts, also where neither text is the one that the group's links lead to."""
    rows = list(enumerate(changed_copies(250)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    stays = {r.doc_id for r in simhash.distinct_documents(docs).collect()}
    assert stays == set(R.distinct(rows))
    assert 20 < len(stays) < 230


def test_prefix_pairs_against_all_pairs(spark):
    """Whatever the labels, each similar pair of different labels is among the pairs, and no pair of one label."""
    texts = changed_copies(80, 8)
    sets = [sorted(int(h) - (1 << 64) if h >> 63 else int(h) for h in set(simhash.shingle_hashes(t.encode(), 5))) for t in texts]
    label = [k % 7 if k % 3 else 100 + k for k in range(80)]
    unsettled = spark.createDataFrame([(k, k % 2, label[k]) for k in range(80)], "row long, near long, label long")
    table = spark.createDataFrame(list(enumerate(sets)), "row long, shingles array<long>")
    got = {(r.u, r.v) for r in simhash._prefix_pairs(unsettled, table, 0.8).collect()}
    similar = {(a, b) for b in range(80) for a in range(b) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
    apart = {(a, b) for a, b in similar if a % 2 == b % 2 and label[a] != label[b]}
    assert apart and apart <= got
    assert all(a % 2 == b % 2 and label[a] != label[b] for a, b in got)


@pytest.mark.parametrize("most", [simhash.MOST_WORDS, 0])
def test_texts_stay_where_they_are(spark, monkeypatch, most):
    """Neither the texts of linked rows nor those of the rows that stay are shuffled, though no table is small enough to be sent."""
    monkeypatch.setattr(simhash, "MOST_WORDS", most)
    plans = {}
    monkeypatch.setattr(simhash, "settle", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().toString()) and settle(df, name))
    words = [" ".join(f"{k}w{i}" for i in range(100)) for k in range(300)]
    rows = [(i, t + (" tail" if i % 2 else "")) for i, t in enumerate(t for t in words for _ in range(2))] + [(None, words[0]), (1000, words[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs = settle(docs, "test-texts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = simhash.distinct_documents(docs)
        plans["left"] = left._jdf.queryExecution().toString()
        stays = left.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted((r.doc_id, r.text) for r in stays) == [rows[k] for k in R.distinct(rows)]
    assert len(stays) < len(rows) and left.columns == docs.columns
    for name in ("simhash-shingles", "left"):
        assert ("hashpartitioning" in plans[name]) == (most == 0)


def test_pipeline_of_an_empty_table(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir), "test-stage")
    assert docs.count() == 0
