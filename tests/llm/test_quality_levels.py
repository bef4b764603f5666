"""Small groups are judged by the whole language or corpus, not by what other small groups leave."""

from __future__ import annotations

import numpy as np

from passagework.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, mark: str = "") -> str:
    return " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) + mark for _ in range(60))


def test_small_groups_use_the_whole_level(spark):
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng), "fr", "src0", 1) for i in range(300)]
    # a small group of a large language, and one of a small language; one outlier in each
    rows += [(1000 + i, prose(rng, "##" if i == 0 else ""), "fr", "src7", 1) for i in range(15)]
    rows += [(2000 + i, prose(rng, "##" if i == 0 else ""), "xx", "src1", 1) for i in range(5)]
    # 250 rows, of which too few have enough words to enter an estimate
    rows += [(3000 + i, "few words", "de", "src2", 1) for i in range(240)]
    rows += [(4000 + i, prose(rng, "##" if i == 0 else ""), "de", "src2", 1) for i in range(10)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, DOCS), carry=["doc_id"]).collect()}
    assert len(got) == len(rows)
    assert {i for i, r in got.items() if not r.kept and not r.base_failed} == {1000, 2000, 4000}


def test_a_concentration_step_is_one_pass_and_writes_nothing(spark, monkeypatch):
    import math

    import numpy as np

    rng = np.random.default_rng(6)
    given = [(k, *(int(x) for x in rng.integers(0, 3 * quality.UNIT, 4))) for k in "ab" for _ in range(60)]
    rows = spark.createDataFrame(given, ["_q_key", *quality.VECTOR])
    now = quality.estimates(quality.moments(rows, "_q_key"), 1.0).persist()
    before = {r["_q_key"]: r for r in now.collect()}
    monkeypatch.setattr(quality, "settle", lambda *_: 1 / 0)
    found = {r["_q_key"]: r for r in quality.step(rows, now, 0.6).collect()}
    assert set(found) == {"a", "b"}
    for k, e in before.items():
        mine = np.array([r[1:] for r in given if r[0] == k]) / quality.UNIT
        factor = np.array([[e[f"l_{i}_{j}"] if j <= i else 0.0 for j in range(4)] for i in range(4)])
        d2 = (np.linalg.solve(factor, (mine - [e[f"mu_{i}"] for i in range(4)]).T) ** 2).sum(axis=0)
        bins = np.floor(np.log2(d2 + 1) * quality.BINS)
        inside = mine[bins <= np.sort(bins)[math.ceil(60 * 0.6) - 1]]
        assert found[k]["m_n"] == len(inside) and found[k]["_q_before"] == e["log_det"]
        assert np.allclose([found[k][f"mu_{i}"] for i in range(4)], inside.mean(axis=0))
