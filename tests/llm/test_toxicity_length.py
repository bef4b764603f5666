"""Length alone makes no document toxic."""

from __future__ import annotations

import pandas as pd

from passagework.llm import toxicity


def test_long_clean_texts_stay_clean():
    score = toxicity._scorer(toxicity.BIAS, {"vile": 15.0}, None)
    texts = ["A plain sentence. " * 20_000, " .\n" * 20_000, "A plain sentence. " * 20_000 + "This is vile.", ""]
    got = next(score([pd.DataFrame({"_t_text": texts})]))
    assert list(got["score"].round(6)) == [0, 0, round(got["offending"][2][0]["score"], 6), 0]
    assert got["score"][2] >= 0.7 and [len(o) for o in got["offending"]] == [0, 0, 1, 0]
