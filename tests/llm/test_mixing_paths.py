"""Raking as arrays and as DataFrames: the same rounds and the same stop."""

import numpy as np

from tidemark.llm import mixing


def test_both_paths_stop_alike(spark, monkeypatch):
    rows = [("a", "x", 40), ("b", "x", 30), ("b", "y", 20), ("a", "y", 10)]
    cells = spark.createDataFrame(rows, "source string, lang string, tokens long")
    tokens, codes = np.array([r[2] for r in rows]), [np.array([0, 1, 1, 0]), np.array([0, 0, 1, 1])]
    targets = [np.array([0.6, 0.4]), np.array([0.3, 0.7])]
    share = lambda names, t: spark.createDataFrame(list(zip(names, map(float, t))), "value string, share double")
    goals = {"source": share("ab", targets[0]), "lang": share("xy", targets[1])}
    saves, save = [], mixing.save
    monkeypatch.setattr(mixing, "save", lambda df, name: saves.append(name) or save(df, name))
    got = {(r["source"], r["lang"]): r["raked"] for r in mixing.rake_frame(cells, ("source", "lang"), goals)[0].collect()}
    want, worst = mixing.rake(tokens, codes, targets)
    assert worst < 1e-12
    assert all(abs(got[r[0], r[1]] - w) < 1e-9 for r, w in zip(rows, want))
    assert len(saves) < 40  # it stops once the margins are met
    assert mixing.rake_frame.__defaults__ == (mixing.ROUNDS, mixing.TOLERANCE)


def test_raking_that_cannot_converge_says_so(spark):
    """Targets that contradict one another where cells are empty: one source in one language alone."""
    rows = [(i, "a b c", "s1" if i % 2 else "s2", "x" if i % 2 else "y", "t") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": {"s1": 0.9, "s2": 0.1}, "lang": {"x": 0.2, "y": 0.8}, "topic": {"t": 1.0}}
    bad = mixing.mix(docs, targets=targets).first()
    assert bad["raking_error"] > 0.1
    good = mixing.mix(docs, targets=targets | {"lang": {"x": 0.9, "y": 0.1}}).first()
    assert good["raking_error"] < 1e-12
