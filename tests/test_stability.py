from __future__ import annotations

import numpy as np
from conftest import rows

from lexforge.operators import stability, vectors


def test_seed_stability(spark):
    data = {1: [0, 0, 1, 1], 2: [1, 1, 0, 0], 3: [0, 1, 0, 1]}
    got = [(*r[:3], round(r[3], 9)) for r in rows(stability.seed_stability(lambda s: spark.createDataFrame(list(enumerate(data[s])), "item int, label int"), (1, 2, 3)))]
    assert got == [(1, 2, 4, 1.0), (1, 3, 4, -0.5), (2, 3, 4, -0.5)]


def test_subsample_stability(spark):
    rng = np.random.default_rng(1)
    v = [(i, (np.eye(6)[i % 6] + rng.normal(0, 0.03, 6)).tolist()) for i in range(120)]
    got = stability.subsample_stability(spark.createDataFrame(v, "id int, v array<double>"), "id", "v", 6).collect()
    assert [r["trial"] for r in got] == list(range(1, 9))
    assert all(r["ari"] == 1.0 and r["items"] == 108 for r in got)


def test_both_ends_and_examples(spark):
    c = spark.createDataFrame([(i, 3 + i, i / 100) for i in range(30)] + [(99, 2, 1.0)], "label int, n int, coherence double")
    got = [(r["end"], r["place"], r["label"]) for r in vectors.both_ends(c, "label").collect()]
    assert got == [("top", k + 1, 29 - k) for k in range(12)] + [("bottom", k + 1, k) for k in range(8)]
    df = spark.createDataFrame([(1, i, [1.0, i / 10]) for i in range(7)], "label int, id int, v array<double>")
    assert vectors.best_examples(df, "label", "id", "v", 2).collect()[0]["examples"].split("; ")[0] == "3"
