"""Lemmas dealt into slices obey the rules of whole ones."""

from __future__ import annotations

import numpy as np

from lexforge.operators import cluster


def found(spark, v, rows_in_slice):
    df = spark.createDataFrame([("w", i, x.tolist()) for i, x in enumerate(v)], "lemma string, row bigint, v array<double>")
    got = {r["row"]: (r["sense_id"], r["silhouette"]) for r in cluster.induce_senses(df, "lemma", "row", "v", rows_in_slice).collect()}
    assert len(got) == len(v)
    return np.array([got[i][0] for i in range(len(v))]), {got[i][1] for i in range(len(v))}


def test_hot_lemma_without_structure(spark):
    v = np.random.default_rng(1).normal(size=(300, 64))
    assert set(cluster.senses_of(v)[0].tolist()) == {0}
    labels, s = found(spark, v, 50)
    assert set(labels.tolist()) == {0}
    assert s == {None}


def test_hot_lemma_of_many_senses(spark):
    rng = np.random.default_rng(2)
    at = np.concatenate([np.repeat(np.arange(9), [60, 50, 40, 30, 25, 20, 15, 8, 2])])
    v = np.eye(12)[at] + rng.normal(0, 0.04, (len(at), 12))
    want, score = cluster.senses_of(v)
    labels, s = found(spark, v, 60)
    assert len(set(labels.tolist())) == 6
    assert (labels == want).all()
    assert len(s) == 1
    assert abs(s.pop() - score) < 1e-9


def test_merging_of_means_is_average_linkage():
    rng = np.random.default_rng(3)
    v = cluster._unit(np.abs(rng.normal(size=(120, 5))))
    for height in (0.05, 0.15, 0.3, 2.0):
        want = cluster.cut(cluster.linkage(v, "average"), len(v), height=height)
        got = cluster.merge_means(v, np.ones(len(v)), height)
        assert {frozenset(np.flatnonzero(got == x).tolist()) for x in set(got.tolist())} == {frozenset(np.flatnonzero(want == x).tolist()) for x in set(want.tolist())}
    assert cluster.merge_means(v[:1], np.ones(1), 0.5).tolist() == [0]
