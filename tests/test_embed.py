from __future__ import annotations

import time

import numpy as np
from conftest import rows

from lexforge.operators import embed


def test_neighbour_embedding_keeps_groups():
    rng = np.random.default_rng(0)
    group = np.repeat(np.arange(4), 40)
    v = np.eye(30)[group] + rng.normal(0, 0.08, (160, 30))
    y = embed.neighbour_embedding(v, 2, 10, rounds=120)
    assert y.shape == (160, 2) and np.isfinite(y).all()
    at, _ = embed._neighbours(y, 5, "euclidean")
    assert (group[at] == group[:, None]).mean() > 0.97
    assert np.allclose(embed.neighbour_embedding(v, 2, 10, rounds=120), y)
    assert embed.neighbour_embedding(v[:1], 3).shape == (1, 3)
    w = embed._fuzzy(np.sort(rng.random((20, 8)), 1))
    assert np.allclose(w.sum(1), 3, atol=0.05)
    a, b = embed._curve(0.1)
    assert abs(a - 1.577) < 0.05 and abs(b - 0.895) < 0.05  # the published values


def test_subword_vectors_share_stems():
    rng = np.random.default_rng(1)
    sentences = [[["host", "hosts", "hostly"][rng.integers(3)], "guest", "door"] if i % 2 else [["spear", "spears", "spearly"][rng.integers(3)], "shield", "war"] for i in range(400)]
    found = embed.subword_vectors(sentences, 24, 3, 3, 60)
    cos = lambda a, b: float(found[a] @ found[b] / np.linalg.norm(found[a]) / np.linalg.norm(found[b]))
    assert set(found) == {"host", "hosts", "hostly", "guest", "door", "spear", "spears", "spearly", "shield", "war"}
    assert cos("host", "hosts") > cos("host", "spears") + 0.3
    assert embed.subword_vectors([["a"]], least=2) == {}
    assert len(embed.subwords("abc")) == len({"<ab", "abc", "bc>", "<abc", "abc>", "<abc>"})


def test_subword_vectors_put_a_batch_together_once():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(40)]
    sentences = [[words[k] for k in rng.integers(0, 40, 20)] for _ in range(150)]
    at = time.process_time()
    assert len(embed.subword_vectors(sentences, epochs=1)) == 40
    took = time.process_time() - at
    # half of what adding the parts of every pair one by one takes, for about 33 batches of 512 pairs and 27 parts
    rows, into = rng.integers(0, 1 << 16, 512 * 27), np.zeros((1 << 16, 100))
    at = time.process_time()
    for _ in range(33):
        np.add.at(into, rows, np.ones((len(rows), 100)))
    assert took < 0.5 * (time.process_time() - at)


def test_subword_model_of_nothing(spark):
    assert rows(embed.subword_model(spark.createDataFrame([([],), (["a"],)], "tokens array<string>"), dims=4)) == []


def test_correlation_topics_follow_anchors(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(300):
        theme = i % 3
        data += [(i, f"w{theme}{k}") for k in range(6) if rng.random() < 0.6] + [(i, f"n{k}") for k in range(10) if rng.random() < 0.2]
    df = spark.createDataFrame(data + [(900, None)], "i int, term string")
    anchors = spark.createDataFrame([(0, "w10"), (1, "w20"), (2, "w00"), (1, "missing")], "topic int, term string")
    p, terms = embed.anchored_correlation(df, "i", anchors, 3)
    topic = {r["term"]: r["topic"] for r in terms.collect()}
    assert [sum(topic[f"w{w}{k}"] == j for k in range(6)) >= 5 for w, j in ((1, 0), (2, 1), (0, 2))] == [True] * 3
    best = {}
    for r in p.collect():
        best[r["i"]] = max(best.get(r["i"], (-1, 0)), (r["p"], r["topic"]))
    assert np.mean([best[i][1] == {0: 2, 1: 0, 2: 1}[i % 3] for i in best]) > 0.9
    assert embed.anchored_correlation(df.limit(0), "i", anchors)[0].count() == 0
    reduced = embed.reduce_neighbours(spark.createDataFrame([(i, [float(i), 1.0, i % 2 * 1.0]) for i in range(30)] + [(99, None)], "i int, v array<double>"), "i", "v", 2, 5, rounds=20)
    assert len(rows(reduced)) == 30
    model = embed.subword_model(spark.createDataFrame([(["a", "b", None],)] * 4, "tokens array<string>"), dims=4, epochs=1)
    assert [r[0] for r in rows(model)] == ["a", "b"]
