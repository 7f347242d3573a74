from __future__ import annotations

import itertools
from fractions import Fraction

import numpy as np
from conftest import DATA, needs_data, rows

from lexforge.llm import clusters
from lexforge.llm.queries import p4_clusters, p4_found, p4_members


def sets(spark, seed=0, n=120):
    rng = np.random.default_rng(seed)
    data = [(i, sorted(set(rng.choice(14, size=rng.integers(1, 9)).astype(str).tolist()))) for i in range(n)]
    data += [(1000 + i, data[0][1]) for i in range(5)]
    return data, spark.createDataFrame(data, "record_id bigint, content array<string>")


def test_set_links_against_all_pairs(spark):
    data, df = sets(spark)
    classes = clusters.copy_classes(df)
    first = {}
    for i, c in data:
        first[tuple(c)] = min(i, first.get(tuple(c), i))
    for t in (Fraction(3, 5), Fraction(4, 5), Fraction(1)):
        want = set()
        for (ca, a), (cb, b) in itertools.combinations(first.items(), 2):
            inter = len(set(ca) & set(cb))
            if Fraction(inter, len(set(ca) | set(cb))) >= t:
                want.add((min(a, b), max(a, b)))
        for block in (clusters.BLOCK, 3):
            got = clusters.set_links(classes, t, block).select("a", "b").collect()
            assert len(got) == len(want)
            assert {tuple(r) for r in got} == want


def test_vector_links_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    v = rng.random((60, 6)) * 0.08
    v[30:] = v[:30] + rng.uniform(-0.012, 0.012, (30, 6))
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "class_id bigint, content array<double>, members bigint")
    want = {(a, b) for a, b in itertools.combinations(range(60), 2) if np.abs(v[a] - v[b]).max() <= 0.01}
    for block in (clusters.BLOCK, 2):
        assert rows(clusters.vector_links(df, 0.01, block).select("a", "b")) == sorted(want, key=repr)
    assert want


def test_pivots_cover_and_are_linked(spark):
    _, df = sets(spark, 2)
    classes = clusters.copy_classes(df)
    links = clusters.set_links(classes)
    g = clusters.pivot_clusters(classes, links)
    pivot = {r["class_id"]: r["pivot"] for r in g.collect()}
    pairs = {frozenset((r["a"], r["b"])) for r in links.collect()}
    assert len(pivot) == classes.count()
    for x, p in pivot.items():
        assert pivot[p] == p
        assert x == p or frozenset((x, p)) in pairs
    ps = {p for p in pivot.values()}
    assert not any(frozenset(x) in pairs for x in itertools.combinations(ps, 2))


def test_copies_in_full_or_by_their_first(spark):
    df = spark.createDataFrame([(i, ["a", "b", "c"]) for i in range(4)] + [(9, ["a", "b", "c", "d"])], "record_id bigint, content array<string>")
    c = clusters.copy_classes(df)
    links = clusters.set_links(c)
    g = clusters.pivot_clusters(c, links)
    full = rows(clusters.member_pairs(df, c, g, links))
    assert full == sorted([*itertools.combinations(range(4), 2), *[(i, 9) for i in range(4)]], key=repr)
    star = rows(clusters.member_pairs(df, c, g, links, copies_in_full=2))
    assert star == [(0, 1), (0, 2), (0, 3), (0, 9)]
    m = {r["class_id"]: r for r in clusters.medoids(c, g, links).collect()}
    assert rows(clusters.typical_members(clusters.medoids(c, g, links), 1))[0][1] == 0
    assert m[0]["size"] == 5 and abs(m[0]["closeness"] - (4 + 0.75) / 5) < 1e-9


def test_no_links(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "record_id bigint, content array<string>")
    c = clusters.copy_classes(df)
    assert rows(clusters.pivot_clusters(c, clusters.set_links(c))) == [(1, 1), (2, 2)]


@needs_data
def test_empty_and_clashing_columns(spark, empty_dir, wide_dir):
    for q in (p4_found, p4_members, p4_clusters):
        assert q(spark, empty_dir).count() == 0
    assert rows(p4_found(spark, wide_dir)) == rows(p4_found(spark, DATA))
    m = p4_members(spark, DATA)
    assert m.groupBy("record_table", "record_id").count().filter("count > 1").count() == 0
    assert m.groupBy("record_table", "cluster_id", "size").count().filter("count <> size").count() == 0
