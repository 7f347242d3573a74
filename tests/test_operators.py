from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexforge.operators import classify, cluster, compare, lexicon, metrics, spans, terms, tree, validate, vectors


def test_lemma_gloss_chain(spark):
    entries = spark.createDataFrame([(1, "ξένος", "guest"), (2, "ὅς", "who"), (3, "ὅς", "his"), (4, "ἄϊδος", "x"), (5, "λόγος", "")], "seq bigint, headword string, gloss string")
    asked = spark.createDataFrame([("ξένος",), ("ὅς2",), ("ὅς9",), ("ἄιδος",), ("ὅς0",), ("λόγος",), ("νέος",)], "lemma string")
    more = spark.createDataFrame([("νέος", "young"), ("λόγος", "")], "lemma string, gloss string")
    got = {r["lemma"]: (r["gloss"], r["source"]) for r in lexicon.lemma_gloss(asked, entries, more).collect()}
    assert got == {"ξένος": ("guest", "lsj"), "ὅς2": ("his", "lsj (homograph 2)"), "ὅς9": ("who ; his", "lsj (homographs merged)"), "ὅς0": ("who", "lsj"), "ἄιδος": ("x", "lsj (relaxed match)"), "λόγος": ("", "none"), "νέος": ("young", "agwn")}


def test_resolve_tiers(spark):
    asked = spark.createDataFrame([(1, "n", ["gift"], "a thing given"), (2, "n", ["gift"], 'a thing that is given; "x"'), (3, "n", ["gift", "present"], "zzz"), (4, "v", ["gift"], "x"), (5, "n", ["present"], None)], "id int, pos string, words array<string>, gloss string")
    d = spark.createDataFrame([("g1", "n", ["gift"], "A thing given."), ("g2", "n", ["gift", "present"], "something")], "synset string, pos string, lemmas array<string>, definition string")
    got = {r["id"]: (r["synset"], r["id_match"]) for r in lexicon.resolve_synsets(asked, d).collect()}
    assert got == {1: ("g1", "exact_gloss"), 2: ("g1", "gloss+lemma"), 3: ("g2", "lemma_set"), 4: (None, "unresolved"), 5: ("g2", "lemma_set")}


def test_links_hypernyms_flags(spark):
    wanted = spark.createDataFrame([("A", "a1", 0), ("A", "a2", 1)], "lemma string, form string, form_order int")
    index = spark.createDataFrame([("a2", "n", 0, "n#1", 0), ("a1", "n", 0, "n#1", 1), ("a1", "v", 1, "v#2", 0), ("x", "n", 0, "n#3", 0)], "form string, pos string, pos_order int, synset_id string, id_order int")
    links = lexicon.form_links(wanted, index)
    assert rows(links) == [("A", "a1", "n", "n#1"), ("A", "a1", "v", "v#2")]
    syn = spark.createDataFrame([("n#1", " a  b ", 'say \\"x\\"')], "synset_id string, words string, gloss string")
    assert rows(lexicon.attach_synsets(links, syn).select("synset_id", "english_words", "gloss")) == [("n#1", "a b", 'say "x"'), ("v#2", "", "")]
    flags = spark.createDataFrame([("A", "n#1", "core", "r")], "lemma string, synset_id string, sense_flag string, reason string")
    assert rows(lexicon.flag_synsets(links, flags).select("synset_id", "sense_flag")) == [("n#1", "core"), ("v#2", "noise")]


def test_fetch_missing(spark):
    cache = spark.createDataFrame([("a", True, ["x"], "g", False)], "lemma string, found boolean, semfields array<string>, gloss string, error boolean")
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "lemma string")
    assert rows(lexicon.fetch_missing(wanted, cache).select("lemma", "found", "error")) == [("a", True, False), ("b", False, False)]

    def fails(_):
        raise OSError

    assert rows(lexicon.fetch_missing(wanted, cache, fails).select("lemma", "error")) == [("a", False), ("b", True)]


def test_tree_rules(spark):
    cols = "work string, sentence_id string, word_id int, head int, lemma string, relation string, pos string, case string, voice string, book int, line int, mood string, tense string"
    t = [
        (1, None, "λέγω", "PRED", "v", None),
        (2, 1, "ἀνήρ", "SBJ", "n", "n"),
        (3, 1, "καί", "COORD", "c", None),
        (4, 3, "δῶρον", "OBJ_CO", "n", "a"),
        (5, 3, "φέρω", "OBJ_CO", "v", None),
        (6, 5, "οἶνος", "OBJ", "n", "a"),
        (7, 1, "ἐν", "AuxP", "r", None),
        (8, 7, "οἶκος", "ADV", "n", "d"),
        (9, 7, "πόλις", "ADV", "n", "d"),
        (10, 1, "νύξ", "ADV", "n", "g"),
        (11, 2, "καλός", "ATR", "a", "n"),
        (12, 13, "α", "COORD", "c", None),
        (13, 12, "β", "COORD", "c", None),
    ]
    df = spark.createDataFrame([("W", "s", i, h, l, r, p, c, "a", 1, 1, None, None) for i, h, l, r, p, c in t], cols)
    got = {r["verb_lemma"]: r for r in tree.predicate_arguments(df).collect()}
    a = got["λέγω"]
    assert (a["sbj"], a["obj"], a["voice"], a["n_args"]) == (["ἀνήρ"], ["δῶρον", "οἶνος"], "active", 5)
    assert [tuple(o) for o in a["obliques"]] == [("ἐν", "d", "οἶκος"), (None, "g", "νύξ")]
    assert got["φέρω"]["obj"] == ["οἶνος"]


def test_metrics_properties(spark):
    rng = np.random.default_rng(1)
    data = [(i, int(rng.integers(4)), int(rng.integers(3)), rng.normal(size=5).tolist()) for i in range(80)]
    df = spark.createDataFrame(data, "id int, a int, b int, v array<double>")
    assert metrics.adjusted_rand(df, "a", "a").first()["ari"] == 1.0
    assert abs(metrics.adjusted_mutual_information(df, "a", "a").first()["ami"] - 1) < 1e-9
    assert abs(metrics.adjusted_mutual_information(df, "a", "b").first()["ami"]) < 0.2
    s = metrics.silhouette(df, "a", "v", 5).first()["silhouette"]
    assert abs(s - cluster.cosine_silhouette(np.array([r[3] for r in data]), np.array([r[1] for r in data]))) < 1e-9
    assert metrics.adjusted_rand(df.limit(0), "a", "b").first()["ari"] is None


def test_silhouette_against_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(int(i % 3), rng.normal(size=4).tolist()) for i in range(60)], "a int, v array<double>")
    want = ClusteringEvaluator(distanceMeasure="cosine", featuresCol="f", predictionCol="a").evaluate(df.withColumn("f", array_to_vector("v")))
    assert abs(metrics.silhouette(df, "a", "v", 4).first()["silhouette"] - want) < 1e-9


def naive_average(v: np.ndarray, k: int) -> set[frozenset[int]]:
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    groups = [[i] for i in range(len(v))]
    while len(groups) > k:
        _, a, b = min((np.mean([1 - u[i] @ u[j] for i in g for j in h]), x, y) for x, g in enumerate(groups) for y, h in enumerate(groups) if x < y)
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


def test_linkage_against_naive():
    v = np.random.default_rng(3).normal(size=(18, 4))
    z = cluster.linkage(v, "average")
    for k in (1, 3, 7, 18):
        lab = cluster.cut(z, 18, k)
        assert {frozenset(np.flatnonzero(lab == x).tolist()) for x in set(lab.tolist())} == naive_average(v, k)
    assert np.all(np.diff(cluster.linkage(v, "ward")[:, 2]) >= -1e-9)
    assert len(cluster.linkage(v[:1])) == 0


def test_core_distance_counts_the_point_itself():
    d = np.abs(np.subtract.outer(np.array([0.0, 1.0, 3.0, 7.0]), np.array([0.0, 1.0, 3.0, 7.0])))
    assert cluster.core_distances(d, 1).tolist() == [0, 0, 0, 0]
    assert cluster.core_distances(d, 2).tolist() == [1, 1, 2, 4]
    assert cluster.core_distances(d, 3).tolist() == [3, 2, 3, 6]
    assert cluster.core_distances(d, 9).tolist() == [7, 6, 4, 7]


def test_expected_mutual_information():
    """Against all deals of the labels of one side."""
    from itertools import permutations

    a, b = [0, 0, 0, 1, 1, 2], (0, 0, 1, 1, 1, 2)

    def mutual(x, y):
        n = len(x)
        return sum(c / n * math.log(c * n / (x.count(i) * y.count(j))) for i in set(x) for j in set(y) if (c := sum(p == i and q == j for p, q in zip(x, y, strict=True))))

    deals = [mutual(a, list(p)) for p in permutations(b)]
    assert math.isclose(metrics._expected_mutual([(3, 1), (2, 1), (1, 1)], [(2, 1), (3, 1), (1, 1)]), sum(deals) / len(deals))


def test_nearest_in_groups(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 5))
    v[200:] = v[:100]  # equal vectors: ties go to the lesser id
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "i bigint, v array<double>").repartition(7)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -9)
    want = {(q, j) for q in range(300) for j in np.lexsort((np.arange(300), -s[q]))[:6].tolist()}
    for chunk in (16384, 40):
        got = vectors._topk(df, df, "i", "v", 6, True, chunk)
        by = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "item")
        assert {(r[0], r[1]) for r in got.withColumn("r", F.row_number().over(by)).filter("r <= 6").collect()} == want
    assert {(r[0], r[1]) for r in vectors.nearest(df, df, "i", "v", 6).collect()} == want
    assert vectors.nearest(df.limit(0), df, "i", "v", 6).count() == vectors.nearest(df, df.limit(0), "i", "v", 6).count() == 0


def test_form_driven_and_shuffled(spark):
    data = [(i // 20, ("alpha" if i < 20 else "bcdfgh"[i % 6] * 2) + f"{i % 13:02d}{'kz'[i % 2]}") for i in range(60)]
    df = spark.createDataFrame(data, "c int, f string")
    got = {r["c"]: r["form_driven"] for r in metrics.form_driven(df, "c", "f", 15).collect()}
    assert got[0] and len(got) == 3
    e = spark.createDataFrame([(i % 3, (np.eye(3)[i % 3] + i / 1000).tolist()) for i in range(30)], "l int, v array<double>")
    real, shuffled = metrics.silhouette(e, "l", "v", 3).first(), metrics.shuffled_silhouette(e, "l", "v", 3).first()
    assert real["items"] == shuffled["items"] == 30
    assert real["silhouette"] > 0.9 > 0.3 > shuffled["silhouette"]


def test_factorisation_is_refused_before_it_is_collected(spark):
    w = spark.createDataFrame([(i, f"t{i}", 1.0) for i in range(30)], "d int, term string, weight double")
    with pytest.raises(ValueError, match="too large"):
        terms.nmf_topics(w, "d", 2, documents=20)


def test_factorisation_takes_any_number_of_terms(spark):
    rng = np.random.default_rng(5)
    theme = lambda i: rng.choice(7000, 7000, False) + 7000 * (i % 3)
    entries = {(i, int(j)): 1.0 + rng.random() for i in range(12) for j in theme(i)}
    table = pa.table({"d": [f"w{i:02d}" for i, _ in entries], "term": [f"t{j:05d}" for _, j in entries], "weight": list(entries.values())})
    w = spark.createDataFrame(table)
    d, t = (np.array(x) for x in zip(*entries, strict=True))
    want_w, want_h = terms.factorise(d, t, np.array(list(entries.values())), 12, 21000, 3)
    for parts in (1, 4):  # 21,000 terms, dealt out to as many tasks
        a, b = terms.nmf_topics(w, "d", 3, parts=parts)
        got_w, got_h = np.zeros((12, 3)), np.zeros((3, 21000))
        for r in a.collect():
            got_w[int(r["d"][1:]), r["topic"]] = r["weight"]
        for r in b.collect():
            got_h[r["topic"], int(r["term"][1:])] = r["weight"]
        assert np.allclose(got_w, want_w, atol=1e-6) and np.allclose(got_h, want_h, atol=1e-6)
    assert [x.count() for x in terms.nmf_topics(w.limit(0), "d", 2)] == [0, 0]
    assert [x.count() for x in terms.nmf_topics(w.limit(1), "d", 1, parts=3)] == [1, 1]  # blocks without terms


def test_elements_hold_tokens_and_frames_hold_elements(spark):
    t = spark.createDataFrame([(1, 1, 0, 3), (1, 2, 5, 9), (1, 3, 11, None)], "s int, token_pos int, start int, end int")
    e = spark.createDataFrame([(1, 7, 4, 9), (1, 8, 0, 8), (1, 9, None, 3)], "s int, fe_id int, start int, end int")
    assert rows(spans.contained_tokens(t, e, "s")) == [(1, 7, 2), (1, 8, 1)]
    f = spark.createDataFrame([("F", ["A", "B"]), ("F", ["C"]), ("G", [])], "frame string, fes array<string>")
    x = spark.createDataFrame([(1, "F", "A"), (2, "F", "C"), (3, "F", "Z"), (4, "G", "A"), (5, "H", "A"), (6, "F", None)], "id int, frame string, fe string")
    assert rows(validate.element_violations(x, f).select("id")) == [(3,), (4,)]
    u = spark.sql("SELECT 'F' AS frame, array(named_struct('lemma', 'Guest', 'pos', 'n', 'gloss', ''), null) AS lexical_units")
    assert rows(validate.search_units(u, "^gue")) == [("F", "Guest", "n")]


def test_density_and_communities():
    rng = np.random.default_rng(4)
    v = np.vstack([rng.normal(0, 0.1, (30, 2)), rng.normal(5, 0.1, (30, 2)), [[50, 50]]])
    lab = cluster.density_labels(v, 5, 3)
    assert len(set(lab[:30]) - {-1}) >= 1
    assert not set(lab[:30]) & set(lab[30:60]) - {-1}
    assert lab[60] == -1
    assert (cluster.density_labels(v[:3], 5, 1) == -1).all()
    edges = [(i, j, 1.0) for g in (range(5), range(5, 10)) for i in g for j in g if i < j] + [(0, 5, 0.1)]
    found = cluster.leiden(edges, 1.0)
    assert len({found[i] for i in range(5)}) == len({found[i] for i in range(5, 10)}) == 1
    assert found[0] != found[5]


def test_communities_are_connected_and_good():
    rng = np.random.default_rng(3)
    group = rng.integers(0, 6, 150)
    edges = [(i, j, 1.0) for i in range(150) for j in range(i) if rng.random() < (0.3 if group[i] == group[j] else 0.02)]

    def quality(lab):
        m = sum(w for *_, w in edges)
        degree, inside = {}, 0.0
        for a, b, w in edges:
            inside += w * (lab[a] == lab[b])
            for x in (a, b):
                degree[lab[x]] = degree.get(lab[x], 0.0) + w
        return inside / m - sum((v / (2 * m)) ** 2 for v in degree.values())

    found = cluster.leiden(edges, 1.0)
    assert cluster.leiden(edges, 1.0) == found
    assert quality(found) >= quality(dict(enumerate(group.tolist()))) - 0.01
    near = cluster._neighbours(edges)
    for c in set(found.values()):
        nodes = {x for x in found if found[x] == c}
        reached, todo = set(), [min(nodes)]
        while todo:
            x = todo.pop()
            if x not in reached:
                reached.add(x)
                todo += [y for y in near[x] if y in nodes]
        assert reached == nodes
    sizes = [list(found.values()).count(c) for c in range(len(set(found.values())))]
    assert sizes == sorted(sizes, reverse=True)
    assert len(set(cluster.leiden(edges, 5.0).values())) > len(sizes)
    assert cluster.leiden([]) == {}


def test_factors_of_a_product():
    rng = np.random.default_rng(1)
    w, h = rng.random((40, 3)) * (rng.random((40, 3)) < 0.5), rng.random((3, 30)) * (rng.random((3, 30)) < 0.5)
    x = w @ h
    d, t = np.nonzero(x)
    a, b = terms.factorise(d, t, x[d, t], 40, 30, 3, 500)
    assert (a >= 0).all() and (b >= 0).all()
    assert np.linalg.norm(x - a @ b) < 0.05 * np.linalg.norm(x)
    u, s, v = terms._svd(d, t, x[d, t], 40, 30, 3)
    assert np.allclose(s, np.linalg.svd(x)[1][:3]) and np.allclose(np.abs(u.T @ u), np.eye(3), atol=1e-6)
    assert all(m.shape[i] == 3 for m, i in zip(terms.factorise(d[:1], t[:1], x[d, t][:1], 40, 30, 3, 5), (1, 0), strict=True))


def test_senses(spark):
    rng = np.random.default_rng(5)
    two = [("w", i, (np.eye(4)[i % 2] + rng.normal(0, 0.05, 4)).tolist()) for i in range(40)]
    few = [("r", 100 + i, [1.0, 0.0, 0.0, float(i)]) for i in range(5)]
    df = spark.createDataFrame([*two, *few, ("n", 200, None)], "lemma string, row bigint, v array<double>")
    for rows_in_slice in (4000, 15):
        got = {(r["lemma"], r["row"]): r["sense_id"] for r in cluster.induce_senses(df, "lemma", "row", "v", rows_in_slice).collect()}
        assert len(got) == 45
        assert len({got["w", i] for i in range(40)}) == 2
        assert all(got["w", i] == got["w", i % 2] for i in range(40))
        assert {got["r", 100 + i] for i in range(5)} == {0}


def test_nearest_with_equal_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "id bigint, v array<double>")
    got = rows(vectors.nearest(df, df, "id", "v", 1).select("query", "item"))
    assert got == [(1, 2), (2, 1), (3, 1)]


def test_top_component_removal(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(50, 4)) * [10, 5, 1, 1] + 3
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, v array<double>")
    got = np.array([r["v"] for r in vectors.remove_top_components(df, "id", "v", 4, 2).orderBy("id").collect()])
    c = x - x.mean(0)
    vt = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.allclose(got, c - c @ vt.T @ vt, atol=1e-6)


def test_names_skip_contained_terms(spark):
    s = spark.createDataFrame([(1, "gift", 3.0), (1, "gift host", 2.0), (1, "hearth", 1.0), (2, "x", 0.0)], "c int, term string, score double")
    assert rows(terms.name_clusters(s, "c")) == [(1, "gift, hearth"), (2, "(unnamed)")]
    many = [(7, f"a{'b' * i}", 100.0 - i) for i in range(60)] + [(7, x, 1.0) for x in ("x", "y", "z")] + [(None, "q", 2.0)]
    s = spark.createDataFrame(many, "c int, term string, score double")
    assert rows(terms.name_clusters(s, "c")) == [(7, "a, x, y, z"), (None, "q")]


def test_compare_and_validate(spark):
    a = spark.createDataFrame([(1, "λ", "primary", "F"), (2, "λ", "alternative", "G")], "row_id int, greek_lemma string, assignment string, frame string")
    b = spark.createDataFrame([(1, "λ", "primary", "H"), (2, "μ", "alternative", "G")], "row_id int, greek_lemma string, assignment string, frame string")
    got = {r["greek_lemma"]: (r["same_primary"], r["only_a"], r["only_b"], r["overlap"]) for r in compare.compare_runs(a, b, {"H": "F"}).collect()}
    assert got == {"λ": (True, "F; G", "H", 0.0), "μ": (True, "", "G", 0.0)}
    spans = spark.createDataFrame([(1, "abc", 0, 1, "ab"), (2, "abc", 0, 1, "abc"), (3, None, 0, 1, "x"), (4, "abc", None, None, None)], "id int, text string, start int, end int, span_text string")
    assert [r["id"] for r in validate.span_violations(spans).orderBy("id").collect()] == [2, 3]
    x = spark.createDataFrame([(1, "F", "existing (v1)", ["b", "a"]), (2, "F", "Existing", ["a"]), (3, "Z", "existing", []), (4, "Z", "proposed", [])], "row_id int, frame string, status string, core_fes array<string>")
    known = spark.createDataFrame([("F", ["a", "b"])], "frame string, core_fes array<string>")
    assert rows(validate.frame_violations(x, known)) == [(2, "F", "core FEs differ"), (3, "Z", "unknown frame")]


def test_gate(spark):
    s = spark.createDataFrame([(1, 1, "c", 0.8, 0.7), (1, 2, "c", 0.3, 0.0), (2, 3, "c", 0.5, 0.1), (3, 4, "c", 0.5, 0.1)], "entry int, sense int, category string, pos double, neg double")
    seeds = spark.createDataFrame([(2, "c")], "entry int, category string")
    got = {r["entry"]: (r["method"], round(r["margin"], 6)) for r in classify.sense_gate(s, seeds).collect()}
    assert got == {1: ("embedding", 0.3), 2: ("seed", 0.4)}


def test_affix_null(spark):
    df = spark.createDataFrame([(i % 3, f"{'ab' if i % 3 else 'cd'}xx{i:03d}") for i in range(60)], "c int, f string")
    got = metrics.affix_null(df, "c", "f", 20).collect()
    assert len(got) == 3
    assert all(0 < r["prefix_null"] <= 1 for r in got)


def test_modularity_bounds(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0)], "src int, dst int, weight double")
    lab = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "i int, l int")
    assert math.isclose(metrics.modularity(e, lab, "i", "l").first()[0], 0.5)


def test_sample_is_stable(spark):
    df = spark.range(2000)
    a, b = (rows(metrics.sample_rows(df, "id", 0.9, 3)) for _ in range(2))
    assert a == b
    assert len(a) == 1800
    other = metrics.sample_rows(df, "id", 0.9, 4)
    assert other.count() == 1800
    assert other.join(metrics.sample_rows(df, "id", 0.9, 3), "id").count() < 1800
    assert metrics.sample_rows(df.limit(0), "id").count() == 0 and metrics.sample_rows(df.limit(1), "id").count() == 0 and metrics.sample_rows(df, "id", 1.0).count() == 2000
    assert df.select(F.max("id")).first()[0] == 1999


def test_ranks_over_many_partitions(spark):
    df = spark.createDataFrame([(f"t{i:03d}", i % 7) for i in range(300)], "term string, n int").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [(r["term"], r["n"], r["rank"]) for r in terms.vocabulary(df, least=1).orderBy("rank").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = sorted(((f"t{i:03d}", i % 7) for i in range(300) if i % 7 >= 1), key=lambda x: (-x[1], x[0]))
    assert got == [(t, n, k + 1) for k, (t, n) in enumerate(want)]
    assert terms.vocabulary(df.limit(0)).count() == 0
