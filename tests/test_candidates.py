from __future__ import annotations

import difflib

import numpy as np
from pyspark.sql import functions as F

from lexforge.operators import lexicon
from lexforge.operators.candidates import Chunk
from lexforge.plans import reference


def slow(asked, dictionary):
    """The rule over all pairs, one by one."""
    out = {}
    for i, _, words, text in asked:
        best = None
        for syn, _, lemmas, definition in dictionary:
            a, b = set(words), set(lemmas)
            if not a & b:
                continue
            o, r = len(a & b) / len(a | b), difflib.SequenceMatcher(None, text, definition).ratio()
            tier = 0 if text == definition else 1 if r >= 0.6 else 2
            found = (tier, -r if tier == 1 else 0.0, -o, -r, syn)
            best = found if best is None or found < best else best
        out[i] = (best[4], ("exact_gloss", "gloss+lemma", "lemma_set")[best[0]]) if best else (None, "unresolved")
    return out


def test_resolve_against_all_pairs(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["a", "of", "the", "gift", "guest", "harbour", "shield", "ὁ", "ξένος", "oarmaker", "mast", "to"]
    text = lambda n: " ".join(rng.choice(vocabulary, int(rng.integers(1, n))))
    asked = [(i, "n", g.split(), g) for i in range(150) for g in [text(9)]] + [(900, "n", ["gift"], "gift " * 40 + "x"), (901, "n", ["zz"], "zz")]
    dictionary = [(f"s{i:03d}", "n", g.split(), g) for i in range(200) for g in [text(30)]]
    want = slow(asked, dictionary)
    assert {m for _, m in want.values()} == {"exact_gloss", "gloss+lemma", "lemma_set", "unresolved"}
    a = spark.createDataFrame(asked, "id int, pos string, words array<string>, gloss string")
    d = spark.createDataFrame(dictionary, "synset string, pos string, lemmas array<string>, definition string")
    assert {r["id"]: (r["synset"], r["id_match"]) for r in lexicon.resolve_synsets(a, d).collect()} == want


def test_common_subsequence_of_long_texts():
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(0, 200, 40)] + ["a" * 64, "b" * 65, ""]
    chunk = Chunk([("n", ["w"], t, i) for i, t in enumerate(texts)])
    for a in (texts[0], texts[1], "a" * 130, "zz"):
        for b, got in zip(texts, chunk.common(a, np.arange(len(texts))).tolist(), strict=True):
            row = [0] * (len(b) + 1)
            for x in a:
                row, old = [0], row
                for j, y in enumerate(b):
                    row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
            assert got == row[-1]


def test_query_takes_all_words(spark, tmp_path):
    lemmas = [(1, "a thing given"), (2, "harbour of merchants and travellers, the old gate"), (3, "zz")]
    frames = [(10, "A thing given."), (11, "yy, gate"), (12, "merchants")]
    spark.createDataFrame(lemmas, "lemma_id bigint, lsj_glosses string").withColumn("greek_lemma", F.lit("x")).write.parquet(f"{tmp_path}/lemmas.parquet")
    spark.createDataFrame(frames, "row_id bigint, gloss string").write.parquet(f"{tmp_path}/lemma_frames.parquet")
    got = {r["id"]: (r["synset"], r["id_match"]) for r in reference.resolved_synsets(spark, str(tmp_path)).collect()}
    assert got == {1: (10, "exact_gloss"), 2: (12, "lemma_set"), 3: (None, "unresolved")}


def test_few_texts_are_compared_whole(monkeypatch):
    rng = np.random.default_rng(9)
    roots = ["barley", "deck", "cellar", "lamp", "debt", "hawk", "mouth", "rain", "weaver", "seed", "paint", "fold", "hearth", "singer", "stag", "ὁδός", "ξένος", "wave"]
    word = lambda: "".join(rng.choice(roots, 2))
    text = lambda n: " ".join(["the", *(word() for _ in range(n))])
    dictionary = [("n", t.split(), t, i) for i in range(3000) for t in [text(int(rng.integers(1, 9)))]] + [("n", ["the"], None, 9000), ("n", ["the"], "the " * 60, 9001)]
    near = dictionary[17][2].replace("a", "e", 1) + " of"
    asked = [("n", t.split(), t) for t in [near, "the " * 55 + "x", *(text(int(n)) for n in rng.integers(3, 9, 12))]]
    seen, common = [], Chunk.common
    monkeypatch.setattr(Chunk, "common", lambda self, text, at: seen.append(len(at)) or common(self, text, at))
    chunk = Chunk(dictionary)
    for pos, words, t in asked:
        found = chunk.best(pos, words, t)
        want = None
        for _, lemmas, definition, key in dictionary:
            if definition is None:
                continue
            a, b = set(words), set(lemmas)
            r = difflib.SequenceMatcher(None, t, definition).ratio()
            tier, o = (0 if t == definition else 1 if r >= 0.6 else 2), len(a & b) / len(a | b)
            mine = (tier, -r if tier == 1 else 0.0, -o, -r, key)
            want = mine if want is None or mine < want else want
        assert (found[0], found[3]) == (want[0], want[4])
    assert chunk.best(*asked[0])[0] == 1
    assert sum(seen) < 0.05 * len(asked) * len(dictionary)


def test_bounds_of_many_letters():
    rng = np.random.default_rng(10)
    letters = [chr(0x4E00 + i) for i in range(300)]
    texts = ["w " + "".join(rng.choice(letters[: int(m)], int(n))) for m, n in zip(rng.integers(5, 300, 400), rng.integers(1, 150, 400), strict=True)]
    chunk = Chunk([("n", ["w"], t, i) for i, t in enumerate(texts)])
    for t in texts[:5]:
        at, bound = chunk.bounds(t[:-1] + "x", np.arange(400), 0.0)
        assert (bound >= chunk.common(t[:-1] + "x", chunk.rank[at])).all()
        ratios = [difflib.SequenceMatcher(None, t[:-1] + "x", b).ratio() for b in texts]
        near, _ = chunk.bounds(t[:-1] + "x", np.arange(400), 0.3)
        assert {i for i, r in enumerate(ratios) if r >= 0.3} <= {chunk.keys[x] for x in near}
