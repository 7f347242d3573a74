from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import DATA, needs_data, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import packing, subjects, tokens
from lexforge.llm.queries import p7_ids, p8_fill, p8_packs, p9_composition, p9_found

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def enc():
    return tokens.ForcedBoundaryEncoder()


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet=" \n\t'’sdtvrelmEl0a1áβ́ .,!?-—  　漢🐎", max_size=40)), max_size=6))
def test_ids_equal_the_whole(enc, texts):
    assert enc.ids(pa.array(texts, pa.string())).to_pylist() == [enc.encode(x or "") for x in texts]
    assert enc.counts(pa.array(texts, pa.string())).to_pylist() == [len(enc.encode(x or "")) for x in texts]


def test_special_strings_contractions_and_long_text(enc):
    for x in ("<|endoftext|>", "don't we'll I've '' 's!!!'s", "a" * 50_000, " " * 5000 + "x", ("Wort " * 20_000), "\r\n\r\n"):
        assert enc.ids(pa.array([x]))[0].as_py() == enc.encode(x)


def test_memo_may_be_cleared(enc, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 3)
    x = pa.array(["one two three four five", "six seven"])
    assert enc.ids(x).to_pylist() == enc.ids(x).to_pylist()


@needs_data
def test_against_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = dict(zip(*[pq.read_table(f"{DATA}/documents.parquet")[c].to_pylist() for c in ("doc_id", "text")], strict=True))
    got = {r["doc_id"]: r["ids"] for r in p7_ids(spark, DATA).collect()}
    assert got == {d: t.encode(x, add_special_tokens=False).ids if x else [] for d, x in texts.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60), st.integers(20, 40))
def test_packs_hold_their_capacity(sizes, cap):
    s = np.array(sizes, np.int64)
    p = packing.sum_of_squares(s, cap)
    q = packing.merge_open(p, s, cap)
    for x in (p, q):
        assert len(x) == len(s)
        if len(s):
            assert np.bincount(x, weights=s).max() <= cap
    assert len(set(q.tolist())) <= len(set(p.tolist()))


def slow_sum_of_squares(sizes, cap):
    levels, packs, fill = [0] * (cap + 1), [], []
    for s in sizes:
        best = None
        for h in range(cap - s, -1, -1):
            if h and not levels[h]:
                continue
            after = levels[:]
            if h:
                after[h] -= 1
            if h + s < cap:
                after[h + s] += 1
            cost = sum(x * x for x in after[1:cap])
            if best is None or cost < best[0]:
                best = (cost, h, after)
        levels = best[2]
        packs.append((best[1], s))
        fill.append(best[1] + s)
    return fill


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=30))
def test_levels_are_those_of_the_rule(sizes):
    p = packing.sum_of_squares(np.array(sizes, np.int64), 12)
    at, fill = {}, []
    for i, s in zip(p.tolist(), sizes, strict=True):
        at[i] = at.get(i, 0) + s
        fill.append(at[i])
    assert fill == slow_sum_of_squares(sizes, 12)


def test_items_whole_or_in_parts(spark):
    items = spark.createDataFrame([(1, 25), (2, 4), (3, 0), (4, None), (5, 10), (6, 6)], "item_id bigint, size bigint")
    packs = spark.createDataFrame([("ten", 10), ("none", 0), (None, 5)], "pack_name string, capacity int")
    got = packing.pack_items(items, packs).collect()
    assert sorted((r["item_id"], r["part"], r["start"], r["size"]) for r in got) == [(1, 1, 0, 10), (1, 2, 10, 10), (1, 3, 20, 5), (2, 1, 0, 4), (5, 1, 0, 10), (6, 1, 0, 6)]
    assert packing.pack_items(items.limit(0), packs).count() == 0


@needs_data
def test_every_token_is_packed_once(spark):
    lengths = {r["doc_id"]: len(r["ids"]) for r in p7_ids(spark, SMALL).collect()}
    seen: dict = {}
    for r in p8_packs(spark, SMALL).collect():
        seen.setdefault((r["pack_name"], r["doc_id"]), []).append((r["part"], r["start"], r["size"]))
    assert {d for _, d in seen} == {d for d, n in lengths.items() if n}
    for (_, d), parts in seen.items():
        parts.sort()
        assert [p for p, *_ in parts] == list(range(1, len(parts) + 1))
        assert [s for _, s, _ in parts] == list(np.cumsum([0] + [n for *_, n in parts[:-1]]))
        assert sum(n for *_, n in parts) == lengths[d]
    assert all(r["fill"] > 0.97 for r in p8_fill(spark, SMALL).collect())


def test_sentences_and_features():
    assert subjects.sentences("Der Wall. No­te​: 12!\n\nΛόγος") == [["der", "wall"], ["note"], ["λόγος"]]
    x, of, whole = subjects.featurize(["a b. a", None, "", "a"])
    assert len(x) == 3 and of.tolist() == [0, 0, 3] and len(whole) == 4
    assert np.allclose([np.sqrt((x.val[x.ptr[i] : x.ptr[i + 1]] ** 2).sum()) for i in range(3)], 1)


def test_held_out_accuracy(spark):
    from lexforge.session import table

    documents, labels = (table(spark, SMALL.replace("0.01", "0.1"), t) for t in ("documents", "doc_labels"))
    texts = subjects.labelled_texts(documents, labels)
    m = subjects.train(documents, labels, texts=texts)
    assert len(m.subjects) == 14
    given, agreed, labelled = (sum(r[c] for r in subjects.quality(texts, m).collect()) for c in ("given", "agreed", "labelled"))
    assert 2 * agreed / (given + labelled) > 0.8  # annotators disagree with each other more than that
    assert subjects.path_rules(texts).count() == 0  # addresses and sections don't tell the subject in these data


def test_fits_in_tasks_are_the_same(spark):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(list("abcdef") if i % 2 else list("defghi"), 8)) for i in range(60)]
    _, _, x = subjects.featurize(texts)
    y = np.stack([np.arange(60) % 2, rng.random(60)], 1).astype(np.float32).astype(float)
    alone, tasks = subjects.fit(x, y, 20), subjects.fit(x, y, 20, spark=spark)
    assert np.allclose(alone[0], tasks[0]) and np.allclose(alone[1], tasks[1])


def test_paths_that_tell_the_subject(spark):
    """Half of the documents have annotators; under law/ all are about law, the other paths tell nothing."""
    docs, labels = [], []
    for i in range(900):
        subject = "law" if i % 3 == 0 else "sport"
        word = {"law": "court judge verdict", "sport": "race athlete wreath"}[subject]
        docs.append((i, f"{word} {i % 7}. {word}.", f"{'law' if i % 9 == 0 else 'misc'}/{i % 4}", "note"))
        if i % 2:
            labels.append((i, subject, "x"))
    docs += [(5000 + i, "quillon parry riposte. quillon parry.", "law/9", "note") for i in range(60)]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, source string, kind string")
    labels = spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string")
    rules = subjects.path_rules(subjects.labelled_texts(docs, labels), lift=2.0)
    assert {(r["field"], r["value"], r["subject"]) for r in rules.filter("value = 'law'").collect()} == {("source", "law", "law")}
    assert rules.filter("value LIKE 'misc%' OR field = 'kind'").count() == 0
    weak = subjects.weak_texts(docs, labels, rules, 40)
    assert weak.count() == 40 and weak.filter("array_contains(subjects, 'law') AND weights[0] > 0.9").count() == 40
    assert subjects.weak_texts(docs, labels, rules, 1000).filter("doc_id >= 5000").count() == 60


def test_thresholds_follow_the_subject_with_support():
    counts = np.zeros((2, len(subjects.SCORES) + 1, len(subjects.SHARES), 2))
    counts[0, -1], counts[1, -1] = 1000, 1
    counts[0, 2, 3] = 1000, 1000
    counts[1, 5, 6] = 1, 1
    score, share = subjects.thresholds(counts)
    assert score[0] == score[1] == subjects.SCORES[2] and share[0] == share[1] == subjects.SHARES[3]
    counts[1, -1] = 1000
    counts[1, 5, 6] = 1000, 1000
    score, share = subjects.thresholds(counts)
    assert score.tolist() == subjects.SCORES[[2, 5]].tolist() and share.tolist() == subjects.SHARES[[3, 6]].tolist()


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, subject string, annotator string")
    assert subjects.train(docs, labels) is None
    assert subjects.train(docs, spark.createDataFrame([(1, None, "x")], labels.schema)) is None
    assert subjects.subject_shares(docs, None).count() == 0
    assert subjects.train(docs, spark.createDataFrame([(1, "s", "x"), (9, "t", "x")], labels.schema)) is not None


@needs_data
def test_empty_and_clashing_columns(spark, empty_dir, wide_dir):
    for q in (p7_ids, p8_packs, p8_fill, p9_found, p9_composition):
        assert q(spark, empty_dir).count() == 0
    for q in (p7_ids, p8_packs, p9_found):
        assert rows(q(spark, wide_dir)) == rows(q(spark, DATA))
