from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest
from conftest import DATA, needs_data, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.llm import distinctive, ngrams
from lexforge.llm.queries import p3_found, p3_weights, p5_found, p5_ngrams


def test_entropy(spark):
    r = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a"]), (3, None), (4, [])], "record_id bigint, terms array<string>")
    got = {(x["record_id"], x["term"]): x for x in distinctive.log_entropy(r).collect()}
    g = 1 + (2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)) / math.log(4)
    assert got[1, "a"]["df"] == 2 and got[1, "a"]["gf"] == 3
    assert math.isclose(got[1, "a"]["score"], math.log(3) * g)
    assert math.isclose(got[1, "b"]["entropy_weight"], 1.0)
    assert rows(distinctive.standing_out(r).select("record_id", "term")) == [(1, "a")]
    assert distinctive.log_entropy(r.filter("record_id = 1")).filter("entropy_weight <> 1").count() == 0
    assert distinctive.log_entropy(r.limit(0)).count() == 0


def test_standing_out_is_all_that_the_counts_allow(spark):
    data = [(i, [f"t{(i * k) % 23}" for k in range(1, 9)] + [f"t{i % 23}"] * (i % 3) + ["all", "all"]) for i in range(40)]
    for part in (data, data[:3], data[:9]):
        r = spark.createDataFrame(part, "record_id bigint, terms array<string>")
        want = rows(distinctive.log_entropy(r).filter("tf >= 2 AND df BETWEEN 2 AND 8").select("record_id", "term", "score"))
        assert rows(distinctive.standing_out(r).select("record_id", "term", "score")) == want


def brute(sequences: list[tuple[str, int, list]], n: int) -> dict:
    count, records = Counter(), defaultdict(set)
    for field, rid, terms in sequences:
        for i in range(len(terms or [])):
            for k in range(1, n + 1):
                g = terms[i : i + k]
                if len(g) == k and None not in g:
                    count[field, tuple(g)] += 1
                    records[field, tuple(g)].add(rid)
    return {k: (v, len(records[k])) for k, v in count.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=7), max_size=8), st.integers(1, 4))
def test_stack(seqs, n):
    grouped = defaultdict(lambda: [0, set()])
    for rid, s in enumerate(seqs):
        for i in range(len(s)):
            g = grouped[tuple(s[i : i + n])]
            g[0] += 1
            g[1].add(rid)
    ordered = sorted(grouped.items(), reverse=True)
    out = ngrams.stack_counts(("f", 0, list(k), c, list(r)) for k, (c, r) in ordered)
    assert {(f, tuple(g)): (c, r) for f, g, c, r in out} == brute([("f", i, s) for i, s in enumerate(seqs)], n)


def test_stack_is_emptied_between_salts():
    rows = [("f", salt, ["h", x], 1, [salt * 100 + i]) for salt in range(4) for x in "ba" for i in range(3)]
    out = [(g, n, r) for _, g, n, r in ngrams.stack_counts(rows)]
    assert [x for x in out if x[0] == ["h"]] == [(["h"], 6, 3)] * 4


@pytest.mark.parametrize("part", [1, 20, 100_000])
def test_hot_first_term(spark, part):
    seqs = [("f", i, ["h", "h", chr(97 + i % 5), None, "h"]) for i in range(60)] + [("g", 1, ["x"]), ("g", 2, None), ("g", 3, [])]
    df = spark.createDataFrame(seqs, "field string, record_id bigint, terms array<string>")
    got = {(r["field"], tuple(r["ngram"])): (r["n"], r["records"]) for r in ngrams.suffix_counts(df, 3, part).collect()}
    assert got == brute(seqs, 3)


@needs_data
def test_empty_and_clashing_columns(spark, empty_dir, wide_dir):
    for q in (p3_found, p3_weights, p5_found, p5_ngrams):
        assert q(spark, empty_dir).count() == 0
        assert rows(q(spark, wide_dir)) == rows(q(spark, DATA))
