from __future__ import annotations

from conftest import DATA, needs_data

from lexforge.operators import terms
from lexforge.plans import reference


def test_counts_per_occurrence(spark):
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "b"), (1, "b"), (1, "x"), (2, "a"), (2, "c"), (2, ""), (2, None), (3, "d")], "p int, l string")
    got = {(r["lemma"], r["context"]): (r["n"], r["rank"]) for r in terms.context_lemmas(t, "p", "l", ("x",)).collect()}
    assert got == {("a", "b"): (6, 1), ("a", "c"): (1, 2), ("b", "a"): (6, 1), ("c", "a"): (1, 1)}
    assert {r["context"] for r in terms.context_lemmas(t, "p", "l", ("x",), 1).filter("lemma = 'a'").collect()} == {"b"}


@needs_data
def test_every_lemma_has_rows(spark):
    t = reference.tokens(spark, DATA).filter("lemma <> ''").filter(~reference.F.col("lemma").isin(*reference.STOPS)).select("passage_id", "lemma").distinct()
    other = t.groupBy("passage_id").count().filter("count > 1")
    want = {r["lemma"] for r in t.join(other, "passage_id").select("lemma").distinct().collect()}
    assert {r["lemma"] for r in reference.context_lemmas(spark, DATA).select("lemma").distinct().collect()} == want
