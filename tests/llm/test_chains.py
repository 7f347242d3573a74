from __future__ import annotations

from conftest import rows

from lexforge.llm.queries import p4_found, p4_pairs


def test_chained_pairs_are_all_given(spark, tmp_path):
    """Glosses 1-2, 2-3, ... 5-6 are alike and no others, so every clustering splits a pair."""
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    glosses = [(i, " ".join(words[i - 1 : i + 3])) for i in range(1, 7)]
    spark.createDataFrame(glosses, "lemma_id bigint, lsj_glosses string").write.parquet(f"{tmp_path}/lemmas.parquet")
    spark.createDataFrame([], "row_id bigint, gloss string").write.parquet(f"{tmp_path}/lemma_frames.parquet")
    kinds = ", ".join(f"topic_{i} double" for i in range(20))
    spark.createDataFrame([], f"book_id bigint, {kinds}").write.parquet(f"{tmp_path}/topic_prevalence_by_book.parquet")
    assert rows(p4_found(spark, str(tmp_path))) == [("lemmas", i, i + 1) for i in range(1, 6)]
    apart = p4_pairs(spark, str(tmp_path)).filter("apart").count()
    assert 1 <= apart <= 3
