"""Offsets, overlaps and passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_offsets(tokens: DataFrame, keys: list[str], order: str, form: str = "form") -> DataFrame:
    """tokens with start, end (exclusive) in the forms joined by one space."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(form) + 1).over(before), F.lit(0)).cast("int")
    return tokens.withColumn("start", start).withColumn("end", (start + F.length(form)).cast("int"))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys..., a.*, b.* of half-open spans that overlap; empty spans overlap nothing (J14). a: keys, a_id, start, end; b alike."""
    x = a.filter("start < end").select(*keys, "a_id", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    y = b.filter("start < end").select(*keys, "b_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return x.join(y, keys).filter("a_start < b_end AND a_end > b_start")


def first_target(tokens: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """key, token_pos, target_pos: the first target (inclusive bounds) that meets each token."""
    hit = tokens.select(key, "token_pos", F.col("start").alias("ts"), F.col("end").alias("te")).join(targets.select(key, "target_pos", "start", "end"), key).filter("ts <= end AND te >= start")
    return hit.groupBy(key, "token_pos").agg(F.min("target_pos").alias("target_pos"))


def contained_tokens(tokens: DataFrame, elements: DataFrame, key: str) -> DataFrame:
    """key, fe_id, token_pos: the tokens that lie wholly inside each element (inclusive bounds) (J15). elements: key, fe_id, start, end.

    Spans without both bounds, and those that end before they start, hold nothing.
    """
    t = tokens.filter("start <= end").select(key, "token_pos", F.col("start").alias("ts"), F.col("end").alias("te"))
    e = elements.filter("start <= end").select(key, "fe_id", "start", "end")
    return t.join(e, key).filter("ts >= start AND te <= end").select(key, "fe_id", "token_pos")


def rank_passages(tokens: DataFrame, key: str, lemma: str, wanted: DataFrame, by: str, top: int = 15) -> DataFrame:
    """by, key, n_lemmas, n_words: for each list of wanted lemmas (by, lemma) the passages with at least two of them:
    most lemmas, then fewest words, the first `top` (L3)."""
    w = wanted.filter(F.col("lemma").isNotNull()).select(by, F.col("lemma").alias(lemma)).distinct()
    n = tokens.select(key, lemma).distinct().join(w, lemma).groupBy(by, key).agg(F.count("*").alias("n_lemmas")).filter("n_lemmas >= 2")
    words = tokens.groupBy(key).agg(F.count("*").alias("n_words"))
    order = Window.partitionBy(by).orderBy(F.desc("n_lemmas"), "n_words", key)
    return n.join(words, key).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= top).select(by, key, "n_lemmas", "n_words")


def passage_sentences(tokens: DataFrame, passages: DataFrame) -> DataFrame:
    """passage, sentence_id: sentences of the work that share a citation with the passage (J21). tokens: work, sentence_id, cite; passages: passage, work, cites ARRAY."""
    cites = passages.select("passage", "work", F.explode("cites").alias("cite"))
    return tokens.select("work", "sentence_id", "cite").join(cites, ["work", "cite"]).select("passage", "work", "sentence_id").distinct()
