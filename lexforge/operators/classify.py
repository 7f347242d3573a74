"""Contrastive category search over dictionary senses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.text import seed_pattern


def seed_hits(df: DataFrame, item: str, text: str, categories: dict[str, list[str]]) -> DataFrame:
    """item, category of every category with a seed word in the text."""
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(seed_pattern(s)), F.lit(c)) for c, s in categories.items()]), lambda x: x.isNotNull())
    return df.select(item, F.explode(hits).alias("category"))


def sense_gate(scores: DataFrame, seeds: DataFrame, entry: str = "entry", margin: float = 0.06, floor: float = 0.7, seed_floor: float = 0.4) -> DataFrame:
    """entry, category, pos_score, neg_score, margin, method of the categories an entry passes.

    scores: entry, sense, category, pos, neg. A sense passes by margin >= `margin` and pos >= `floor`, or >= `seed_floor`
    where a seed word hit; an entry if any of its senses does. Scores are of the entry's best sense.
    """
    hit = seeds.select(F.col(entry), "category", F.lit(True).alias("seeded")).distinct()
    s = scores.join(hit, [entry, "category"], "left").withColumn("seeded", F.coalesce("seeded", F.lit(False))).withColumn("m", F.col("pos") - F.col("neg"))
    by = s.groupBy(entry, "category").agg(F.max("pos").alias("pos_score"), F.max("neg").alias("neg_score"), F.max("m").alias("margin"), F.bool_or((F.col("m") >= margin) & (F.col("pos") >= floor)).alias("base"), F.bool_or((F.col("m") >= margin) & (F.col("pos") >= seed_floor) & F.col("seeded")).alias("by_seed"))
    method = F.when(F.col("base") & F.col("by_seed"), "both").when(F.col("base"), "embedding").otherwise("seed")
    return by.filter("base OR by_seed").select(entry, "category", "pos_score", "neg_score", "margin", method.alias("method"))


def best_categories(passed: DataFrame, entry: str = "entry", score: str = "pos_score", delta: float = 0.04) -> DataFrame:
    """The rows within delta of their entry's best score, is_best true for the best (W4; ties: by name)."""
    best = Window.partitionBy(entry)
    rows = passed.withColumn("_m", F.max(score).over(best)).withColumn("_r", F.row_number().over(best.orderBy(F.desc(score), "category")))
    return rows.filter(F.col("_m") - F.col(score) <= delta).withColumn("is_best", F.col("_r") == 1).drop("_m", "_r")


def seed_or_embedding(seed: DataFrame, embedded: DataFrame, entry: str = "entry") -> DataFrame:
    """entry, categories, method: the union of both category sets."""
    a = seed.groupBy(entry).agg(F.collect_set("category").alias("a"))
    b = embedded.groupBy(entry).agg(F.collect_set("category").alias("b"))
    both = a.join(b, entry, "full_outer")
    none = F.array().cast("array<string>")
    return both.select(entry, F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none))).alias("categories"), F.when(F.col("b").isNull(), "seed").when(F.col("a").isNull(), "embedding").otherwise("both").alias("method"))
