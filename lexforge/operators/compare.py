"""Comparing annotation runs and experiments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import jaccard


def frames_by_lemma(rows: DataFrame) -> DataFrame:
    """greek_lemma, primary ('' if none), frames (sorted set). rows: greek_lemma, assignment, frame, row_id; the first primary counts."""
    return rows.filter("greek_lemma IS NOT NULL").groupBy("greek_lemma").agg(F.coalesce(F.min_by(F.when(F.col("assignment") == "primary", F.col("frame")), F.when(F.col("assignment") == "primary", F.col("row_id"))), F.lit("")).alias("primary"), F.array_sort(F.collect_set("frame")).alias("frames"))


def compare_runs(a: DataFrame, b: DataFrame, equivalents: dict[str, str] | None = None) -> DataFrame:
    """greek_lemma, a_primary, b_primary, same_primary, only_a, only_b, overlap of two runs' frames.

    equivalents maps a proposed frame's name to another that stands for the same concept. A lemma of one run only is
    compared with no frames.
    """
    x, y = frames_by_lemma(a), frames_by_lemma(b)
    none = F.array().cast("array<string>")
    both = x.select("greek_lemma", F.col("primary").alias("a_primary"), F.col("frames").alias("fa")).join(y.select("greek_lemma", F.col("primary").alias("b_primary"), F.col("frames").alias("fb")), "greek_lemma", "full_outer").withColumns({"a_primary": F.coalesce("a_primary", F.lit("")), "b_primary": F.coalesce("b_primary", F.lit("")), "fa": F.coalesce("fa", none), "fb": F.coalesce("fb", none)})

    def named(c: Column) -> Column:
        for k, v in (equivalents or {}).items():
            c = F.when(c == k, v).otherwise(c)
        return c

    return both.select("greek_lemma", "a_primary", "b_primary", (named(F.col("a_primary")) == named(F.col("b_primary"))).alias("same_primary"), F.array_join(F.array_except("fa", "fb"), "; ").alias("only_a"), F.array_join(F.array_except("fb", "fa"), "; ").alias("only_b"), jaccard(F.col("fa"), F.col("fb")).alias("overlap"))


def compare_targets(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key..., a_frame, b_frame ('–' where a run lacks the target), same_frame, same_fes (J9, M10). Each: key..., frame, fes ARRAY."""
    x = a.select(*key, F.col("frame").alias("a_frame"), F.col("fes").alias("fa"))
    y = b.select(*key, F.col("frame").alias("b_frame"), F.col("fes").alias("fb"))
    both = x.join(y, key, "full_outer")
    same = F.coalesce(F.col("a_frame") == F.col("b_frame"), F.lit(False))
    return both.select(*key, F.coalesce("a_frame", F.lit("–")).alias("a_frame"), F.coalesce("b_frame", F.lit("–")).alias("b_frame"), same.alias("same_frame"), (same & F.coalesce(F.array_sort(F.array_distinct("fa")) == F.array_sort(F.array_distinct("fb")), F.lit(False))).alias("same_fes"))


def shared_lemmas(experiments: DataFrame) -> DataFrame:
    """slug_a < slug_b, shared: lemmas that two experiments have in common, by pairs per lemma of the slugs that name it.

    A lemma's slugs are gathered as one sorted set; pairs are formed inside it, so a lemma named by k experiments
    gives the k(k-1)/2 pairs that the result counts.
    """
    slugs = experiments.filter("lemma IS NOT NULL AND slug IS NOT NULL").groupBy("lemma").agg(F.array_sort(F.collect_set("slug")).alias("s")).filter(F.size("s") > 1)
    pairs = slugs.select("lemma", F.posexplode("s").alias("i", "slug_a"), "s").select("slug_a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("slug_b"))
    return pairs.groupBy("slug_a", "slug_b").agg(F.count("*").alias("shared"))


def merge_proposed(frames: DataFrame, equivalents: dict[str, str] | None = None) -> DataFrame:
    """name, proposals, lemmas: proposed frames of equivalent names merged, with the union of their lexical units."""
    name = F.col("name")
    for k, v in (equivalents or {}).items():
        name = F.when(name == k, v).otherwise(name)
    rows = frames.withColumn("name", name).filter("name IS NOT NULL")
    counts = rows.groupBy("name").agg(F.countDistinct("frame_id").alias("proposals"))
    units = rows.select("name", F.explode_outer("lexical_units.lemma").alias("l")).groupBy("name").agg(F.array_sort(F.collect_set("l")).alias("lemmas"))
    return counts.join(units, "name")


def run_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """by..., rows, lemmas, frames, primaries, proposed_primaries of an assignment table."""
    status = F.lower(F.trim(F.coalesce("frame_status", F.lit(""))))
    primary = F.col("assignment") == "primary"
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.countDistinct("greek_lemma").alias("lemmas"), F.countDistinct("frame").alias("frames"), F.count_if(primary).alias("primaries"), F.count_if(primary & status.startswith("proposed")).alias("proposed_primaries"))
