"""Checks that give their violations as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frame_violations(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """row_id, frame, problem of existing-frame rows whose frame is unknown or whose core FEs differ (V1).

    rows: row_id, frame, status, core_fes ARRAY; frames: frame, core_fes ARRAY. Order and repetition of FEs don't matter.
    """
    existing = rows.filter(F.lower(F.trim("status")).startswith("existing"))
    known = frames.select("frame", F.array_sort(F.array_distinct("core_fes")).alias("_k")).dropDuplicates(["frame"])
    given = F.array_sort(F.array_distinct(F.coalesce("core_fes", F.array().cast("array<string>"))))
    problem = F.when(F.col("_k").isNull(), "unknown frame").when(given != F.col("_k"), "core FEs differ")
    return existing.join(known, "frame", "left").select("row_id", "frame", problem.alias("problem")).filter("problem IS NOT NULL")


def span_violations(spans: DataFrame) -> DataFrame:
    """The spans (id, text, start, end, span_text; end inclusive) that don't cut span_text out of text (V2). Null bounds aren't checked."""
    return spans.filter("start IS NOT NULL AND end IS NOT NULL").filter(~F.expr("text <=> text AND substring(text, start + 1, end - start + 1) <=> span_text"))


def element_violations(elements: DataFrame, frames: DataFrame) -> DataFrame:
    """The rows of elements (id, frame, fe) whose frame is known but has no element of that name (V2).

    frames: frame, fes ARRAY (core and other ones); proposals of one name count together. Null names aren't checked.
    """
    known = frames.select("frame", F.explode("fes").alias("fe")).distinct()
    asked = elements.filter("frame IS NOT NULL AND fe IS NOT NULL")
    of_known = asked.join(frames.select("frame").distinct(), "frame", "left_semi")
    return of_known.join(known, ["frame", "fe"], "left_anti")


def search_units(frames: DataFrame, pattern: str) -> DataFrame:
    """frame, lemma, pos of the lexical units whose lemma matches a regular expression, in any case (V3). frames: frame, lexical_units."""
    units = frames.select("frame", F.explode("lexical_units").alias("u")).filter("u IS NOT NULL")
    return units.select("frame", "u.lemma", "u.pos").filter(F.col("lemma").rlike("(?i)" + pattern))


def lookup(lexicon: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column matches a regular expression, in any case (V3)."""
    return lexicon.filter(F.col(column).rlike("(?i)" + pattern))


def missing(asked: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The distinct asked keys that known lacks (V5)."""
    return asked.select(key).filter(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise with the first few rows if there are any."""
    if first := violations.limit(5).collect():
        raise ValueError(f"{message}: {[tuple(r) for r in first]}")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows in one of two tables of equal columns only, with side."""
    return a.distinct().exceptAll(b.distinct()).withColumn("side", F.lit("a")).union(b.distinct().exceptAll(a.distinct()).withColumn("side", F.lit("b")))
