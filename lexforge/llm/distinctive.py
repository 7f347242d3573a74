"""How characteristic a term is of its record (problem 3): log-entropy weights by two aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.operators.skew import join_stats


def letter_runs(text: Column) -> Column:
    """The terms of a text: its runs of letters, in lower case. Null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def _counts(records: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """record_id, term, tf; term, df, gf, entropy_weight; and the number of records."""
    tf = records.select("record_id", F.explode("terms").alias("term")).groupBy("record_id", "term").agg(F.count("*").alias("tf"))
    by_term = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("gf"), F.sum(F.col("tf") * F.ln(F.col("tf").cast("double"))).alias("_s"))
    n = records.agg(F.count("*").cast("double").alias("n")).scalar()
    weight = F.when(n <= 1, F.lit(1.0)).otherwise(1 + (F.col("_s") / F.col("gf") - F.ln(F.col("gf").cast("double"))) / F.ln(F.greatest(n, F.lit(2.0))))
    return tf, by_term.select("term", "df", "gf", weight.alias("entropy_weight")), n


def _scored(tf: DataFrame, stats: DataFrame) -> DataFrame:
    return join_stats(tf, stats, "term", "df", "record_id").select("record_id", "term", "tf", "df", "gf", "entropy_weight", (F.log1p(F.col("tf").cast("double")) * F.col("entropy_weight")).alias("score"))


def log_entropy(records: DataFrame) -> DataFrame:
    """record_id, term, tf, df, gf, entropy_weight, score of every term of every record.

    records has record_id (unique, not null) and terms ARRAY<STRING>. score = ln(1 + tf) * (1 + sum p ln p / ln N),
    where p is the share of the term's occurrences that a record holds and N the number of records, those without
    terms included; with N = 1 the entropy factor is 1. Records with null or empty terms have no rows.

    First aggregation: tf by record and term. Second: by term, gf = sum tf, df and sum tf ln tf, from which the
    entropy follows, since sum p ln p = sum(tf ln tf)/gf - ln gf. Both combine before their shuffle; the join back
    spreads the rows of hot terms (see join_stats).
    """
    tf, stats, _ = _counts(records)
    return _scored(tf, stats)


def standing_out(records: DataFrame, least_tf: int = 2, df_from: int = 2, df_to: int = 8) -> DataFrame:
    """The rows of log_entropy of terms found at least least_tf times in their record and in df_from to df_to records.

    A term of at most df_to records has an entropy of at most ln df_to, so its weight is at least
    1 - ln df_to / ln N, and its score at least ln(1 + least_tf) times that. Terms and rows below these bounds are left
    out before and after the join; the counts then decide.
    """
    tf, stats, n = _counts(records)
    bound = F.when(n > df_to, 1 - F.ln(F.lit(float(df_to))) / F.ln(F.greatest(n, F.lit(2.0)))).otherwise(0.0) - 1e-9
    kept = stats.filter((F.col("entropy_weight") >= bound) & F.col("df").between(df_from, df_to))
    rows = _scored(tf.filter(F.col("tf") >= least_tf), kept)
    return rows.filter((F.col("score") >= F.ln(F.lit(1.0 + least_tf)) * bound) & F.col("df").between(df_from, df_to))
