"""Agreement of clusterings under other seeds and on subsamples."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.operators.cluster import linkage_cuts
from lexforge.operators.metrics import adjusted_rand, sample_rows
from lexforge.session import cut


def seed_stability(run: Callable[[int], DataFrame], seeds: tuple[int, ...] = (1, 7, 13, 21)) -> DataFrame:
    """seed_a, seed_b, items, ari for each pair of runs (M4). run(seed) gives item, label; noise is a label of its own. Without items no rows."""
    runs = {s: cut(run(s).select("item", "label"), "run") for s in seeds}
    pairs = [adjusted_rand(runs[a].join(runs[b].withColumnRenamed("label", "other"), "item"), "label", "other").select(F.lit(a).alias("seed_a"), F.lit(b).alias("seed_b"), "items", "ari") for a, b in combinations(seeds, 2)]
    return reduce(DataFrame.union, pairs).filter("items > 0")


def subsample_stability(df: DataFrame, item: str, vector: str, k: int = 80, trials: int = 8, share: float = 0.9) -> DataFrame:
    """trial, items, ari: k average-linkage clusters of all rows and of a sample, compared on the sample (L9, C4, M2; M5)."""
    whole = cut(linkage_cuts(df, item, vector, (k,), "average").select(item, F.col("label").alias("whole")), "whole")
    rows = []
    for t in range(1, trials + 1):
        part = linkage_cuts(sample_rows(df, item, share, t), item, vector, (k,), "average")
        rows.append(adjusted_rand(part.join(whole, item), "label", "whole").select(F.lit(t).alias("trial"), "items", "ari"))
    return reduce(DataFrame.union, rows).filter("items > 0")
