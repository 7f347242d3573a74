"""Comparing and judging partitions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.vectors import dot, labelled, mean_vector, square_distance, unit
from lexforge.operators.terms import ranked


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n: how many items have both labels (A17). Rows with a null label are left out."""
    return _cells(df, a, b).select(F.col("_a").alias(a), F.col("_b").alias(b), "n")


def _cells(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.col(a).alias("_a"), F.col(b).alias("_b")).filter("_a IS NOT NULL AND _b IS NOT NULL").groupBy("_a", "_b").agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (items, ari) from the contingency table (M2). ari is 1 where both partitions are trivial alike, null without items."""
    table = _cells(df, a, b)
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cells = table.agg(F.sum("n").alias("items"), F.sum(pairs("n")).alias("s"))
    sides = [table.groupBy(x).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias(f"s{k}")) for k, x in enumerate(("_a", "_b"))]
    both = cells.select("items", "s", sides[0].scalar().alias("sa"), sides[1].scalar().alias("sb"))
    total = F.col("items") * (F.col("items") - 1) / 2.0
    expected = F.when(total > 0, F.col("sa") * F.col("sb") / total).otherwise(0.0)
    most = (F.col("sa") + F.col("sb")) / 2.0
    return both.select("items", F.when(F.col("items").isNull(), None).when(most == expected, 1.0).otherwise((F.col("s") - expected) / (most - expected)).alias("ari"))


def partition_agreement(a: DataFrame, b: DataFrame, item: str, label: str, least: int = 10) -> DataFrame:
    """One row (items, ari) of two partitions over the items that both label, noise (-1) left out (J10); ari is null
    for fewer than `least` common items."""
    x, y = (side.filter(labelled(label)).select(item, F.col(label).alias(name)) for side, name in ((a, "_x"), (b, "_y")))
    found = adjusted_rand(x.join(y, item), "_x", "_y")
    return found.select(F.coalesce("items", F.lit(0)).alias("items"), F.when(F.col("items") >= least, F.col("ari")).alias("ari"))


def _expected_mutual(rows: list[tuple[int, int]], cols: list[tuple[int, int]]) -> float:
    """The expected mutual information of random partitions with these margins: (size, how many clusters have it)."""
    n = sum(s * c for s, c in rows)
    log = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    emi = 0.0
    sizes, often = (np.array([c[k] for c in cols]) for k in (0, 1))
    for i, ni in rows:
        low, high = np.maximum(1, i + sizes - n), np.minimum(i, sizes)
        reach = np.maximum(high - low + 1, 0)
        j, w = np.repeat(sizes, reach), np.repeat(often, reach)
        k = np.repeat(low - (np.cumsum(reach) - reach), reach) + np.arange(reach.sum())
        term = k / n * (np.log(n * k) - np.log(float(i) * j)) * np.exp(log[i] + log[j] + log[n - i] + log[n - j] - log[n] - log[k] - log[i - k] - log[j - k] - log[n - i - j + k])
        emi += ni * float((term * w).sum())
    return emi


def adjusted_mutual_information(df: DataFrame, a: str, b: str, most: int = 20_000_000) -> DataFrame:
    """One row (items, mi, ami), normalised by the mean entropy (M2). 0 items give nulls.

    To the driver come the distinct sizes of clusters with how many have them: of n items at most sqrt(2 n) on a side.
    Its table of logarithms has a place per item, so more than `most` items are an error.
    """
    table = _cells(df, a, b)
    rows, cols = (table.groupBy(x).agg(F.sum("n").alias(f"{x}_n")) for x in ("_a", "_b"))
    left, right = ([(int(r[0]), int(r[1])) for r in side.groupBy(side.columns[1]).count().collect()] for side in (rows, cols))
    items = sum(s * c for s, c in left)
    spark = df.sparkSession
    schema = "items bigint, mi double, ami double"
    if not items:
        return spark.createDataFrame([(0, None, None)], schema)
    if items > most:
        raise ValueError(f"more than {most} items")
    cell = table.join(rows, "_a").join(cols, "_b")
    p = F.col("n") / F.lit(items)
    mi = cell.agg(F.sum(p * F.log(p * items * items / (F.col("_a_n") * F.col("_b_n"))))).first()[0]
    entropy = lambda side: -sum(c * (s / items) * math.log(s / items) for s, c in side)
    emi, mean = _expected_mutual(left, right), (entropy(left) + entropy(right)) / 2
    ami = 1.0 if mean == emi or sum(c for _, c in left) == sum(c for _, c in right) == 1 else (mi - emi) / (mean - emi)
    return spark.createDataFrame([(items, float(mi), float(ami))], schema)


def silhouette(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """One row (items, silhouette): cosine silhouette without noise (-1), from the clusters' vector sums (M1).

    For unit vectors the mean distance to a cluster is 1 - x . sum / n, so no pairs are formed. Members of a cluster
    of one count 0; null with fewer than two clusters.
    """
    rows = df.filter(labelled(label) & F.col(vector).isNotNull()).select(F.col(label).alias("l"), unit(F.col(vector)).alias("x"))
    sums = mean_vector(rows, ["l"], "x", dims, name="m")
    packed = sums.agg(F.collect_list(F.struct("l", "n", "m"))).scalar()  # one entry per cluster
    d = rows.withColumn("_c", packed)
    # mean distance to the own cluster without the row itself, and to the nearest other one
    own = F.filter("_c", lambda c: c["l"] == F.col("l"))[0]
    a = F.when(own["n"] > 1, (own["n"] - own["n"] * dot(F.col("x"), own["m"])) / (own["n"] - 1))
    b = F.array_min(F.transform(F.filter("_c", lambda c: c["l"] != F.col("l")), lambda c: 1 - dot(F.col("x"), c["m"])))
    s = d.select(a.alias("a"), b.alias("b")).select(F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).otherwise(F.when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))).alias("s"))
    return s.agg(F.count("*").alias("items"), F.avg("s").alias("silhouette"))


def calinski_harabasz(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """One row (items, clusters, score), Euclidean, noise left out (M3)."""
    rows = df.filter(labelled(label) & F.col(vector).isNotNull()).select(F.col(label).alias("l"), F.col(vector).alias("x"))
    c = mean_vector(rows, ["l"], "x", dims, name="m")
    everything = mean_vector(rows.withColumn("_1", F.lit(1)), ["_1"], "x", dims, name="g").select("g").scalar()
    within = rows.join(c, "l").agg(F.count("*").alias("items"), F.sum(square_distance(F.col("x"), F.col("m"))).alias("w"))
    between = c.withColumn("g", everything).agg(F.sum(F.col("n") * square_distance(F.col("m"), F.col("g"))).alias("b"), F.count("*").alias("k"))
    both = within.join(between)  # one row each
    score = F.when((F.col("w") > 0) & (F.col("k") > 1), F.col("b") / (F.col("k") - 1) / (F.col("w") / (F.col("items") - F.col("k"))))
    return both.select("items", F.col("k").alias("clusters"), score.alias("score"))


def davies_bouldin(df: DataFrame, label: str, vector: str, dims: int) -> DataFrame:
    """One row (clusters, score), Euclidean, noise left out (M3). Pairs are of clusters, gathered per cluster in one array."""
    rows = df.filter(labelled(label) & F.col(vector).isNotNull()).select(F.col(label).alias("l"), F.col(vector).alias("x"))
    c = mean_vector(rows, ["l"], "x", dims, name="m")
    spread = rows.join(c, "l").groupBy("l", "m").agg(F.avg(F.sqrt(square_distance(F.col("x"), F.col("m")))).alias("s"))
    packed = spread.agg(F.collect_list(F.struct("l", "m", "s"))).scalar()
    worst = F.array_max(F.transform(F.filter("_c", lambda o: o["l"] != F.col("l")), lambda o: (F.col("s") + o["s"]) / F.sqrt(square_distance(F.col("m"), o["m"]))))
    return spread.withColumn("_c", packed).select(worst.alias("r")).agg(F.count("*").alias("clusters"), F.avg("r").alias("score"))


def modularity(edges: DataFrame, labels: DataFrame, item: str, label: str, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of a partition on weighted undirected edges src < dst, weight."""
    side = lambda k: labels.select(F.col(item).alias(k), F.col(label).alias(f"l{k}"))
    e = edges.join(side("src"), "src").join(side("dst"), "dst")
    inside = e.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("lsrc") == F.col("ldst"), F.col("weight")).otherwise(0.0)).alias("w"))
    degree = e.select(F.explode(F.array(F.col("lsrc"), F.col("ldst"))).alias("l"), "weight").groupBy("l").agg(F.sum("weight").alias("d"))
    squares = degree.agg(F.sum(F.col("d") * F.col("d"))).scalar()
    return inside.select((F.col("w") / F.col("m") - F.lit(resolution) * squares / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def coverage(df: DataFrame, label: str, weight: str) -> DataFrame:
    """items, noise, noise_share, weight_share of label -1 (M9)."""
    noise = F.col(label) == -1
    return df.agg(F.count("*").alias("items"), F.count_if(noise).alias("noise"), (F.count_if(noise) / F.count("*")).alias("noise_share"), (F.sum(F.when(noise, F.col(weight)).otherwise(0)) / F.sum(weight)).alias("weight_share"))


def quantile_buckets(df: DataFrame, value: str, n: int = 10) -> DataFrame:
    """df plus bucket from 0: by exact interpolated quantile edges, equal edges merged (W7). Null values have null."""
    edges = df.agg(F.percentile(value, F.array(*[F.lit(k / n) for k in range(n + 1)])).alias("e")).select(F.array_distinct("e")).scalar()
    inner = F.slice("_e", 2, F.greatest(F.size("_e") - 2, F.lit(0)))
    return df.withColumn("_e", edges).withColumn("bucket", F.when(F.col(value).isNotNull(), F.size(F.filter(inner, lambda e: e < F.col(value))))).drop("_e")


def affix_shares(df: DataFrame, cluster: str, form: str, least: int = 3) -> DataFrame:
    """cluster, n, prefix_share, suffix_share: of the most frequent first and last three letters, words of under four letters
    counting only in n; clusters of at least `least` (A23). form is accent-stripped and lower case."""
    size = df.groupBy(cluster).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    long = df.filter(F.length(form) >= 4)
    parts = [long.groupBy(cluster, F.substring(form, s, 3).alias("x")).agg(F.count("*").alias("_n")).groupBy(cluster).agg(F.max("_n").alias(k)) for s, k in ((1, "p"), (-3, "s"))]
    out = size.join(parts[0], cluster, "left").join(parts[1], cluster, "left")
    return out.select(cluster, "n", (F.coalesce("p", F.lit(0)) / F.col("n")).alias("prefix_share"), (F.coalesce("s", F.lit(0)) / F.col("n")).alias("suffix_share"))


def _dealt(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """draw and all columns of rows (c, ...), the labels c dealt out anew in each draw by hash order.

    One sort over ranges ranks the labels, another the rows of all draws (see terms.ranked); a draw has as many rows as
    the table, so a row's rank within its draw follows. No task holds all rows of a draw.
    """
    first = ranked(rows, F.col("c")).withColumnRenamed("rank", "i")
    n = first.count()
    every = first.select("i", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"), *[c for c in rows.columns if c != "c"])
    order = ranked(every, F.col("draw"), F.xxhash64("i", F.lit(seed), F.col("draw")), F.col("i")).withColumn("r", F.col("rank") - (F.col("draw") - 1) * n)
    return order.drop("rank", "i").join(first.select(F.col("i").alias("r"), "c"), "r").drop("r")


def affix_null(df: DataFrame, cluster: str, form: str, draws: int = 60, seed: int = 0) -> DataFrame:
    """cluster, prefix_null, suffix_null: 95th percentile of the shares in `draws` random partitions of the same sizes (M6)."""
    rows = df.select(F.col(cluster).alias("c"), F.col(form).alias("f"))
    kind = dict(df.dtypes)[cluster]
    dealt = _dealt(rows, draws, seed).withColumn("key", F.struct("c", "draw"))
    s = affix_shares(dealt, "key", "f").select(F.col("key.c").cast(kind).alias(cluster), "prefix_share", "suffix_share")
    return s.groupBy(cluster).agg(F.percentile("prefix_share", F.lit(0.95)).alias("prefix_null"), F.percentile("suffix_share", F.lit(0.95)).alias("suffix_null"))


def form_driven(df: DataFrame, cluster: str, form: str, draws: int = 60, seed: int = 0) -> DataFrame:
    """cluster, n, prefix_share, suffix_share, prefix_null, suffix_null, form_driven: whether either share exceeds its null (M6)."""
    both = affix_shares(df, cluster, form).join(affix_null(df, cluster, form, draws, seed), cluster)
    return both.withColumn("form_driven", (F.col("prefix_share") > F.col("prefix_null")) | (F.col("suffix_share") > F.col("suffix_null")))


def shuffled_silhouette(df: DataFrame, label: str, vector: str, dims: int, seed: int = 0) -> DataFrame:
    """One row (items, silhouette) with the labels dealt out at random, noise left out: the baseline of M1."""
    rows = df.filter(labelled(label) & F.col(vector).isNotNull()).select(F.col(label).alias("c"), F.col(vector).alias("x"))
    return silhouette(_dealt(rows, 1, seed), "c", "x", dims)


def sample_rows(df: DataFrame, item: str, share: float = 0.9, seed: int = 0) -> DataFrame:
    """A sample without replacement of exactly floor(share * rows) rows, those first by hash of the id.

    The hash at that place comes from a count by its leading bits and a sort of the one slice it falls into.
    """
    n = int(df.count() * share)
    at = F.struct(F.xxhash64(item, F.lit(seed)).alias("h"), F.col(item).alias("i"))
    slice_ = F.shiftright(F.xxhash64(item, F.lit(seed)), 48)
    before = 0
    for s, k in sorted(df.groupBy(slice_.alias("s")).agg(F.count("*").alias("n")).collect()):  # at most 65,536 rows
        if before + k > n:
            inside = df.filter(slice_ == s).select(at.alias("at")).orderBy("at").limit(n - before)
            last = inside.agg(F.max("at")).first()[0]
            head = slice_ < s
            return df.filter(head if last is None else head | (at <= F.struct(F.lit(last["h"]).alias("h"), F.lit(last["i"]).alias("i"))))
        before += k
    return df


def sample_share(df: DataFrame, item: str, share: float = 0.9, seed: int = 0) -> DataFrame:
    """A deterministic sample without replacement of about the share given, by hash of the id."""
    return df.filter(F.pmod(F.xxhash64(item, F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))
