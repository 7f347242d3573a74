"""Operators on tables of vectors: centroids, ranking, nearest neighbours, maximum similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexforge.functions.vectors import dot, labelled, mean_vector, unit


def centroids(df: DataFrame, by: list[str], vector: str, dims: int, weight: str | None = None, normalise: bool = True) -> DataFrame:
    """by..., n, centroid: mean vectors, scaled to unit length if asked."""
    c = mean_vector(df, by, vector, dims, weight)
    return c.withColumn("centroid", unit(F.col("centroid"))) if normalise else c


def two_level_mean(df: DataFrame, outer: str, inner: str, vector: str, dims: int) -> DataFrame:
    """Mean of means: pieces per inner group first, then inner groups per outer group (A5)."""
    return mean_vector(mean_vector(df, [outer, inner], vector, dims, name="_m"), [outer], "_m", dims)


def rank_by_centroid(df: DataFrame, cluster: str, item: str, vector: str, dims: int) -> DataFrame:
    """cluster, item, similarity to the unit centroid, rank from 1 (ties: item) (W1). Null clusters and noise (-1) are left out."""
    rows = df.filter(labelled(cluster))
    # one row per cluster
    joined = rows.join(centroids(rows, [cluster], vector, dims), cluster)
    scored = joined.withColumn("similarity", dot(unit(F.col(vector)), F.col("centroid")))
    by = Window.partitionBy(cluster).orderBy(F.desc("similarity"), item)
    return scored.select(cluster, item, "similarity", F.row_number().over(by).alias("rank"))


def coherence(df: DataFrame, cluster: str, item: str, vector: str, dims: int) -> DataFrame:
    """cluster, n, coherence: mean similarity of the members to their centroid (M8)."""
    rows = df.filter(labelled(cluster))
    joined = rows.join(centroids(rows, [cluster], vector, dims), cluster)
    near = dot(unit(F.col(vector)), F.col("centroid"))
    return joined.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(near).alias("coherence"))


def best_examples(df: DataFrame, cluster: str, item: str, vector: str, dims: int, k: int = 5) -> DataFrame:
    """cluster, examples: the k items nearest to the centroid, joined by "; " in that order."""
    near = rank_by_centroid(df, cluster, item, vector, dims).filter(F.col("rank") <= k)
    order = F.array_sort(F.collect_list(F.struct("rank", F.col(item).cast("string").alias("i"))))
    return near.groupBy(cluster).agg(F.array_join(F.transform(order, lambda x: x["i"]), "; ").alias("examples"))


def both_ends(coherent: DataFrame, cluster: str, top: int = 12, bottom: int = 8, least: int = 3) -> DataFrame:
    """end, place, cluster, n, coherence: the most and the least coherent clusters of `least` members or more.

    coherent: cluster, n, coherence. With fewer than top + bottom clusters some are at both ends, as in two listings.
    """
    rows = coherent.filter(F.col("n") >= least).select(cluster, "n", "coherence")

    def end(name: str, order: Column, k: int) -> DataFrame:
        first = rows.orderBy(order, cluster).limit(k)
        return first.select(F.lit(name).alias("end"), F.row_number().over(Window.orderBy(order, cluster)).alias("place"), cluster, "n", "coherence")

    return end("top", F.desc("coherence"), top).union(end("bottom", F.asc("coherence"), bottom))


_GROUP = "k long, ids binary, dims int, data binary"


def _grouped(rows: DataFrame, item: str, vector: str, name: str, groups: int) -> DataFrame:
    """name, rows: of each of `groups` hash groups the ids and unit vectors, packed as binary in the tasks that read them.

    A group comes as one piece per task, so nothing is collected row by row.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, group = b.column(0).to_numpy(), b.column(1).to_numpy()
            flat, n = b.column(2), b.num_rows
            width = np.diff(flat.offsets.to_numpy())
            if n and (width != width[0]).any():
                raise ValueError("vectors differ in length")
            v = flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.float64)
            v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
            keys = np.unique(group)
            at = [np.flatnonzero(group == k) for k in keys]
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array([ids[i].tobytes() for i in at], pa.binary()), pa.array([v.shape[1]] * len(keys), pa.int32()), pa.array([v[i].tobytes() for i in at], pa.binary())], names=["k", "ids", "dims", "data"])

    known = rows.filter(F.col(vector).isNotNull()).select(F.col(item).cast("bigint").alias("i"), F.pmod(F.xxhash64(item), F.lit(groups)).cast("bigint").alias("g"), F.col(vector).cast("array<double>").alias("v"))
    return known.mapInArrow(pack, _GROUP).select(F.col("k").alias(name), "ids", "dims", "data")


def _topk(queries: DataFrame, corpus: DataFrame, item: str, vector: str, k: int, exclude_self: bool, chunk: int = 16384) -> DataFrame:
    """query, item, similarity: the k most similar rows of corpus for each row of queries, partly reduced per pair.

    Both tables come in hash groups of about `chunk` vectors (smaller ones where that leaves cores idle), as binary
    pieces. Every pair of groups is one key: its pieces meet in one task, as matrix products of 1,024 queries at a time
    over binary buffers, and k rows per query leave it. A task holds one pair, whatever the tables' sizes, and each
    table is sent as often as the other one has groups.
    """
    asked, known = queries.count(), corpus.count()
    m = max(1, -(-known // chunk))
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-asked // chunk), min(-(-asked // 64), -(-2 * cores // m)))
    q, c = (_grouped(df, item, vector, name, g) for df, name, g in ((queries, "block", n), (corpus, "part", m)))
    every = lambda x: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(x - 1).cast("bigint")))
    left = q.select("block", every(m).alias("part"), F.lit(True).alias("asks"), "ids", "dims", "data")
    right = c.select(every(n).alias("block"), "part", F.lit(False).alias("asks"), "ids", "dims", "data")

    def best(qi: np.ndarray, a: np.ndarray, ci: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
        s = a @ w.T
        if exclude_self:
            s[qi[:, None] == ci[None, :]] = -np.inf
        near = np.round(s, 12)
        if s.shape[1] > 4 * k:  # the k-th value bounds what has to be sorted; ties stay in
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
            i, j = np.nonzero(near >= least[:, None])
        else:
            i, j = (x.ravel() for x in np.indices(s.shape))
        order = np.lexsort((ci[j], -near[i, j], i))
        i, j = i[order], j[order]
        ok = (np.arange(len(i)) - np.searchsorted(i, i) < k) & np.isfinite(s[i, j])
        i, j = i[ok], j[ok]
        return pa.record_batch([pa.array(qi[i], pa.int64()), pa.array(ci[j], pa.int64()), pa.array(s[i, j], pa.float64())], names=["query", "item", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[bool, tuple[list, list]] = {True: ([], []), False: ([], [])}
        for b in batches:
            for asks, ids, dims, data in zip(*[b.column(x).to_pylist() for x in ("asks", "ids", "dims", "data")], strict=True):
                sides[asks][0].append(np.frombuffer(ids, np.int64))
                sides[asks][1].append(np.frombuffer(data).reshape(-1, dims))
        if sides[True][0] and sides[False][0]:
            (qi, a), (ci, w) = (tuple(np.concatenate(x) for x in sides[s]) for s in (True, False))
            for at in range(0, len(qi), 1024):
                yield best(qi[at : at + 1024], a[at : at + 1024], ci, w)

    return left.union(right).groupBy("block", "part").applyInArrow(lambda t: _whole(run, t), "query bigint, item bigint, similarity double")


def _whole(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], table: pa.Table) -> pa.Table:
    schema = pa.schema([("query", pa.int64()), ("item", pa.int64()), ("similarity", pa.float64())])
    return pa.Table.from_batches(list(run(iter(table.to_batches()))), schema=schema)


def nearest(queries: DataFrame, corpus: DataFrame, item: str, vector: str, k: int, exclude_self: bool = True) -> DataFrame:
    """query, item, similarity, rank: the exact k nearest by cosine (J18, J19). Ids are integers; ties go to the lesser id.

    The row itself is left out by its id, not by its rank, so equal vectors don't hide it. Null vectors have no rows.
    """
    found = _topk(queries, corpus, item, vector, k, exclude_self)
    by = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "item")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def knn_edges(df: DataFrame, item: str, vector: str, k: int = 15) -> DataFrame:
    """src < dst, weight = max(1 - cosine distance, 1e-9): the union of all k-nearest-neighbour pairs."""
    near = nearest(df, df, item, vector, k)
    return near.groupBy(F.least("query", "item").alias("src"), F.greatest("query", "item").alias("dst")).agg(F.greatest(F.max("similarity"), F.lit(1e-9)).alias("weight"))


def nearest_centroid(df: DataFrame, item: str, vector: str, centers: DataFrame, center: str, centroid: str = "centroid") -> DataFrame:
    """item, nearest, similarity: the centre of greatest cosine (J17; ties: the lesser). centers has at most a few thousand rows.

    The centres are gathered into one array value, which bounds what every row meets.
    """
    packed = centers.agg(F.collect_list(F.struct(F.col(center).alias("c"), F.col(centroid).alias("v")))).scalar()
    scored = df.select(item, F.col(vector).alias("_v"), F.explode(packed).alias("_c"))
    best = scored.withColumn("_s", dot(unit(F.col("_v")), unit(F.col("_c.v")))).groupBy(item).agg(F.max_by(F.struct("_c.c", "_s"), F.struct(F.round("_s", 12), -F.col("_c.c"))).alias("_b"))
    return best.select(item, F.col("_b.c").alias("nearest"), F.col("_b._s").alias("similarity"))


def max_similarity(df: DataFrame, item: str, vector: str, prompts: DataFrame, group: str, prompt_vector: str) -> DataFrame:
    """item, group, score: the greatest dot product with any prompt of the group (J16). prompts is a small fixed table."""
    packed = prompts.agg(F.collect_list(F.struct(F.col(group).alias("g"), F.col(prompt_vector).alias("v")))).scalar()
    scored = df.select(item, F.col(vector).alias("_v"), F.explode(packed).alias("_p"))
    return scored.groupBy(item, F.col("_p.g").alias(group)).agg(F.max(dot(F.col("_v"), F.col("_p.v"))).alias("score"))


def _times(factor: Column) -> Callable[[Column], Column]:
    return lambda x: x * factor


def remove_top_components(df: DataFrame, item: str, vector: str, dims: int, k: int = 2) -> DataFrame:
    """item, vector without its mean and its projections on the first k principal directions.

    Every task sums its rows' d x d moments, these are added up by place, and the eigenvectors are found on the driver
    from that one matrix. Null vectors stay null.
    """
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))  # the last place is a constant 1: sums and the count
        for b in batches:
            x = np.array(b.column(0).to_pylist(), np.float64).reshape(-1, dims)
            x = np.hstack([x, np.ones((len(x), 1))])
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.record_batch([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel(), pa.float64())], names=["i", "j", "s"])

    known = df.filter(F.col(vector).isNotNull())
    sums = known.select(F.col(vector).cast("array<double>")).mapInArrow(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    m = np.zeros((dims + 1, dims + 1))
    for r in sums.collect():  # (dims + 1) squared rows
        m[r["i"], r["j"]] = r["s"]
    n = max(m[dims, dims], 1.0)
    mean, m = m[dims, :dims] / n, m[:dims, :dims] / n
    top = np.linalg.eigh(m - np.outer(mean, mean))[1][:, ::-1][:, :k]
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(float(x)) for x in mean]), lambda a, b: a - b)
    out = df.select(item, centred.alias("_c"))
    for c in range(k):
        axis = F.array(*[F.lit(float(x)) for x in top[:, c]])
        out = out.withColumn(f"_p{c}", dot(F.col("_c"), axis))
    cleaned = F.col("_c")
    for c in range(k):
        scaled = F.transform(F.array(*[F.lit(float(x)) for x in top[:, c]]), _times(F.col(f"_p{c}")))
        cleaned = F.zip_with(cleaned, scaled, lambda a, b: a - b)
    return out.select(item, cleaned.alias(vector))


def reduce_pca(df: DataFrame, item: str, vector: str, k: int = 15) -> DataFrame:
    """item, reduced ARRAY<DOUBLE>: MLlib PCA to k places, in place of a neighbour embedding (E7, another method)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.filter(F.col(vector).isNotNull()).select(item, array_to_vector(F.col(vector).cast("array<double>")).alias("_f"))
    return PCA(k=k, inputCol="_f", outputCol="_r").fit(rows).transform(rows).select(item, vector_to_array("_r").alias("reduced"))


def word_vectors(sentences: DataFrame, tokens: str = "tokens", dims: int = 100, window: int = 5, min_count: int = 3, seed: int = 42, iterations: int = 5) -> DataFrame:
    """word, vector: MLlib skip-gram vectors (E4; hierarchical softmax, no character n-grams: another model than fastText)."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=dims, windowSize=window, minCount=min_count, seed=seed, maxIter=iterations, inputCol=tokens, outputCol="_v").fit(sentences.filter(F.size(tokens) > 0))
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def encode_texts(df: DataFrame, item: str, text: str, load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64, done: DataFrame | None = None) -> DataFrame:
    """item, vector ARRAY<FLOAT> of unit length, by any sentence encoder.

    load() runs once per task and gives encode(texts) -> matrix; texts go to it in batches of at most `batch`. Rows whose
    item is in done (item, vector) aren't encoded again but passed on, so a stopped run goes on where it was. Null
    texts have no row.
    """
    rows = df.filter(F.col(text).isNotNull()).select(item, text)
    if done is not None:
        rows = rows.join(done.select(item), item, "left_anti")
    kind = dict(df.dtypes)[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                encode = encode or load()
                v = np.asarray(encode(part.column(1).to_pylist()), np.float64).reshape(part.num_rows, -1)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pa.record_batch([part.column(0), pa.array(list(v.astype(np.float32)), pa.list_(pa.float32()))], names=[item, "vector"])

    fresh = rows.mapInArrow(run, f"{item} {kind}, vector array<float>")
    return fresh if done is None else done.select(item, F.col("vector").cast("array<float>").alias("vector")).unionByName(fresh)


def pool_overlap(pieces: np.ndarray, spans: list[tuple[int, int]], start: int, end: int) -> np.ndarray | None:
    """The mean of the rows of pieces whose span (end exclusive) meets start..end, at unit length; None if none does or it is zero."""
    at = [i for i, (a, b) in enumerate(spans) if b > a and a < end and b > start]
    if not at:
        return None
    v = np.asarray(pieces, np.float64)[at].mean(0)
    n = float(np.linalg.norm(v))
    return v / n if n else None


def encode_occurrences(df: DataFrame, item: str, text: str, targets: str, load: Callable[[], Callable[[list[str]], list[tuple[np.ndarray, list[tuple[int, int]]]]]], batch: int = 32) -> DataFrame:
    """item, target INT (place from 0), vector ARRAY<FLOAT> of every target of a text, by any contextual encoder.

    targets: ARRAY<STRUCT<start INT, end INT>> in characters, end exclusive. load() gives encode(texts) -> per text the
    matrix of its pieces and their character spans, (0, 0) for special pieces. A target takes the mean of the pieces
    that meet it; one no piece meets, as in a cut text, has no row.
    """
    kind = dict(df.dtypes)[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                encode = encode or load()
                out: tuple[list, list, list] = ([], [], [])
                for i, wanted, (pieces, spans) in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    for k, t in enumerate(wanted or []):
                        if t is not None and t["start"] is not None and t["end"] is not None and (v := pool_overlap(pieces, spans, t["start"], t["end"])) is not None:
                            for c, x in zip(out, (i, k, v.astype(np.float32)), strict=True):
                                c.append(x)
                yield pa.record_batch([pa.array(out[0], b.schema.field(0).type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.float32()))], names=[item, "target", "vector"])

    return df.filter(F.col(text).isNotNull()).select(item, text, targets).mapInArrow(run, f"{item} {kind}, target int, vector array<float>")


def hashed_embedding(df: DataFrame, item: str, text: str, dims: int = 64) -> DataFrame:
    """item, vector: unit vector of signed hashed character trigrams; stands where no encoder model is given."""
    grams = F.expr(f"transform(sequence(1, greatest(length({text}) - 2, 1)), i -> substring({text}, i, 3))")
    h = df.select(item, F.explode(grams).alias("g")).select(item, F.pmod(F.xxhash64("g"), F.lit(dims)).cast("int").alias("d"), F.when(F.pmod(F.xxhash64("g", F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s"))
    sums = h.groupBy(item).agg(*[F.sum(F.when(F.col("d") == i, F.col("s")).otherwise(0.0)).alias(f"d{i}") for i in range(dims)])
    return sums.select(item, unit(F.array(*[F.col(f"d{i}") for i in range(dims)])).alias("vector"))
