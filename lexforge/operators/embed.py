"""Kernels from published papers that need all rows at once: a neighbour embedding, vectors with subwords, anchored topics.

Each is a driver step over types or windows, on a bounded number of rows, and an error beyond it; the operators for any
size are vectors.reduce_pca, vectors.word_vectors and terms.anchored_topics.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.operators.terms import _product

LIMIT, TOKENS, ENTRIES = 12_000, 5_000_000, 20_000_000


def _neighbours(v: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Indices and distances of the k nearest other rows."""
    x = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if metric == "cosine" else v
    at, dist = np.empty((len(v), k), int), np.empty((len(v), k))
    for a in range(0, len(v), 1024):
        dots = x[a : a + 1024] @ x.T
        d = np.clip(1 - dots, 0, None) if metric == "cosine" else np.sqrt(np.maximum((x[a : a + 1024] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * dots, 0))
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        near = np.argsort(d, 1, kind="stable")[:, :k]
        at[a : a + 1024], dist[a : a + 1024] = near, np.take_along_axis(d, near, 1)
    return at, dist


def _fuzzy(dist: np.ndarray) -> np.ndarray:
    """Memberships exp(-(d - rho) / sigma), rho the least distance, sigma such that a row's sum is log2 of its size."""
    rho, want = dist[:, :1], np.log2(dist.shape[1])
    low, high = np.zeros((len(dist), 1)), np.full((len(dist), 1), np.inf)
    sigma = np.ones((len(dist), 1))
    for _ in range(64):
        total = np.exp(-np.maximum(dist - rho, 0) / sigma).sum(1, keepdims=True)
        high, low = np.where(total > want, sigma, high), np.where(total > want, low, sigma)
        sigma = np.where(np.isinf(high), sigma * 2, (low + high) / 2)
    return np.exp(-np.maximum(dist - rho, 0) / np.maximum(sigma, 1e-3 * dist.mean()))


def _curve(min_dist: float) -> tuple[float, float]:
    """a, b of 1 / (1 + a x^2b) nearest to 1 up to min_dist and exp(min_dist - x) beyond, by a refined grid."""
    x = np.linspace(1e-6, 3, 300)
    want = np.where(x < min_dist, 1.0, np.exp(min_dist - x))
    a, b, step = 1.5, 1.0, 0.5
    for _ in range(60):
        options = [(a + i * step, b + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1) if a + i * step > 0 and b + j * step > 0]
        best = min(options, key=lambda p: float(((1 / (1 + p[0] * x ** (2 * p[1])) - want) ** 2).sum()))
        step, (a, b) = (step / 2 if best == (a, b) else step), best
    return a, b


def neighbour_embedding(v: np.ndarray, dims: int = 15, neighbours: int = 15, min_dist: float = 0.0, metric: str = "cosine", rounds: int = 200, seed: int = 42) -> np.ndarray:
    """UMAP (McInnes, Healy and Melville 2018): a fuzzy neighbour graph laid out from its leading eigenvectors by sampled attraction and repulsion."""
    n, rng = len(v), np.random.default_rng(seed)
    k = min(neighbours, n - 1)
    if k < 1:
        return np.zeros((n, dims))
    at, dist = _neighbours(v, k, metric)
    weight: dict[tuple[int, int], float] = {}
    for (i, j), w in zip(np.argwhere(np.ones_like(at, bool)), _fuzzy(dist).ravel(), strict=True):
        weight[int(i), int(at[i, j])] = float(w)
    pairs = {(min(p), max(p)) for p in weight}
    joint = np.array([(i, j, (a := weight.get((i, j), 0.0)) + (b := weight.get((j, i), 0.0)) - a * b) for i, j in sorted(pairs)])
    i, j, w = joint[:, 0].astype(int), joint[:, 1].astype(int), joint[:, 2]
    # leading eigenvectors of the normalized graph by orthogonal iteration; the first, of the degrees, is left out
    d, t, x = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
    degree = np.sqrt(np.maximum(np.bincount(d, x, n), 1e-12))
    order = np.argsort(d, kind="stable")
    d, t, x = d[order], t[order], (x / degree[d] / degree[t])[order]
    q = np.linalg.qr(np.concatenate([degree[:, None], rng.normal(size=(n, min(dims, n - 1)))], 1))[0]
    for _ in range(60):
        q = np.linalg.qr(_product(d, t, x, q, n) + q)[0]
    y = np.zeros((n, dims))
    y[:, : q.shape[1] - 1] = q[:, 1 : dims + 1]
    y = 10 * y / max(np.abs(y).max(), 1e-12) + rng.normal(0, 1e-4, y.shape)
    a, b = _curve(min_dist)
    w = w / w.max()
    for r in range(rounds):
        rate = 1 - r / rounds
        use = np.flatnonzero(rng.random(len(w)) < w)
        p, o = np.concatenate([i[use], j[use]]), np.concatenate([j[use], i[use]])
        gap = y[p] - y[o]
        s = (gap * gap).sum(1, keepdims=True)
        move = np.clip(np.where(s > 0, -2 * a * b * np.maximum(s, 1e-12) ** (b - 1) / (1 + a * s**b), 0) * gap, -4, 4)
        shift = np.zeros_like(y)
        np.add.at(shift, p, move)
        for _ in range(5):
            other = rng.integers(0, n, len(p))
            gap = y[p] - y[other]
            s = (gap * gap).sum(1, keepdims=True)
            push = np.clip(2 * b / ((0.001 + s) * (1 + a * s**b)) * gap, -4, 4)
            push[p == other] = 0
            np.add.at(shift, p, push)
        y += rate * np.clip(shift, -4, 4)
    return y


def reduce_neighbours(df: DataFrame, item: str, vector: str, dims: int = 15, neighbours: int = 15, min_dist: float = 0.0, metric: str = "cosine", rounds: int = 200, seed: int = 42) -> DataFrame:
    """item, reduced ARRAY<DOUBLE> by neighbour_embedding (E7); null vectors are left out. At most LIMIT rows, an error beyond it."""
    rows = df.filter(F.col(vector).isNotNull()).select(item, F.col(vector).cast("array<double>").alias("v")).limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"more than {LIMIT} rows; use vectors.reduce_pca")
    rows.sort(key=lambda r: r[0])
    y = neighbour_embedding(np.array([r[1] for r in rows], float), dims, neighbours, min_dist, metric, rounds, seed) if rows else np.zeros((0, dims))
    return df.sparkSession.createDataFrame([(r[0], p) for r, p in zip(rows, y.tolist(), strict=True)], f"{item} {dict(df.dtypes)[item]}, reduced array<double>")


def subwords(word: str, low: int = 3, high: int = 6, buckets: int = 1 << 16) -> list[int]:
    """Buckets of the character n-grams of <word>."""
    w = f"<{word}>"
    return sorted({zlib.crc32(w[i : i + n].encode()) % buckets for n in range(low, high + 1) for i in range(len(w) - n + 1)})


def subword_vectors(sentences: list[list[str]], dims: int = 100, window: int = 5, least: int = 3, epochs: int = 5, negatives: int = 5, rate: float = 0.05, buckets: int = 1 << 16, seed: int = 42) -> dict[str, np.ndarray]:
    """Skip-gram with negative samples where a word is the mean of its own vector and those of its character n-grams
    (Bojanowski et al. 2017), in batches. Words found under `least` times are left out."""
    rng = np.random.default_rng(seed)
    counts = Counter(w for s in sentences for w in s)
    words = sorted(w for w, c in counts.items() if c >= least)
    place = {w: i for i, w in enumerate(words)}
    if not words:
        return {}
    parts = [[i, *[len(words) + b for b in subwords(w, buckets=buckets)]] for i, w in enumerate(words)]
    size = np.array([len(p) for p in parts])
    begin, parts = np.cumsum(size) - size, np.concatenate(parts)
    inner = rng.uniform(-1 / dims, 1 / dims, (len(words) + buckets, dims))
    outer = np.zeros((len(words), dims))
    noise = np.array([counts[w] for w in words], float) ** 0.75
    noise = np.cumsum(noise / noise.sum())
    known = [[place[w] for w in s if w in place] for s in sentences]
    text = np.array([w for s in known for w in s], int)
    of = np.repeat(np.arange(len(known)), [len(s) for s in known])
    reach = rng.integers(1, window + 1, len(text))
    offsets = np.array([o for o in range(-window, window + 1) if o])

    def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words at places of the text, each with every other word around it, sorted by the first."""
        other = at[:, None] + offsets
        inside = (other >= 0) & (other < len(text)) & (np.abs(offsets) <= reach[at][:, None])
        other = other.clip(0, len(text) - 1)
        x, y = np.nonzero(inside & (of[other] == of[at][:, None]) & (text[other] != text[at][:, None]))
        c, o = text[at[x]], text[other[x, y]]
        order = np.argsort(c, kind="stable")
        return c[order], o[order]

    def mean(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of inner that make up the words u, and their mean by word."""
        n = size[u]
        first = np.cumsum(n) - n
        rows = parts[np.arange(n.sum()) + np.repeat(begin[u] - first, n)]
        return rows, np.add.reduceat(inner[rows], first, axis=0) / n[:, None]

    # a batch is the pairs of neighbouring places in a random order, so that its few words are put together once
    many = sum(len(pairs(np.arange(a, min(a + 65536, len(text))))[0]) for a in range(0, len(text), 65536))
    batch = max(1, round(512 * len(text) / max(many, 1)))
    steps = max(1, epochs * -(-len(text) // batch))
    step, columns = 0, np.arange(dims)
    for _ in range(epochs):
        order = rng.permutation(len(text))
        for a in range(0, len(order), batch):
            c, o = pairs(order[a : a + batch])
            rate_now, step = rate * (1 - step / steps), step + 1
            if not len(c):
                continue
            u, starts, n = np.unique(c, return_index=True, return_counts=True)
            rows, h = mean(u)
            h = np.repeat(h, n, axis=0)
            targets = np.concatenate([o[:, None], np.searchsorted(noise, rng.random((len(o), negatives))).clip(0, len(words) - 1)], 1)
            truth = np.zeros(targets.shape)
            truth[:, 0] = 1
            found = outer[targets]
            score = np.matmul(found, h[:, :, None])[:, :, 0]
            g = (truth - 1 / (1 + np.exp(-np.clip(score, -30, 30)))) * rate_now
            share = np.add.reduceat(np.matmul(g[:, None], found)[:, 0], starts, axis=0) / size[u][:, None]
            np.add.at(outer.ravel(), (targets[:, :, None] * dims + columns).ravel(), (g[:, :, None] * h[:, None]).ravel())
            np.add.at(inner.ravel(), (rows[:, None] * dims + columns).ravel(), np.repeat(share, size[u], axis=0).ravel())
    return {w: v for a in range(0, len(words), 4096) for w, v in zip(words[a : a + 4096], mean(np.arange(a, min(a + 4096, len(words))))[1], strict=True)}


def subword_model(sentences: DataFrame, tokens: str = "tokens", dims: int = 100, **options: int) -> DataFrame:
    """word, vector by subword_vectors (E4). At most TOKENS tokens, an error beyond it; sentences are taken in sorted order."""
    rows = sentences.filter(F.size(tokens) > 0).select(tokens)
    if (rows.agg(F.sum(F.size(tokens))).first()[0] or 0) > TOKENS:
        raise ValueError(f"more than {TOKENS} tokens; use vectors.word_vectors")
    found = subword_vectors(sorted([[w for w in r[0] if w is not None] for r in rows.collect()]), dims, **options)
    words = sorted(found)
    values = np.concatenate([found[w] for w in words]) if words else np.zeros(0)
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, dims), pa.int32()), pa.array(values))
    return sentences.sparkSession.createDataFrame(pa.table({"word": pa.array(words, pa.string()), "vector": vectors}), "word string, vector array<double>")


def correlation_topics(d: np.ndarray, t: np.ndarray, docs: int, terms: int, topics: int, anchors: dict[int, int] | None = None, strength: float = 4.0, rounds: int = 200, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """p(topic | document), mutual information of topics and terms (topics x terms), and the weights alpha.

    Binary total correlation explanation with anchors (Ver Steeg and Galstyan 2014, Gallagher et al. 2017): latent binary
    topics chosen so that terms are independent given them. (d, t): the distinct terms t of each document d. A term counts most
    for the topic it tells most about; an anchor (term -> topic) counts `strength` for its own.
    """
    rng, anchors = np.random.default_rng(seed), anchors or {}
    by_doc, by_term = np.lexsort((t, d)), np.lexsort((d, t))
    ones = np.ones(len(d))
    px = np.clip(np.bincount(t, minlength=terms) / docs, 1e-10, 1 - 1e-10)
    fixed = np.zeros((topics, terms), bool)
    for term, topic in anchors.items():
        fixed[topic, term] = True
    alpha = rng.uniform(0, 0.2, (topics, terms))
    alpha[fixed] = strength
    py = rng.uniform(0.3, 0.7, (docs, topics))
    for j in range(topics):  # documents with an anchor begin in its topic
        held = [term for term, topic in anchors.items() if topic == j]
        if held:
            py[:, j] = np.where(np.isin(np.arange(docs), d[np.isin(t, held)]), 0.9, 0.1)
    last, mutual = -np.inf, np.zeros((topics, terms))
    for r in range(rounds):
        p1 = np.clip(py.mean(0), 1e-6, 1 - 1e-6)
        both = _product(t[by_term], d[by_term], ones, py, terms).T / docs  # p(x = 1, y = 1)
        x1 = np.clip(both / p1[:, None], 1e-10, 1 - 1e-10)
        x0 = np.clip((px - both) / (1 - p1)[:, None], 1e-10, 1 - 1e-10)
        mutual = sum(w[:, None] * (x * np.log(x / px) + (1 - x) * np.log((1 - x) / (1 - px))) for w, x in ((p1, x1), (1 - p1, x0)))
        if r:
            best = mutual.max(0)
            sharp = np.exp(np.minimum(5 * r, 50) * (mutual - best) / np.maximum(best, 1e-9))
            alpha = 0.5 * alpha + 0.5 * sharp
            alpha[fixed] = strength
        # log p(y | x) from all terms absent, and what the present ones change
        absent = np.log1p(-x1) - np.log1p(-x0)
        present = np.log(x1) - np.log(x0) - absent
        odds = np.log(p1 / (1 - p1)) + (alpha * absent).sum(1) + _product(d[by_doc], t[by_doc], ones, (alpha * present).T, docs)
        py = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        value = float((np.minimum(alpha, 1) * mutual).sum())
        if r > 20 and abs(value - last) < 1e-5 * max(abs(value), 1e-9):
            break
        last = value
    return py, mutual, alpha


def anchored_correlation(tf: DataFrame, doc: str, anchors: DataFrame | None = None, topics: int = 10, strength: float = 4.0, rounds: int = 200, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(doc, topic, p) and (topic, term, mutual) by correlation_topics (E9). tf: doc, term; anchors: topic INT, term.

    A term that anchors several topics keeps the least. At most ENTRIES pairs of document and term, an error beyond it.
    """
    rows = tf.select(doc, "term").filter("term IS NOT NULL").distinct()
    if rows.count() > ENTRIES:
        raise ValueError(f"more than {ENTRIES} entries; use terms.anchored_topics")
    table = rows.toArrow()
    docs, d = np.unique(table[doc].to_numpy(zero_copy_only=False), return_inverse=True)
    terms, t = np.unique(np.array(table["term"].to_pylist(), object), return_inverse=True)
    held: dict[int, int] = {}
    place = {w: i for i, w in enumerate(terms.tolist())}
    for r in sorted(anchors.select("topic", "term").collect()) if anchors is not None else []:
        if r["term"] in place:
            held.setdefault(place[r["term"]], r["topic"])
            topics = max(topics, r["topic"] + 1)
    spark, kind = tf.sparkSession, dict(tf.dtypes)[doc]
    schemas = f"{doc} {kind}, topic int, p double", "topic int, term string, mutual double"
    if not len(docs):
        return tuple(spark.createDataFrame([], s) for s in schemas)
    py, mutual, _ = correlation_topics(d, t, len(docs), len(terms), topics, held, strength, rounds, seed)
    a = [(x, j, float(py[i, j])) for i, x in enumerate(docs.tolist()) for j in range(topics)]
    owner = mutual.argmax(0)
    b = [(int(held.get(i, owner[i])), w, float(mutual[held.get(i, owner[i]), i])) for i, w in enumerate(terms.tolist())]
    return spark.createDataFrame(a, schemas[0]), spark.createDataFrame(b, schemas[1])
