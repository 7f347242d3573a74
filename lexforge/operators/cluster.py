"""Clustering kernels: per-group ones run distributed, whole-table ones on a bounded number of rows on the driver."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.operators.terms import ranked
from lexforge.session import cut as cut_lineage

LIMIT = 12_000  # rows of a dense distance matrix on one machine


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-9)


def linkage(v: np.ndarray, method: str = "ward") -> np.ndarray:
    """(left, right, height, size) per merge, by nearest-neighbour chains; ward on Euclidean, average on cosine distance."""
    n = len(v)
    if n < 2:
        return np.zeros((0, 4))
    if method == "ward":
        sq = (v * v).sum(1)
        d = np.maximum(sq[:, None] + sq[None] - 2 * v @ v.T, 0)
    else:
        u = _unit(v)
        d = np.clip(1 - u @ u.T, 0, None)
    np.fill_diagonal(d, np.inf)
    size, alive, name = np.ones(n), np.ones(n, bool), np.arange(n)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain = chain[:-2]
        h, na, nb = d[a, b], size[a], size[b]
        if method == "ward":
            new = ((size + na) * d[a] + (size + nb) * d[b] - size * h) / (size + na + nb)
        else:
            new = (na * d[a] + nb * d[b]) / (na + nb)
        merges.append((a, b, h))
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        d[b] = d[:, b] = np.inf
        size[a], alive[b] = na + nb, False
        d[a, ~alive] = np.inf
    order = np.argsort([m[2] for m in merges], kind="stable")
    parent = list(range(n))
    label, count, out = list(range(n)), [1] * n, []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k, i in enumerate(order):
        a, b, h = merges[i]
        ra, rb = find(a), find(b)
        la, lb = sorted((label[ra], label[rb]))
        parent[rb] = ra
        count[ra] += count[rb]
        label[ra] = n + k
        out.append((la, lb, float(np.sqrt(h)) if method == "ward" else float(h), count[ra]))
    return np.array(out)


def cut(z: np.ndarray, n: int, k: int | None = None, height: float | None = None) -> np.ndarray:
    """Labels from 0 in order of first member: k clusters, or all merges up to a height."""
    parent = list(range(2 * n))
    steps = len(z) if k is None else max(0, n - max(k, 1))
    for i in range(min(steps, len(z))):
        if height is not None and z[i, 2] > height:
            break
        parent[int(z[i, 0])] = parent[int(z[i, 1])] = n + i
    roots = []
    for i in range(n):
        while parent[i] != i:
            i = parent[i]
        roots.append(i)
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(r, len(seen)) for r in roots], int)


def row_silhouettes(u: np.ndarray, at: np.ndarray, n: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Of unit vectors in clusters `at`, given all clusters' counts and sums."""
    dist = n[None] - u @ sums.T
    rows = np.arange(len(u))
    own = dist[rows, at] / np.maximum(n[at] - 1, 1)
    other = dist / n[None]
    other[rows, at] = np.inf
    b = other.min(1)
    return np.where(n[at] > 1, (b - own) / np.maximum(np.maximum(own, b), 1e-12), 0.0)


def cosine_silhouette(v: np.ndarray, labels: np.ndarray) -> float:
    u = _unit(v)
    ks, at, n = np.unique(labels, return_inverse=True, return_counts=True)
    if len(ks) < 2:
        return float("nan")
    sums = np.zeros((len(ks), v.shape[1]))
    np.add.at(sums, at, u)
    return float(row_silhouettes(u, at, n, sums).mean())


def consolidate(v: np.ndarray, labels: np.ndarray, least: int = 3, most: int = 6) -> np.ndarray:
    """Clusters under `least` and beyond the `most` largest dissolve into the nearest kept centroid; renumbered by size."""
    ks, n = np.unique(labels, return_counts=True)
    order = np.lexsort((ks, -n))
    kept = [k for k in ks[order] if n[ks == k][0] >= least][:most]
    if len(kept) <= 1:
        return np.zeros(len(labels), int)
    centres = _unit(np.stack([v[labels == k].mean(0) for k in kept]))
    near = (v @ centres.T).argmax(1)
    size = np.bincount(near, minlength=len(kept))
    rank = np.empty(len(kept), int)
    rank[np.lexsort((np.arange(len(kept)), -size))] = np.arange(len(kept))
    return rank[near]


def senses_of(v: np.ndarray, least: int = 10, distance: float = 0.55, min_silhouette: float = 0.05) -> tuple[np.ndarray, float]:
    """Sense labels of one lemma's occurrence vectors and their silhouette (NaN for one sense)."""
    one = np.zeros(len(v), int), float("nan")
    if len(v) < least:
        return one
    v = _unit(v)
    labels = consolidate(v, cut(linkage(v, "average"), len(v), height=distance))
    if len(set(labels.tolist())) < 2:
        return one
    s = cosine_silhouette(v, labels)
    return one if s < min_silhouette else (labels, s)


def merge_means(sums: np.ndarray, n: np.ndarray, height: float) -> np.ndarray:
    """Labels of groups of unit vectors, given by their sums and counts, by average linkage up to a height.

    The mean cosine distance of two groups follows from sums and counts, so no matrix of distances is held.
    """
    s, n = sums.astype(float).copy(), n.astype(float).copy()
    at, parent, chain = np.arange(len(s)), np.arange(len(s)), []
    while len(at) > 1 or chain:
        if not chain:
            chain = [0]
        a = chain[-1]
        d = 1 - (s @ s[a]) / (n * n[a])
        d[a] = np.inf
        b = int(np.argmin(d)) if len(d) > 1 else a
        before = chain[-2] if len(chain) > 1 else None
        if before is not None and d[before] <= d[b]:
            b = before
        if d[b] > height and before is None:  # a group far from all others stays so: distances of merged groups are means
            s, n, at = (np.delete(x, a, 0) for x in (s, n, at))
            chain = []
        elif b != before:
            chain.append(b)
        elif d[b] > height:
            gone = chain[-2:]
            s, n, at = (np.delete(x, gone, 0) for x in (s, n, at))
            chain = []
        else:
            keep, drop = min(a, b), max(a, b)
            s[keep] += s[drop]
            n[keep] += n[drop]
            parent[at[drop]] = at[keep]
            s, n, at = (np.delete(x, drop, 0) for x in (s, n, at))
            chain = [c - (c > drop) for c in chain[:-2]]
    for x in range(len(parent)):
        while parent[x] != parent[parent[x]]:
            parent[x] = parent[parent[x]]
    return np.unique(parent, return_inverse=True)[1]


def induce_senses(occurrences: DataFrame, lemma: str, row: str, vector: str, slice_rows: int = 4000) -> DataFrame:
    """lemma, row, sense_id, silhouette: average-linkage senses of each lemma on its own.

    A lemma of more than slice_rows occurrences is dealt by hash into slices of that size. Average linkage up to the
    height runs in each slice and then over the clusters of all slices, from their sums and counts; consolidation and
    the silhouette test then apply to all rows of the lemma, so hot and other lemmas obey one rule and only the order
    of merges differs. No task holds more than one slice's distance matrix or one lemma's cluster sums, and no row
    is dropped. Null vectors are left out.
    """
    kinds = dict(occurrences.dtypes)
    one, key = f"{lemma} {kinds[lemma]}, {row} {kinds[row]}", f"{lemma} {kinds[lemma]}"
    rows = occurrences.filter(F.col(vector).isNotNull() & F.col(lemma).isNotNull()).select(lemma, row, F.col(vector).cast("array<double>").alias("v"))
    hot = cut_lineage(rows.groupBy(lemma).agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices")).filter("slices > 1"), "hot")

    def whole(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(row)
        labels, s = senses_of(np.stack(p["v"].to_numpy()).astype(float))
        return pd.DataFrame({lemma: p[lemma], row: p[row], "sense_id": labels, "silhouette": s})

    cold = rows.join(F.broadcast(hot), lemma, "left_anti").groupBy(lemma).applyInPandas(whole, f"{one}, sense_id int, silhouette double")
    if not hot.head(1):
        return cold.withColumn("silhouette", F.when(~F.isnan("silhouette"), F.col("silhouette")))
    dealt = rows.join(F.broadcast(hot), lemma).withColumn("slice", F.pmod(F.xxhash64(row), F.col("slices")).cast("int"))

    def one_slice(p: pd.DataFrame) -> pd.DataFrame:
        u = _unit(np.stack(p.sort_values(row)["v"].to_numpy()).astype(float))
        labels = cut(linkage(u, "average"), len(u), height=0.55)
        sums = np.zeros((labels.max() + 1, u.shape[1]))
        np.add.at(sums, labels, u)
        return pd.DataFrame({lemma: p[lemma].iloc[0], "slice": p["slice"].iloc[0], "local": np.arange(len(sums)), "n": np.bincount(labels), "sum": sums.tolist()})

    def centres_of(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["slice", "local"])
        s, n = np.stack(p["sum"].to_numpy()).astype(float), p["n"].to_numpy()
        joint = merge_means(s, n, 0.55)
        size = np.bincount(joint, weights=n)
        kept = [k for k in np.lexsort((np.arange(len(size)), -size)) if size[k] >= 3][:6]
        centres = [_unit(s[joint == k].sum(0)).tolist() for k in kept] if len(kept) > 1 else [_unit(s.sum(0)).tolist()]
        return pd.DataFrame({lemma: [p[lemma].iloc[0]], "centres": [centres]})

    parts = dealt.groupBy(lemma, "slice").applyInPandas(one_slice, f"{key}, slice int, local int, n bigint, sum array<double>")
    # at most six centres for each hot lemma, and there is at most one such lemma to slice_rows rows
    centres = cut_lineage(parts.groupBy(lemma).applyInPandas(centres_of, f"{key}, centres array<array<double>>"), "centres")

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            for _, g in p.groupby(lemma):
                near = (_unit(np.stack(g["v"].to_numpy())) @ np.stack(g["centres"].iloc[0]).T).argmax(1)
                yield pd.DataFrame({lemma: g[lemma], row: g[row], "v": g["v"], "near": near})

    near = rows.join(F.broadcast(centres), lemma).mapInPandas(nearest, f"{one}, v array<double>, near int")

    def partial_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            for (k, c), g in p.groupby([lemma, "near"]):
                yield pd.DataFrame({lemma: [k], "near": [c], "n": [len(g)], "sum": [_unit(np.stack(g["v"].to_numpy())).sum(0).tolist()]})

    def total(p: pd.DataFrame) -> pd.DataFrame:
        g = [(c, int(q["n"].sum()), np.stack(q["sum"].to_numpy()).sum(0).tolist()) for c, q in p.groupby("near")]
        g.sort(key=lambda x: (-x[1], x[0]))  # senses are numbered by size
        return pd.DataFrame({lemma: [p[lemma].iloc[0]], "near_of": [[x[0] for x in g]], "ns": [[x[1] for x in g]], "sums": [[x[2] for x in g]]})

    sums = near.mapInPandas(partial_sums, f"{key}, near int, n bigint, sum array<double>")
    senses = cut_lineage(sums.groupBy(lemma).applyInPandas(total, f"{key}, near_of array<int>, ns array<bigint>, sums array<array<double>>"), "senses")

    def silhouettes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            for k, g in p.groupby(lemma):
                n, s, names = np.array(g["ns"].iloc[0]), np.stack(g["sums"].iloc[0]), list(g["near_of"].iloc[0])
                values = row_silhouettes(_unit(np.stack(g["v"].to_numpy())), np.array([names.index(c) for c in g["near"]]), n, s)
                yield pd.DataFrame({lemma: [k], "s": [values.sum()], "n": [len(g)]})

    score = near.join(F.broadcast(senses.filter(F.size("ns") > 1)), lemma).mapInPandas(silhouettes, f"{key}, s double, n bigint").groupBy(lemma).agg((F.sum("s") / F.sum("n")).alias("sil")).filter("sil >= 0.05")
    verdict = senses.select(lemma, "near_of").join(F.broadcast(score), lemma, "left")
    split = F.when(F.col("sil").isNull(), 0).otherwise(F.array_position("near_of", F.col("near")) - 1).cast("int")
    found = near.drop("v").join(F.broadcast(verdict), lemma).select(lemma, row, split.alias("sense_id"), F.col("sil").alias("silhouette"))
    return cold.withColumn("silhouette", F.when(~F.isnan("silhouette"), F.col("silhouette"))).union(found)


def _gather(df: DataFrame, item: str, vector: str) -> tuple[list, np.ndarray]:
    rows = df.filter(F.col(vector).isNotNull()).select(item, F.col(vector).cast("array<double>").alias("v")).limit(LIMIT + 1).collect()
    if len(rows) > LIMIT:
        raise ValueError(f"more than {LIMIT} rows: cluster types or centroids, or use bisecting_kmeans")
    rows.sort(key=lambda r: r[0])
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def linkage_cuts(df: DataFrame, item: str, vector: str, cuts: tuple[int, ...] = (12, 25, 50, 100, 150, 200, 250), method: str = "ward") -> DataFrame:
    """item, k, label: one row per item and number of clusters; ward labels begin at 1, average ones at 0.

    Agglomeration needs all distances: a driver step over at most LIMIT rows, an error beyond it.
    """
    ids, v = _gather(df, item, vector)
    z = linkage(v, method)
    out = [(i, k, int(x) + (method == "ward")) for k in cuts for i, x in zip(ids, cut(z, len(ids), k), strict=True)]
    return df.sparkSession.createDataFrame(out, f"{item} {dict(df.dtypes)[item]}, k int, label int")


def core_distances(d: np.ndarray, min_samples: int) -> np.ndarray:
    """From a matrix of distances with zeros in the diagonal; a point is its own first neighbour."""
    return np.partition(d, min(max(min_samples, 1), len(d)) - 1, 1)[:, min(max(min_samples, 1), len(d)) - 1]


def density_labels(v: np.ndarray, min_size: int = 5, min_samples: int = 1, metric: str = "euclidean") -> np.ndarray:
    """HDBSCAN with leaf selection: mutual-reachability spanning tree, condensed tree, leaves; -1 is noise.

    A point's core distance is that to its min_samples-th nearest point, itself counted as the first.
    """
    n = len(v)
    if n < 2 * min_size:
        return np.full(n, -1)
    if metric == "cosine":
        u = _unit(v)
        d = np.clip(1 - u @ u.T, 0, None)
    else:
        sq = (v * v).sum(1)
        d = np.sqrt(np.maximum(sq[:, None] + sq[None] - 2 * v @ v.T, 0))
    np.fill_diagonal(d, 0)
    core = core_distances(d, min_samples)
    d = np.maximum(d, np.maximum(core[:, None], core[None]))
    inside, best, link = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int)
    at, edges = 0, []
    for _ in range(n - 1):
        inside[at] = True
        closer = (d[at] < best) & ~inside
        best[closer], link[closer] = d[at][closer], at
        best[inside] = np.inf
        at = int(np.argmin(best))
        edges.append((link[at], at, best[at]))
    edges.sort(key=lambda e: e[2])
    parent, node = list(range(n)), list(range(n))
    children: dict[int, tuple[int, int, float]] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sizes = dict.fromkeys(range(n), 1)
    for k, (a, b, h) in enumerate(edges):
        ra, rb = find(a), find(b)
        new = n + k
        children[new] = (node[ra], node[rb], h)
        sizes[new] = sizes[node[ra]] + sizes[node[rb]]
        parent[rb] = ra
        node[ra] = new
    labels, leaves = np.full(n, -1), 0
    todo = [n + len(edges) - 1]
    root = todo[0]
    while todo:
        top = todo.pop()
        x = top
        while True:  # follow the larger side down until a true split or the end
            if x < n:
                break
            a, b, _ = children[x]
            big = [c for c in (a, b) if sizes[c] >= min_size]
            if len(big) == 2:
                todo += big
                x = -1
                break
            if not big:
                break
            x = big[0]
        if x >= 0 and top != root:
            stack = [top]
            while stack:
                y = stack.pop()
                if y < n:
                    labels[y] = leaves
                else:
                    stack += children[y][:2]
            leaves += 1
    return labels


def density_clusters(df: DataFrame, item: str, vector: str, min_size: int = 5, min_samples: int = 1, metric: str = "euclidean") -> DataFrame:
    """item, label (-1 noise) of density_labels; a driver step over at most LIMIT rows, an error beyond it."""
    ids, v = _gather(df, item, vector)
    labels = density_labels(v, min_size, min_samples, metric)
    return df.sparkSession.createDataFrame([(i, int(x)) for i, x in zip(ids, labels, strict=True)], f"{item} {dict(df.dtypes)[item]}, label int")


def bisecting_kmeans(df: DataFrame, item: str, vector: str, k: int, seed: int = 42) -> DataFrame:
    """item, label: MLlib bisecting k-means, the way beyond LIMIT rows (another method than linkage)."""
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.filter(F.col(vector).isNotNull()).select(item, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return BisectingKMeans(k=k, seed=seed).fit(rows).transform(rows).select(item, F.col("prediction").alias("label"))


def relabel_by_size(df: DataFrame, label: str) -> DataFrame:
    """df with label renumbered from 0 by descending size, ties by the old label; noise stays -1, null stays null."""
    noise = F.col(label).cast("string") == "-1"
    size = df.filter(~noise).groupBy(label).agg(F.count("*").alias("n"))
    ranks = ranked(size, F.desc("n"), F.col(label)).select(label, (F.col("rank") - 1).cast("int").alias("_new"))
    return df.join(ranks, label, "left").withColumn(label, F.when(F.col(label).isNotNull(), F.coalesce("_new", F.lit(-1)))).drop("_new")


def _neighbours(edges: list[tuple[int, int, float]]) -> dict[int, dict[int, float]]:
    graph: dict[int, dict[int, float]] = {x: {} for x in sorted({x for a, b, _ in edges for x in (a, b)})}
    for a, b, w in edges:
        graph[a][b] = graph[a].get(b, 0) + w
        graph[b][a] = graph[b].get(a, 0) + w
    return graph


def _ties(graph: dict[int, dict[int, float]], x: int, where: dict[int, int]) -> dict[int, float]:
    out: dict[int, float] = {}
    for y, w in graph[x].items():
        if y != x:
            out[where[y]] = out.get(where[y], 0.0) + w
    return out


def _move(graph: dict, degree: dict, where: dict, price: float, rng: np.random.Generator) -> None:
    """Nodes go to the community of greatest gain until none gains; the neighbours of one that went are looked at again."""
    mass: dict[int, float] = {}
    for x, c in where.items():
        mass[c] = mass.get(c, 0.0) + degree[x]
    queue = deque(rng.permutation(sorted(graph)).tolist())
    waiting = set(queue)
    fresh = max(mass) + 1
    while queue:
        x = queue.popleft()
        waiting.discard(x)
        here, ties = where[x], _ties(graph, x, where)
        mass[here] -= degree[x]
        gain = {c: w - price * degree[x] * mass[c] for c, w in ties.items()}
        stay = gain.get(here, -price * degree[x] * mass[here])
        best = max(sorted(gain), key=gain.get, default=here)
        top = gain.get(best, stay)
        if max(top, 0.0) <= stay + 1e-12:
            best = here
        elif top < -1e-12:  # alone is better than with any neighbour
            best, fresh = fresh, fresh + 1
        mass[best] = mass.get(best, 0.0) + degree[x]
        if best != here:
            where[x] = best
            for y in graph[x]:
                if y != x and where[y] != best and y not in waiting:
                    waiting.add(y)
                    queue.append(y)


def _refine(graph: dict, degree: dict, where: dict, price: float, rng: np.random.Generator, theta: float) -> dict[int, int]:
    """A finer partition: within each community, well connected single nodes join well connected parts they don't lose by,
    at random in proportion to exp(gain / theta). So every part is connected."""
    part = {x: x for x in graph}
    groups: dict[int, list[int]] = {}
    for x in sorted(graph):
        groups.setdefault(where[x], []).append(x)
    for c, nodes in sorted(groups.items()):
        whole = sum(degree[x] for x in nodes)
        inside = {x: sum(w for y, w in graph[x].items() if y != x and where[y] == c) for x in nodes}
        mass, cut_weight, size = {x: degree[x] for x in nodes}, dict(inside), dict.fromkeys(nodes, 1)
        for x in rng.permutation(nodes).tolist():
            if size[part[x]] > 1 or inside[x] < price * degree[x] * (whole - degree[x]) - 1e-12:
                continue
            ties: dict[int, float] = {}
            for y, w in graph[x].items():
                if y != x and where[y] == c:
                    ties[part[y]] = ties.get(part[y], 0.0) + w
            options = [(x, 0.0)]
            for p, w in sorted(ties.items()):
                gain = w - price * degree[x] * mass[p]
                if gain >= 0 and cut_weight[p] >= price * mass[p] * (whole - mass[p]) - 1e-12:
                    options.append((p, gain))
            g = np.array([o[1] for o in options]) / theta
            chance = np.exp(g - g.max())
            p = options[int(rng.choice(len(options), p=chance / chance.sum()))][0]
            if p != x:
                cut_weight[p] += inside[x] - 2 * ties[p]
                mass[p] += degree[x]
                size[p] += 1
                size[x] = 0
                part[x] = p
    return part


def leiden(edges: list[tuple[int, int, float]], resolution: float = 3.0, seed: int = 42, theta: float = 0.01) -> dict[int, int]:
    """Communities of a weighted graph by moves, refinement and aggregation until nothing changes (G3); each is connected.

    After Traag, Waltman and van Eck, From Louvain to Leiden (2019). Labels from 0 by descending size, ties by node.
    """
    rng, graph = np.random.default_rng(seed), _neighbours(edges)
    if not graph:
        return {}
    total = sum(w for n in graph.values() for w in n.values()) or 1.0
    price = resolution / total
    member, where = {x: x for x in graph}, {x: x for x in graph}
    while True:
        degree = {x: sum(n.values()) for x, n in graph.items()}
        _move(graph, degree, where, price, rng)
        part = _refine(graph, degree, where, price, rng, theta * max(degree.values()))
        if len(set(part.values())) == len(graph):
            break
        member = {x: part[c] for x, c in member.items()}
        merged: dict[int, dict[int, float]] = {c: {} for c in set(part.values())}
        for x, n in graph.items():
            for y, w in n.items():
                a, b = part[x], part[y]
                merged[a][b] = merged[a].get(b, 0.0) + w
        graph, where = merged, {p: where[p] for p in merged}
    found = {x: where[c] for x, c in member.items()}
    sizes, least = Counter(found.values()), {}
    for x, c in sorted(found.items()):
        least.setdefault(c, x)
    ranks = {c: i for i, c in enumerate(sorted(sizes, key=lambda c: (-sizes[c], least[c])))}
    return {x: ranks[c] for x, c in found.items()}


def communities(edges: DataFrame, resolution: float = 3.0, seed: int = 42, most: int = 2_000_000) -> DataFrame:
    """item, label by leiden over a kNN graph of types; a driver step on at most `most` edges, an error beyond it."""
    rows = edges.select("src", "dst", "weight").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges; use MLlib's PowerIterationClustering")
    found = leiden([tuple(r) for r in rows], resolution, seed)
    return edges.sparkSession.createDataFrame(list(found.items()), f"item {dict(edges.dtypes)['src']}, label int")
