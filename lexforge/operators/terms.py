"""Vocabulary, term weights, windows and topics."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from multiprocessing.connection import Client, Listener

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions.text import window_id
from lexforge.functions.vectors import labelled
from lexforge.operators.skew import join_stats
from lexforge.session import cut

# English function words left out of label terms.
ENGLISH_STOPS = tuple("a about after all also an and any are as at be been but by can do for from had has have he her him his how i if in into is it its may me more most my no nor not of off on one only or other our out over she should so some such than that the their them then there these they this those through to too under until up upon very was we were what when where which while who whom whose why will with within without would you your".split())


def term_counts(df: DataFrame, terms: str, by: list[str] | None = None) -> DataFrame:
    """by..., term, n of the array column terms (A1, A2). Null and empty terms don't count."""
    by = by or []
    return df.select(*by, F.explode(terms).alias("term")).filter("term <> ''").groupBy(*by, "term").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, stops: DataFrame | None = None, least: int = 5) -> DataFrame:
    """term, n, rank: terms of at least `least`, without stop words (column term), most frequent first, ties by term."""
    kept = counts.filter(F.col("n") >= least)
    if stops is not None:
        kept = kept.join(stops.select("term").distinct(), "term", "left_anti")
    return ranked(kept, F.desc("n"), F.col("term"))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank from 1 in a total order, by a sort over ranges: a row's rank is its place in its partition plus the
    sizes of the partitions before, one number each. The sorted rows are written once, so that both passes see the same."""
    placed = cut(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return placed.join(F.broadcast(sizes), "_part").withColumn("rank", F.col("_before") + place + 1).drop("_part", "_at", "_before")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in the order given (L1); with a limit per group before the sort's shuffle ends."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def context_lemmas(tokens: DataFrame, passage: str, lemma: str, stops: tuple[str, ...], k: int = 12) -> DataFrame:
    """lemma, context, n, rank: the k lemmas found most around each lemma, ties by name.

    Every occurrence of a lemma adds the counts of its whole passage, so n sums the product of both counts over the
    passages. Stop lemmas, empty ones and the lemma itself are left out. Pairs are formed inside a passage's row.
    """
    n = tokens.filter((F.col(lemma) != "") & ~F.col(lemma).isin(*stops)).groupBy(passage, F.col(lemma).alias("l")).agg(F.count("*").alias("c"))
    p = n.groupBy(passage).agg(F.collect_list(F.struct("l", "c")).alias("_x"))
    pairs = p.select("_x", F.explode("_x").alias("a")).select("a", F.explode("_x").alias("b")).filter("a.l <> b.l")
    s = pairs.groupBy(F.col("a.l").alias("lemma"), F.col("b.l").alias("context")).agg(F.sum(F.col("a.c") * F.col("b.c")).alias("n"))
    return top_k(s, ["lemma"], [F.desc("n"), F.col("context")], k)


def class_words(text: Column, stops: tuple[str, ...] = ENGLISH_STOPS) -> Column:
    """Lower-case words of two or more Latin letters without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z][a-z]+)\b"), F.lit(1)), lambda w: ~w.isin(*stops))


def words_and_pairs(words: Column) -> Column:
    """The words and then each two that follow each other; words should be a plain column, as it is used several times."""
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.slice(pairs, 1, F.greatest(F.size(words) - 1, F.lit(0))))


def class_tfidf(df: DataFrame, cluster: str, text: str, stops: tuple[str, ...] = ENGLISH_STOPS) -> DataFrame:
    """cluster, term, score: tf over all terms of the cluster times ln(1 + clusters / clusters with the term).

    Noise (-1) and null clusters are left out; the number of clusters counts those with a text, even of no term.
    """
    rows = df.filter(labelled(cluster))
    words = rows.select(cluster, class_words(F.coalesce(F.col(text), F.lit("")), stops).alias("_w"))
    # written once: totals, spread and scores read the counts, not the texts
    tf = cut(term_counts(words.select(cluster, words_and_pairs(F.col("_w")).alias("t")), "t", [cluster]), "tf")
    totals = tf.groupBy(cluster).agg(F.sum("n").alias("total"))
    spread = tf.groupBy("term").agg(F.count("*").alias("df"))
    clusters = rows.agg(F.countDistinct(cluster)).scalar()
    return join_stats(tf.join(totals, cluster), spread, "term", "df", cluster).select(cluster, "term", (F.col("n") / F.col("total") * F.log(1 + clusters / F.col("df"))).alias("score"))


def _chosen(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """cluster, name of rows (cluster, term) that come cluster by cluster, best term first."""
    at, seen, names, out = None, False, [], ([], [])

    def close() -> None:
        out[0].append(at)
        out[1].append(", ".join(names))

    for b in batches:
        kind = b.schema.field(0).type
        for c, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if not seen or c != at:
                if seen:
                    close()
                at, seen, names = c, True, []
            if len(names) < top and not any(t in x or x in t for x in names):
                names.append(t)
        yield pa.record_batch([pa.array(out[0], kind), pa.array(out[1], pa.string())], names=["_c", "name"])
        out = ([], [])
    if seen:
        close()
        yield pa.record_batch([pa.array(out[0], kind), pa.array(out[1], pa.string())], names=["_c", "name"])


def name_clusters(scores: DataFrame, cluster: str, top: int = 4) -> DataFrame:
    """cluster, name: the best terms joined by ', ', skipping a term that contains or is contained in one chosen before.

    A cluster's terms are walked from the best on until `top` are chosen, in sorted order and one row at a time, so
    nothing is gathered; '(unnamed)' if none has a score over 0.
    """
    kept = scores.filter("score > 0").select(F.col(cluster).alias("_c"), "term", F.round("score", 12).alias("_s"))
    walked = kept.repartition("_c").sortWithinPartitions("_c", F.desc("_s"), "term").select("_c", "term")
    chosen = walked.mapInArrow(lambda b: _chosen(b, top), f"_c {dict(scores.dtypes)[cluster]}, name string")
    every = scores.select(cluster).distinct()
    return every.join(chosen, F.col(cluster).eqNullSafe(F.col("_c")), "left").select(cluster, F.coalesce("name", F.lit("(unnamed)")).alias("name"))


def tfidf(df: DataFrame, doc: str, tokens: str, min_df: int = 3) -> DataFrame:
    """doc, term, weight: tf * (ln((1 + n) / (1 + df)) + 1), each document's weights scaled to length 1.

    tokens holds lower-case tokens; n counts all documents, those without tokens included.
    """
    tf = cut(term_counts(df, tokens, [doc]), "tf")
    spread = tf.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= min_df)
    n = df.agg(F.count("*")).scalar()
    raw = join_stats(tf, spread, "term", "df", doc).select(doc, "term", (F.col("n") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)).alias("w"))
    return raw.select(doc, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))).alias("weight"))


def windows(df: DataFrame, keys: list[str], line: str, term: str, size: int = 30, least: int = 5) -> DataFrame:
    """keys..., window, terms, n: the terms of each stretch of `size` lines that has at least `least`.

    Terms are sorted, so the result doesn't depend on the order of rows. Null lines and terms are left out.
    """
    rows = df.filter(F.col(line).isNotNull() & F.col(term).isNotNull())
    return rows.groupBy(*keys, window_id(F.col(line), size).alias("window")).agg(F.sort_array(F.collect_list(term)).alias("terms"), F.count("*").alias("n")).filter(F.col("n") >= least)


def prevalence(df: DataFrame, keys: list[str], topic: str, weight: str) -> DataFrame:
    """keys..., topic, share: a topic's weight over all weight of the key; 0 where that is 0."""
    sums = df.groupBy(*keys, topic).agg(F.sum(weight).alias("w"))
    total = F.sum("w").over(Window.partitionBy(*keys))
    return sums.select(*keys, topic, F.when(total != 0, F.col("w") / total).otherwise(0.0).alias("share"))


def _product(at: np.ndarray, other: np.ndarray, x: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
    """The product of the n-row sparse matrix with entries x at (at, other), sorted by at, and m."""
    out = np.zeros((n, m.shape[1]))
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        rows, columns = at[first], np.ascontiguousarray(m.T)
        for j in range(m.shape[1]):  # a column at a time, as sums over neighbouring numbers are several times faster
            out[rows, j] = np.add.reduceat(x * columns[j][other], first)
    return out


class Share:
    """A block of the columns of a matrix, `part` of several that are worked on at the same time: `columns` are their places
    among `total` in all, and gather(array) gives the arrays of all blocks in order, the same in every block."""

    def __init__(self, columns: np.ndarray, total: int, part: int = 0, gather: Callable[[np.ndarray], list[np.ndarray]] = lambda a: [a]) -> None:
        self.columns, self.total, self.part, self.gather = columns, total, part, gather

    def sum(self, a: np.ndarray) -> np.ndarray:
        return sum(self.gather(a))

    def qr(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """This block's rows of Q, and R, of the blocks' rows under each other."""
        q, r = np.linalg.qr(a)
        all_r = self.gather(r)
        joint, r = np.linalg.qr(np.concatenate(all_r))
        first = sum(map(len, all_r[: self.part]))
        return q @ joint[first : first + len(all_r[self.part])], r

    def normal(self, width: int, seed: int) -> np.ndarray:
        """This block's rows of a random matrix that is the same however the columns are dealt out."""
        rng, out = np.random.default_rng(seed), np.empty((len(self.columns), width))
        for at in range(0, self.total, 65536):
            rows = rng.normal(size=(min(65536, self.total - at), width))
            here = (self.columns >= at) & (self.columns < at + 65536)
            out[here] = rows[self.columns[here] - at]
        return out


def _svd(d: np.ndarray, t: np.ndarray, x: np.ndarray, rows: int, cols: int, k: int, seed: int = 42, power: int = 8, share: Share | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k singular triples of a sparse matrix by a random range and power iterations; of v the block's columns."""
    share = share or Share(np.arange(cols), cols)
    by_row, by_col = np.argsort(d, kind="stable"), np.argsort(t, kind="stable")
    left = lambda m: share.sum(_product(d[by_row], t[by_row], x[by_row], m, rows))
    right = lambda m: share.qr(_product(t[by_col], d[by_col], x[by_col], m, cols))
    q = np.linalg.qr(left(share.normal(min(k + 10, rows, share.total), seed)))[0]
    for _ in range(power):
        q = np.linalg.qr(left(right(q)[0]))[0]
    b, r = right(q)
    u, s, v = np.linalg.svd(r.T, full_matrices=False)
    return (q @ u)[:, :k], s[:k], (v @ b.T)[:k]


def factorise(d: np.ndarray, t: np.ndarray, x: np.ndarray, rows: int, cols: int, k: int, rounds: int = 500, tolerance: float = 1e-4, seed: int = 42, share: Share | None = None) -> tuple[np.ndarray, np.ndarray]:
    """W (rows x k), H (k x cols) of a sparse non-negative matrix: coordinate descent on the squared error from the
    non-negative parts of the singular vectors (Boutsidis and Gallopoulos 2008), until the projected gradient has
    fallen to `tolerance` of that of the first round.

    With share, (d, t, x) and H are a block of `cols` columns. Blocks exchange sums of W's size once a round, every block
    keeping all of W; they end together, as they go by the same gathered numbers.
    """
    share = share or Share(np.arange(cols), cols)
    u, s, v = _svd(d, t, x, rows, cols, k, seed, share=share)
    w, h = np.zeros((rows, k)), np.zeros((k, cols))
    squares = share.sum(np.stack([(np.maximum(v, 0) ** 2).sum(1), (np.maximum(-v, 0) ** 2).sum(1)]))
    for j in range(len(s)):
        a, b = u[:, j], v[j]
        sides = [(np.maximum(sign * a, 0), np.maximum(sign * b, 0), np.sqrt(n)) for sign, n in zip((1, -1), squares[:, j], strict=True)]
        p, q, n = (np.abs(a), np.abs(b), np.sqrt(squares[:, j].sum())) if j == 0 else max(sides, key=lambda side: np.linalg.norm(side[0]) * side[2])
        size = np.linalg.norm(p) * n
        if size > 0:
            scale = np.sqrt(s[j] * size)
            w[:, j], h[j] = scale * p / np.linalg.norm(p), scale * q / n
    w[w < 1e-6] = 0
    h[h < 1e-6] = 0
    by_row, by_col = np.argsort(d, kind="stable"), np.argsort(t, kind="stable")
    of_row, of_col = (d[by_row], t[by_row], x[by_row]), (t[by_col], d[by_col], x[by_col])

    def descend(f: np.ndarray, gram: np.ndarray, target: np.ndarray) -> float:
        moved = 0.0
        for j in range(k):
            slope = f @ gram[:, j] - target[:, j]
            moved += float(np.abs(np.where(f[:, j] == 0, np.minimum(slope, 0), slope)).sum())
            if gram[j, j] > 0:
                f[:, j] = np.maximum(f[:, j] - slope / gram[j, j], 0)
        return moved

    first, ht, moved = None, np.ascontiguousarray(h.T), (0.0, 0.0)
    for r in range(rounds):
        every = share.gather(np.concatenate([_product(*of_row, ht, rows), ht.T @ ht, np.full((1, k), moved[0]), np.full((1, k), moved[1])]))
        if r:
            last = every[0][-2, 0] + sum(e[-1, 0] for e in every)
            first = last if first is None else first
            if last <= tolerance * first:
                break
        sums = sum(every)
        on_rows = descend(w, sums[rows:-2], sums[:rows])
        moved = on_rows, descend(ht, w.T @ w, _product(*of_col, w, cols))
    return w, ht.T


#: Entries of the table for each task that factorises, and bytes that the tasks exchange in a round.
TASK_ENTRIES, ROUND_BYTES = 20_000, 64 << 20


def _meet() -> tuple[int, Callable[[np.ndarray], list[np.ndarray]]]:
    """This task's place in a barrier stage and a function that gives the arrays of all its tasks, through the first task.

    Spark's allGather takes a second a call, so it only tells where the first task listens; a lost task ends the others.
    """
    context = BarrierTaskContext.get()
    me, hosts = context.partitionId(), [i.address.rsplit(":", 1)[0] for i in context.getTaskInfos()]
    key = os.urandom(16)
    listener = Listener((hosts[0], 0), backlog=len(hosts), authkey=key) if me == 0 else None
    port, key = json.loads(context.allGather(json.dumps([listener.address[1], key.hex()] if listener else None))[0])
    if listener is None:
        to = Client((hosts[0], port), authkey=bytes.fromhex(key))
        to.send(me)

        def ask(a: np.ndarray) -> list[np.ndarray]:
            to.send(a)
            return to.recv()

        return me, ask
    others = {(c := listener.accept()).recv(): c for _ in hosts[1:]}

    def answer(a: np.ndarray) -> list[np.ndarray]:
        every = [a, *[others[i].recv() for i in range(1, len(hosts))]]
        for c in others.values():
            c.send(every)
        return every

    return me, answer


def _slots(spark: SparkSession) -> int:
    """Tasks that can run at the same time, 1 where the number may change."""
    if spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    sc = spark.sparkContext._jsc.sc()
    return max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


def nmf_topics(weights: DataFrame, doc: str, topics: int = 20, rounds: int = 500, seed: int = 42, documents: int = 20_000, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc, topic, weight) and (topic, term, weight): Frobenius NMF of a tf-idf table, as by factorise.

    The terms and their entries are dealt out to tasks of one barrier stage (`parts`, by default as many as entries
    need and run at once), so any number of terms will do; none comes to the driver. Every task holds the documents'
    factor, as documents are windows of a corpus, about a thousand: more than `documents` are an error. Beyond that
    use als_topics.
    """
    spark, kind = weights.sparkSession, dict(weights.dtypes)[doc]
    rows = cut(weights.select(F.col(doc).alias("_doc"), "term", F.col("weight").cast("double").alias("x")), "weights")
    entries, n = rows.agg(F.count("*"), F.countDistinct("_doc")).first()
    if n > documents:
        raise ValueError("the table is too large: more documents than a task can hold; use als_topics")
    place = lambda c: ranked(rows.select(c).filter(F.col(c).isNotNull()).distinct(), F.col(c)).select(c, (F.col("rank") - 1).cast("long").alias(f"_{c}_at"))
    docs, words = place("_doc"), place("term")
    m = words.count()
    parts = parts or min(_slots(spark), 1 + entries // TASK_ENTRIES, max(1, ROUND_BYTES // (11 * topics * max(n, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        d, t, x = (np.concatenate([b.column(i).to_numpy() for b in got]) if got else np.zeros(0, kind) for i, kind in enumerate((np.int64, np.int64, np.float64)))
        order = np.lexsort((t, d))
        columns, t = np.unique(t, return_inverse=True)
        share = Share(columns, m)
        if parts > 1:
            share = Share(columns, m, *_meet())
        w, h = factorise(d[order], t[order], x[order], n, len(columns), topics, rounds, seed=seed, share=share) if m else (np.zeros((0, topics)), np.zeros((topics, 0)))
        topic, at = np.nonzero(h > 1e-9)
        yield pa.record_batch([pa.array(np.full(len(at), 1, np.int32)), pa.array(columns[at]), pa.array(topic.astype(np.int32)), pa.array(h[topic, at])], names=["_side", "_at", "topic", "weight"])
        if share.part == 0:
            yield pa.record_batch([pa.array(np.zeros(w.size, np.int32)), pa.array(np.repeat(np.arange(len(w)), topics)), pa.array(np.tile(np.arange(topics, dtype=np.int32), len(w))), pa.array(w.ravel())], names=["_side", "_at", "topic", "weight"])

    dealt = rows.join(F.broadcast(docs), "_doc").join(words, "term").select("__doc_at", "_term_at", "x").repartition(parts, "_term_at")
    found = cut(dealt.mapInArrow(run, "_side int, _at long, topic int, weight double", barrier=parts > 1), "factors")
    a = found.filter("_side = 0").join(F.broadcast(docs), F.col("_at") == F.col("__doc_at")).select(F.col("_doc").cast(kind).alias(doc), "topic", "weight")
    b = found.filter("_side = 1").join(words, F.col("_at") == F.col("_term_at")).select("topic", "term", "weight")
    return a, b


def als_topics(weights: DataFrame, doc: str, topics: int = 20, rounds: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """As nmf_topics by MLlib's non-negative ALS over any size; doc must be an integer. Implicit zeros count as preference 0."""
    from pyspark.ml.recommendation import ALS

    terms = ranked(weights.select("term").distinct(), F.col("term")).select("term", F.col("rank").cast("int").alias("tid"))
    rows = weights.join(terms, "term").select(F.col(doc).cast("int").alias("u"), "tid", F.col("weight").cast("float").alias("r"))
    model = ALS(rank=topics, maxIter=rounds, nonnegative=True, implicitPrefs=True, userCol="u", itemCol="tid", ratingCol="r", seed=seed).fit(rows)
    a = model.userFactors.select(F.col("id").alias(doc), F.posexplode("features").alias("topic", "weight"))
    b = model.itemFactors.select(F.col("id").alias("tid"), F.posexplode("features").alias("topic", "weight")).join(terms, "tid").select("topic", "term", "weight")
    return a, b


def anchored_topics(tf: DataFrame, doc: str, anchors: DataFrame, strength: float = 4.0, most: int = 10_000) -> DataFrame:
    """doc, topic, score: mean pointwise mutual information of a document's terms with each topic's anchor terms,
    anchors themselves counting `strength` (E9, by another method). anchors: topic, term; more than `most` are an error.

    A term's values for all topics form one row of statistics, which meets the documents spread by their hash.
    """
    if anchors.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} anchors")
    docs = tf.select(doc, "term").distinct()
    n = docs.agg(F.countDistinct(doc)).scalar()
    with_topic = docs.join(F.broadcast(anchors), "term").select(doc, "topic").distinct()
    per_topic = with_topic.groupBy("topic").agg(F.count("*").alias("nt"))
    per_term = docs.groupBy("term").agg(F.count("*").alias("nd"))
    joint = docs.join(with_topic, doc).groupBy("topic", "term").agg(F.count("*").alias("nj"))
    pmi = joint.join(F.broadcast(per_topic), "topic").join(per_term, "term").select("topic", "term", "nd", F.log(F.col("nj") * n / (F.col("nt") * F.col("nd"))).alias("pmi"))
    boosted = pmi.join(F.broadcast(anchors.withColumn("_a", F.lit(strength))), ["topic", "term"], "left")
    by_term = boosted.groupBy("term").agg(F.first("nd").alias("nd"), F.collect_list(F.struct("topic", (F.col("pmi") * F.coalesce("_a", F.lit(1.0))).alias("v"))).alias("topics"))
    scored = join_stats(docs, by_term, "term", "nd", doc).select(doc, F.explode("topics").alias("x"))
    return scored.groupBy(doc, F.col("x.topic").alias("topic")).agg(F.avg("x.v").alias("score"))
