"""Subject areas of documents (problem 9): one-versus-rest linear classifiers on hashed word n-grams."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.session import cut

BITS = 18
BINS = 1 << BITS
_SENTENCE = re.compile(r"(?<=[.;?!·…])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")
_INVISIBLE = {ord(c): None for c in "­​‌‍⁠﻿"}


@dataclass
class Rows:
    """Sparse rows: row i has the features idx[ptr[i]:ptr[i + 1]] with values val, of unit length."""

    ptr: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def __len__(self) -> int:
        return len(self.ptr) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ptr))

    def take(self, keep: np.ndarray) -> Rows:
        n = np.diff(self.ptr)[keep]
        at = np.repeat(self.ptr[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Rows(np.concatenate([[0], np.cumsum(n)]), self.idx[at], self.val[at])


def sentences(text: str) -> list[list[str]]:
    """The words (runs of letters, lower case, compatibility forms replaced) of each sentence or line that has any."""
    plain = unicodedata.normalize("NFKC", text.translate(_INVISIBLE)).lower()
    return [w for w in map(_WORD.findall, _SENTENCE.split(plain)) if w]


_memo: dict[str, int] = {}


def _hash(word: str) -> int:
    h = _memo.get(word)
    if h is None:
        if len(_memo) > 500_000:
            _memo.clear()
        h = _memo[word] = zlib.crc32(word.encode())
    return h


def _rows(hashes: np.ndarray, owner: np.ndarray, n: int) -> Rows:
    """Rows of the words and word pairs of one owner, log(1 + tf), each scaled to unit length."""
    pair = owner[1:] == owner[:-1]
    mixed = (hashes[:-1].astype(np.uint64) * np.uint64(0x9E3779B1) + hashes[1:].astype(np.uint64)) ^ np.uint64(0x5BD1E995)
    mixed ^= mixed >> np.uint64(17)
    own = np.concatenate([owner, owner[1:][pair]]).astype(np.int64)
    feature = np.concatenate([hashes.astype(np.int64), mixed[pair].astype(np.int64)]) & (BINS - 1)
    keys, tf = np.unique((own << BITS) | feature, return_counts=True)
    own, idx, val = keys >> BITS, (keys & (BINS - 1)).astype(np.int32), np.log1p(tf)
    norm = np.sqrt(np.bincount(own, val * val, minlength=n))
    return Rows(np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int64), idx, (val / norm[own]).astype(np.float32))


def featurize(texts: list[str | None]) -> tuple[Rows, np.ndarray, Rows]:
    """Sparse rows by sentence, the text each sentence is of, and sparse rows by text."""
    hashes, sentence, of = [], [], []
    for d, text in enumerate(texts):
        for words in sentences(text or ""):
            hashes.extend(map(_hash, words))
            sentence.extend([len(of)] * len(words))
            of.append(d)
    h, s, o = np.array(hashes, np.int64), np.array(sentence, np.int64), np.array(of, np.int64)
    return _rows(h, s, len(o)), o, _rows(h, o[s] if len(s) else s, len(texts))


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """The sum of values[ptr[i]:ptr[i + 1]] for each i; 0 where that is empty."""
    out = np.zeros((len(ptr) - 1, *values.shape[1:]), values.dtype)
    some = ptr[1:] > ptr[:-1]
    if some.any():
        out[some] = np.add.reduceat(values, ptr[:-1][some], axis=0)
    return out


def _used(x: Rows, least: int) -> tuple[np.ndarray, ...]:
    """The features of at least `least` rows; the kept entries row by row (bounds, place of the feature among those, value)
    and once more feature by feature (bounds, row, value), so that both sums of a step run over neighbours."""
    used, at, n = np.unique(x.idx, return_inverse=True, return_counts=True)
    keep = (n >= least)[at]
    place = np.cumsum(n >= least) - 1
    at, row, val = place[at[keep]].astype(np.int32), x.row[keep].astype(np.int32), x.val[keep]
    by_feature = np.argsort(at, kind="stable")
    by_row = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(x)))])
    bounds = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=int((n >= least).sum())))])
    return used[n >= least], by_row, at, val, bounds, row[by_feature], val[by_feature]


def _fit_one(data: tuple, y: np.ndarray, rounds: int, rate: float, l2: float) -> tuple[np.ndarray, float]:
    used, by_row, at, val, bounds, row, val_f = data
    val, val_f = val.astype(np.float64), val_f.astype(np.float64)
    rows = max(len(y), 1)
    w = np.zeros(len(used) + 1)  # the last is the bias
    w[-1] = -2
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = _sums(val * w[at], by_row) + w[-1]
        g = (1 / (1 + np.exp(-z)) - y) / rows
        grad = np.append(_sums(val_f * g[row], bounds) + l2 * w[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    weights = np.zeros(BINS, np.float32)
    weights[used] = w[:-1]
    return weights, float(w[-1])


def fit(x: Rows, y: np.ndarray, rounds: int = 80, rate: float = 0.25, l2: float = 1e-5, least: int = 2, spark: SparkSession | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One logistic classifier per column of y (targets between 0 and 1), by full-batch Adam.

    Features of fewer than least rows are left out. Gives weights (BINS x columns, float32) and biases. With spark each
    classifier is fitted in a task of its own; the rows, a bounded sample, are broadcast.
    """
    data, k = _used(x, least), y.shape[1]
    if spark is None:
        fitted = [_fit_one(data, y[:, i], rounds, rate, l2) for i in range(k)]
        return np.stack([w for w, _ in fitted], 1) if k else np.zeros((BINS, 0), np.float32), np.array([b for _, b in fitted])
    held = spark.sparkContext.broadcast((data, y.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                (d, targets) = held.value
                w, bias = _fit_one(d, targets[:, i].astype(np.float64), rounds, rate, l2)
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([w.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["k", "w", "bias"])

    rows = spark.range(0, k, 1, k).mapInArrow(run, "k bigint, w binary, bias double").toArrow().sort_by("k").to_pylist()
    held.destroy()
    return np.stack([np.frombuffer(r["w"], np.float32) for r in rows], 1), np.array([r["bias"] for r in rows])


def scores(x: Rows, weights: np.ndarray, bias: np.ndarray, entries: int = 200_000) -> np.ndarray:
    """Rows times weights plus bias, some `entries` at a time."""
    out = np.zeros((len(x), len(bias)))
    cuts = np.unique(np.searchsorted(x.ptr, np.arange(0, x.ptr[-1] + entries, entries)).clip(0, len(x)))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        part = slice(x.ptr[a], x.ptr[b])
        out[a:b] = _sums(x.val[part, None] * weights[x.idx[part]], x.ptr[a : b + 1] - x.ptr[a])
    return out + bias


def shares(z: np.ndarray, of: np.ndarray, n: int, least_score: np.ndarray) -> np.ndarray:
    """n x subjects: the share of a text's sentences whose best subject is this one, with a score of at least that subject's least_score."""
    top = z.argmax(1)
    ok = z[np.arange(len(z)), top] >= least_score[top]
    out = np.zeros((n, z.shape[1]))
    np.add.at(out, (of[ok], top[ok]), 1)
    return out / np.maximum(np.bincount(of, minlength=n), 1)[:, None]


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray
    bias: np.ndarray
    least_score: np.ndarray  # of a sentence, by subject
    least_share: np.ndarray  # of a text's sentences, by subject

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Scores by sentence and subject, and the text each sentence is of."""
        x, of, _ = featurize(texts)
        return scores(x, self.weights, self.bias), of

    def shares(self, texts: list[str | None]) -> np.ndarray:
        z, of = self.scores(texts)
        return shares(z, of, len(texts), self.least_score)


_SAMPLE = "doc_id bigint, n bigint, subjects array<string>, weights array<double>, ptr array<bigint>, idx array<int>, val array<float>, didx array<int>, dval array<float>"
_FEATURES = [("ptr", pa.int64()), ("idx", pa.int32()), ("val", pa.float32()), ("didx", pa.int32()), ("dval", pa.float32())]


def _featurize_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list] = [[] for _ in _FEATURES]
        for text in b.column("text").to_pylist():
            x, _, whole = featurize([text])
            for c, v in zip(out, (x.ptr, x.idx, x.val, whole.idx, whole.val), strict=True):
                c.append(v)
        kept = ["doc_id", "n", "subjects", "weights"]
        yield pa.record_batch([*[b.column(c).cast(pa.int64()) if c == "n" else b.column(c) for c in kept], *[pa.array(c, pa.list_(t)) for c, (_, t) in zip(out, _FEATURES, strict=True)]], names=[*kept, *[n for n, _ in _FEATURES]])


def _stack(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Rows:
    base, ptr = 0, [np.zeros(1, np.int64)]
    for p, idx, _ in parts:
        ptr.append(p[1:] + base)
        base += len(idx)
    return Rows(np.concatenate(ptr), np.concatenate([i for _, i, _ in parts]) if parts else np.zeros(0, np.int32), np.concatenate([v for *_, v in parts]) if parts else np.zeros(0, np.float32))


# Thresholds tried: of a sentence's score, and of the share of a text's sentences.
SCORES, SHARES = np.arange(-2.5, 0.51, 0.25), np.arange(0.1, 0.41, 0.025)
# Hundredths of the labelled documents, by hash of the id, that the thresholds are set on and that the figures are taken on.
CALIBRATE, TEST = range(10, 25), range(10)


def labelled_texts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, source, kind, n, subjects, part: the documents with text and a label, written in one scan.

    n is the number of annotators, subjects all labels but null; part (0 to 99) splits them by hash of the id.
    """
    named = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.countDistinct("annotator").alias("n"), F.collect_list("subject").alias("subjects"))
    meta = [F.col(c).cast("string").alias(c) if c in documents.columns else F.lit(None).cast("string").alias(c) for c in ("source", "kind")]
    text = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *meta).filter(F.length(F.trim("text")) > 0)
    part = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(100)).cast("int")
    return cut(text.join(named, "doc_id").select("doc_id", "text", "source", "kind", F.greatest("n", F.lit(1)).alias("n"), "subjects", part.alias("part")), "labelled")


def _metadata(df: DataFrame) -> DataFrame:
    """df with field, value: a row for each step of the address path (source up to any separator) and for the section (kind)."""
    steps = F.expr("transform(sequence(1, size(split(source, '[/_.:-]'))), i -> concat_ws('/', slice(split(source, '[/_.:-]'), 1, i)))")
    both = F.concat(F.transform(F.coalesce(steps, F.array().cast("array<string>")), lambda x: F.struct(F.lit("source").alias("field"), x.alias("value"))), F.array(F.struct(F.lit("kind").alias("field"), F.col("kind").alias("value"))))
    return df.withColumn("_m", F.explode(both)).select(*df.columns, "_m.field", "_m.value").filter("value IS NOT NULL")


def lifts(texts: DataFrame) -> DataFrame:
    """field, value, subject, n, lift, precision, z of every step of the address path and section (value) with every subject
    that labelled texts under it have: n texts, precision of all under the value, lift that over the subject's share of all."""
    total = texts.agg(F.count("*")).scalar()
    one = _metadata(texts.select("doc_id", "source", "kind", F.array_distinct("subjects").alias("subjects")))
    named = texts.select(F.explode(F.array_distinct("subjects")).alias("subject")).filter("subject IS NOT NULL").groupBy("subject").agg(F.count("*").alias("n_s"))
    values = one.groupBy("field", "value").agg(F.count("*").alias("n_v"))
    both = one.select("field", "value", F.explode("subjects").alias("subject")).groupBy("field", "value", "subject").agg(F.count("*").alias("n"))
    p = F.col("n_s") / total
    found = both.join(values, ["field", "value"]).join(named, "subject")
    return found.select("field", "value", "subject", "n", (F.col("n") / F.col("n_v") / p).alias("lift"), (F.col("n") / F.col("n_v")).alias("precision"), ((F.col("n") - F.col("n_v") * p) / F.sqrt(F.col("n_v") * p * (1 - p) + 1e-9)).alias("z"))


def path_rules(texts: DataFrame, least: int = 20, lift: float = 3.0, z: float = 5.0) -> DataFrame:
    """The rows of lifts that serve as weak labels.

    A rule is kept where at least `least` labelled texts bear it out, the subject is at least `lift` times as frequent
    under it as among all, and that by at least z standard deviations; others say nothing and are dropped.
    """
    return lifts(texts).filter((F.col("n") >= least) & (F.col("lift") >= lift) & (F.col("z") >= z))


def weak_texts(documents: DataFrame, labels: DataFrame, rules: DataFrame, most: int) -> DataFrame:
    """doc_id, text, n, subjects, weights: at most `most` documents without annotators, by hash of the id, that a rule labels."""
    meta = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "kind").join(labels.select(F.col("doc_id").cast("bigint").alias("doc_id")), "doc_id", "left_anti")
    told = _metadata(meta).join(rules.select("field", "value", "subject", "precision"), ["field", "value"]).groupBy("doc_id", "subject").agg(F.max("precision").alias("p"))
    by_doc = told.groupBy("doc_id").agg(F.collect_list("subject").alias("subjects"), F.collect_list("p").alias("weights")).orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id").limit(most)
    text = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(F.length(F.trim("text")) > 0)
    return text.join(F.broadcast(by_doc), "doc_id").select("doc_id", "text", F.lit(1).alias("n"), "subjects", "weights")


def _hits(texts: DataFrame, model: Model) -> np.ndarray:
    """counts[k, i, j] = (hits, hits that annotators share) of subject k at SCORES[i], SHARES[j], and (truth, truth) in a last row of i.

    One distributed pass over all of texts (labelled_texts); a task sends one row per place of that table.
    """
    held, k = texts.sparkSession.sparkContext.broadcast(model), len(model.subjects)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, len(SCORES) + 1, len(SHARES), 2))
        at = {x: i for i, x in enumerate(held.value.subjects)}
        for b in batches:
            y = np.zeros((b.num_rows, k))
            for d, (n, names) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                for x in names:
                    if x in at:
                        y[d, at[x]] = min(1.0, y[d, at[x]] + 1 / n)
            z, of = held.value.scores(b.column(0).to_pylist())
            for i, score in enumerate(SCORES):
                hit = shares(z, of, b.num_rows, np.full(k, score))[:, :, None] >= SHARES  # texts x subjects x shares
                total[:, i, :, 0] += hit.sum(0)
                total[:, i, :, 1] += (hit * y[:, :, None]).sum(0)
            total[:, -1] += y.sum(0)[:, None, None]
        where = np.indices(total.shape[:3]).reshape(3, -1)
        yield pa.record_batch([*[pa.array(x, pa.int32()) for x in where], pa.array(total[..., 0].ravel()), pa.array(total[..., 1].ravel())], names=["k", "i", "j", "a", "b"])

    out = np.zeros((k, len(SCORES) + 1, len(SHARES), 2))
    for r in texts.select("text", "n", "subjects").mapInArrow(run, "k int, i int, j int, a double, b double").groupBy("k", "i", "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():  # as many rows as the table has places
        out[r["k"], r["i"], r["j"]] = r["a"], r["b"]
    return out


def thresholds(counts: np.ndarray, support: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
    """Per subject the two thresholds of the best F1 against the annotators, where each subject's counts are added to
    those of an average subject with `support` labels, so that one with few labels follows all."""
    hits, found, truth = counts[:, :-1, :, 0], counts[:, :-1, :, 1], counts[:, -1, 0, 0]
    mean = max(truth.mean(), 1e-9)
    extra = support / mean
    f1 = 2 * (found + extra * found.mean(0)) / np.maximum(hits + extra * hits.mean(0) + (truth + extra * mean)[:, None, None], 1e-9)
    best = f1.reshape(len(f1), -1).argmax(1)
    return SCORES[best // len(SHARES)], SHARES[best % len(SHARES)]


def train(documents: DataFrame, labels: DataFrame, labelled: int = 12_000, weak: int = 4_000, texts: DataFrame | None = None) -> Model | None:
    """Classifiers from weak labels, or None where no document with text has a label.

    documents: doc_id, text, source, kind; labels: doc_id, subject (null: none), annotator. Weak labels are those of the
    annotators, the target of a document and subject being the share of its annotators that name it, and those of the
    path_rules that hold in these data, the target being the rule's precision. Weights are fitted on a bounded sample of
    labelled rows, whole texts: of the annotated documents that are neither calibrated nor tested on at most `labelled`,
    by hash of the id, and at most `weak` that only a rule labels. Rules and thresholds come from all annotated texts.

    First the classifiers are fitted on texts. They then name the subject of each sentence of the sample; sentences they
    name clearly, and whose document is labelled so or has a second such sentence, are the positives of a second fit by
    sentence, sentences without any subject its negatives; once more with the result. Each classifier is fitted in a
    task of its own. At last a distributed pass over all texts of the part CALIBRATE sets two thresholds per subject.
    """
    spark = documents.sparkSession
    texts = labelled_texts(documents, labels) if texts is None else texts
    own = texts.filter(~F.col("part").isin(*CALIBRATE, *TEST))
    if own.isEmpty():
        own = texts
    ids = own.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(labelled)  # so many ids at most
    chosen = own.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "n", "subjects", F.transform("subjects", lambda _: F.lit(1.0)).alias("weights"))
    rules = path_rules(texts)
    if weak and not rules.isEmpty():
        chosen = chosen.union(weak_texts(documents, labels, rules, weak))
    rows = chosen.repartition(3 * spark.sparkContext.defaultParallelism).mapInArrow(_featurize_batches, _SAMPLE).toArrow().sort_by("doc_id")
    subjects = sorted({s for names in rows["subjects"].to_pylist() for s in names if s is not None})
    if not subjects:
        return None
    take = lambda c: [np.asarray(x.values) for x in rows[c]]
    by_sentence = list(zip(take("ptr"), take("idx"), take("val"), strict=True))
    by_text = [(np.array([0, len(i)]), i, v) for i, v in zip(take("didx"), take("dval"), strict=True)]
    y = np.zeros((len(rows), len(subjects)))
    at = {s: k for k, s in enumerate(subjects)}
    for i, (n, names, parts) in enumerate(zip(rows["n"].to_pylist(), rows["subjects"].to_pylist(), rows["weights"].to_pylist(), strict=True)):
        for s, w in zip(names, parts, strict=True):
            if s is not None:
                y[i, at[s]] = min(1.0, y[i, at[s]] + w / n)
    weights, bias = fit(_stack(by_text), y, spark=spark)

    x = _stack(by_sentence)
    of = np.repeat(np.arange(len(rows)), [len(p) - 1 for p, *_ in by_sentence])
    for least, gap, none in ((-1.2, 0.8, -2.2), (0.0, 1.5, -2.0)):
        z = scores(x, weights, bias)
        order = np.sort(z, 1)
        top, best = z.argmax(1), order[:, -1]
        second = order[:, -2] if z.shape[1] > 1 else np.full(len(z), -np.inf)
        count = np.zeros(y.shape)
        np.add.at(count, (of[best >= least], top[best >= least]), 1)
        backed = (count[of, top] >= 2) | (y[of, top] > 0)
        yes, no = (best >= least) & (best - second > gap) & backed, best < none
        use = np.flatnonzero(yes | no)
        if not yes.any() or not no.any():
            break
        target = np.zeros((len(z), len(subjects)))
        target[np.flatnonzero(yes), top[yes]] = 1
        weights, bias = fit(x.take(use), target[use], rounds=60, l2=1e-6, least=3, spark=spark)
    model = Model(subjects, weights, bias, np.zeros(len(subjects)), np.full(len(subjects), 0.2))
    held = texts.filter(F.col("part").isin(*CALIBRATE))
    model.least_score, model.least_share = thresholds(_hits(texts if held.isEmpty() else held, model))
    return model


def quality(texts: DataFrame, model: Model | None) -> DataFrame:
    """subject, given, agreed, labelled: over the labelled texts of the part TEST, which neither weights nor thresholds have
    seen: how often the subject is given, how much of that the annotators share, and how much they give."""
    schema = "subject string, given double, agreed double, labelled double"
    if model is None:
        return texts.sparkSession.createDataFrame([], schema)
    counts = _hits(texts.filter(F.col("part").isin(*TEST)), model)
    i, j = (np.abs(grid[:, None] - at[None]).argmin(0) for grid, at in ((SCORES, model.least_score), (SHARES, model.least_share)))
    return texts.sparkSession.createDataFrame([(s, *map(float, counts[k, i[k], j[k]]), float(counts[k, -1, 0, 0])) for k, s in enumerate(model.subjects)], schema)


def subject_shares(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, subject, share of the document's sentences, about: whether that is a main share, for subjects with any sentence.

    Null and blank texts have no rows. The weights (BINS x subjects floats, some 15 MB for 14 subjects) are broadcast;
    their size doesn't depend on the data.
    """
    spark = documents.sparkSession
    schema = "doc_id bigint, subject string, share double, about boolean"
    if model is None:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = held.value.shares(b.column(1).to_pylist())
            d, k = np.nonzero(s)
            about = s[d, k] >= held.value.least_share[k]
            yield pa.record_batch([pa.array(b.column(0).to_numpy(zero_copy_only=False)[d], pa.int64()), pa.array([held.value.subjects[i] for i in k], pa.string()), pa.array(s[d, k], pa.float64()), pa.array(about, pa.bool_())], names=["doc_id", "subject", "share", "about"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id IS NOT NULL").mapInArrow(run, schema)
