"""Queries of the corpus-analytics operators over the test tables, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.functions.vectors import norm
from lexforge.operators import classify, cluster, compare, embed, lexicon, metrics, spans, stability, terms, tree, validate, vectors
from lexforge.operators.records import one_per_id
from lexforge.session import cut, table
from lexforge.sources import sinks

DIMS = 64
# A stop list of function lemmas, and seed words of three categories.
STOPS = ("ὁ", "ὅς", "δέ", "καί", "τε", "μέν", "γάρ", "ἀλλά", "ἐν", "ἐπί", "παρά", "οὐ", "ἐγώ", "αὐτός", "τις")
SEEDS = {"hospitality": ["guest", "host", "hearth", "gift", "banquet"], "warfare": ["spear", "shield", "siege", "battle"], "seafaring": ["oar", "mast", "rudder", "helmsman", "harbor"]}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def emb(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", "embedding")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """passage_id, token_pos, work, form, lemma, postag, cite of every token, one passage per id."""
    p = one_per_id(table(spark, d, "passages"), "passage_id", "source", "tokens")
    t = p.select("passage_id", F.regexp_extract("source", r"(Iliad|Odyssey)", 1).alias("work"), F.posexplode("tokens").alias("i", "t"))
    return t.filter("t IS NOT NULL").select("passage_id", (F.col("i") + 1).alias("token_pos"), "work", *[F.col(f"t.{c}").alias(c) for c in ("form", "lemma", "postag", "cite")])


def lemmas(spark: SparkSession, d: str) -> DataFrame:
    return one_per_id(table(spark, d, "lemmas"), "lemma_id")


def assignments(spark: SparkSession, d: str) -> DataFrame:
    return one_per_id(table(spark, d, "cluster128_field_framenet_full"), "row_id", "greek_lemma", "word_sense", "assignment", "frame", "frame_status", "frame_core_FEs")


def spans_of(spark: SparkSession, d: str) -> DataFrame:
    """sentence_id, text, set_pos, kind (target or FE), item_pos, name, start, end, span_text, frame, status."""
    s = one_per_id(table(spark, d, "odyssey_7_189_framenet"), "sentence_id", "text", "annotationSets").select("sentence_id", "text", F.posexplode("annotationSets").alias("i", "a")).filter("a IS NOT NULL")
    at = [(F.col("i") + 1).alias("set_pos")]
    cols = lambda c: [F.col(f"{c}.name").alias("name"), F.col(f"{c}.start").alias("start"), F.col(f"{c}.end").alias("end"), F.col(f"{c}.text").alias("span_text"), F.col("a.frameName").alias("frame"), F.col("a.frameStatus").alias("status")]
    t = s.filter("a.target IS NOT NULL").select("sentence_id", "text", *at, F.lit("target").alias("kind"), F.lit(0).alias("item_pos"), *cols("a.target"))
    f = s.select("sentence_id", "text", "i", "a", F.posexplode("a.FEs").alias("j", "f")).filter("f IS NOT NULL").select("sentence_id", "text", *at, F.lit("FE").alias("kind"), (F.col("j") + 1).alias("item_pos"), *cols("f"))
    return t.union(f)


# SQL of the same inputs
_TOK = r"(SELECT passage_id, work, token_pos, t.form AS form, t.lemma AS lemma, t.postag AS postag, t.cite AS cite FROM (SELECT passage_id, regexp_extract(source, '(Iliad|Odyssey)', 1) AS work, generate_subscripts(tokens, 1) AS token_pos, unnest(tokens) AS t FROM (SELECT DISTINCT ON (passage_id) passage_id, source, tokens FROM passages)) WHERE t IS NOT NULL)"
_LEM = "(SELECT DISTINCT ON (lemma_id) * FROM lemmas)"
_LF = "(SELECT DISTINCT ON (row_id) * FROM lemma_frames)"
_ASG = "(SELECT DISTINCT ON (row_id) * FROM cluster128_field_framenet_full)"
_SET = "(SELECT sentence_id, text, generate_subscripts(annotationSets, 1) AS set_pos, unnest(annotationSets) AS a FROM (SELECT DISTINCT ON (sentence_id) * FROM odyssey_7_189_framenet))"
_SPAN = f"(SELECT sentence_id, text, set_pos, 'target' AS kind, 0 AS item_pos, a.target.name AS name, a.target.start AS s, a.target['end'] AS e, a.target.text AS span_text, a.frameName AS frame, a.frameStatus AS status FROM {_SET} WHERE a.target IS NOT NULL UNION ALL SELECT sentence_id, text, set_pos, 'FE', item_pos, f.name, f.start, f['end'], f.text, frame, status FROM (SELECT sentence_id, text, set_pos, a.frameName AS frame, a.frameStatus AS status, generate_subscripts(a.FEs, 1) AS item_pos, unnest(a.FEs) AS f FROM {_SET} WHERE a IS NOT NULL) WHERE f IS NOT NULL)"
_GREEK = r"[\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}]"
_D = "(SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
_CEN = f"(SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM {_D} GROUP BY label, i) GROUP BY label)"
_E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_STOPS = ", ".join(f"'{s}'" for s in STOPS)


# --- vectors


@query(f"SELECT e.label, vec_id, round(list_cosine_similarity(v, c), 6) AS similarity, CAST(row_number() OVER (PARTITION BY e.label ORDER BY list_cosine_similarity(v, c) DESC, vec_id) AS BIGINT) AS rank FROM {_E} e JOIN {_CEN} k ON e.label = k.label WHERE e.label <> -1")
def centroid_ranking(spark: SparkSession, d: str) -> DataFrame:
    r = vectors.rank_by_centroid(emb(spark, d), "label", "vec_id", "embedding", DIMS)
    return r.select("label", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query(f"SELECT e.label, count(*) AS n, round(avg(list_cosine_similarity(v, c)), 6) AS coherence FROM {_E} e JOIN {_CEN} k ON e.label = k.label WHERE e.label <> -1 GROUP BY e.label")
def cluster_coherence(spark: SparkSession, d: str) -> DataFrame:
    return vectors.coherence(emb(spark, d), "label", "vec_id", "embedding", DIMS).withColumn("coherence", F.round("coherence", 6))


@query(f"WITH r AS (SELECT e.label, vec_id, row_number() OVER (PARTITION BY e.label ORDER BY list_cosine_similarity(v, c) DESC, vec_id) AS r FROM {_E} e JOIN {_CEN} k ON e.label = k.label WHERE e.label <> -1) SELECT label, string_agg(CAST(vec_id AS VARCHAR), '; ' ORDER BY r) AS examples FROM r WHERE r <= 5 GROUP BY label")
def best_examples(spark: SparkSession, d: str) -> DataFrame:
    return vectors.best_examples(emb(spark, d), "label", "vec_id", "embedding", DIMS)


@query(f"WITH c AS (SELECT e.label, count(*) AS n, avg(list_cosine_similarity(v, c)) AS coherence FROM {_E} e JOIN {_CEN} k ON e.label = k.label WHERE e.label <> -1 GROUP BY e.label HAVING count(*) >= 3), r AS (SELECT *, row_number() OVER (ORDER BY coherence DESC, label) AS t, row_number() OVER (ORDER BY coherence, label) AS b FROM c) SELECT 'top' AS \"end\", CAST(t AS INT) AS place, label, n, round(coherence, 6) AS coherence FROM r WHERE t <= 12 UNION ALL SELECT 'bottom', CAST(b AS INT), label, n, round(coherence, 6) FROM r WHERE b <= 8")
def coherence_ends(spark: SparkSession, d: str) -> DataFrame:
    c = vectors.coherence(emb(spark, d), "label", "vec_id", "embedding", DIMS)
    return vectors.both_ends(c, "label").withColumn("coherence", F.round("coherence", 6))


@query(f"SELECT a.vec_id AS query, b.vec_id AS item, round(list_cosine_similarity(a.v, b.v), 6) AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS BIGINT) AS rank FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY rank <= 12")
def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    r = vectors.nearest(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 12)
    return r.select("query", "item", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


_KNN = f"(SELECT least(q, i) AS src, greatest(q, i) AS dst, greatest(max(s), 1e-9) AS weight FROM (SELECT a.vec_id AS q, b.vec_id AS i, list_cosine_similarity(a.v, b.v) AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.v, b.v), 12) DESC, b.vec_id) AS r FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id) WHERE r <= 15 GROUP BY 1, 2)"


@query(f"SELECT src, dst, round(weight, 6) AS weight FROM {_KNN}")
def knn_graph(spark: SparkSession, d: str) -> DataFrame:
    return vectors.knn_edges(emb(spark, d), "vec_id", "embedding", 15).withColumn("weight", F.round("weight", 6))


@query(f"WITH e AS {_KNN}, l AS (SELECT vec_id, label FROM embeddings), j AS (SELECT weight, a.label AS la, b.label AS lb FROM e JOIN l a ON src = a.vec_id JOIN l b ON dst = b.vec_id), g AS (SELECT l, sum(weight) AS dg FROM (SELECT la AS l, weight FROM j UNION ALL SELECT lb, weight FROM j) GROUP BY l) SELECT round((SELECT sum(CASE WHEN la = lb THEN weight ELSE 0 END) / sum(weight) FROM j) - (SELECT sum(dg * dg) FROM g) / (4 * (SELECT sum(weight) FROM j) ** 2), 6) AS modularity")
def graph_modularity(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    return metrics.modularity(vectors.knn_edges(e, "vec_id", "embedding", 15), e, "vec_id", "label").select(F.round("modularity", 6).alias("modularity"))


@query(f"SELECT vec_id, label AS nearest, round(s, 6) AS similarity FROM (SELECT e.vec_id, k.label, list_cosine_similarity(v, c) AS s, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_cosine_similarity(v, c), 12) DESC, k.label) AS r FROM {_E} e CROSS JOIN {_CEN} k) WHERE r = 1")
def nearest_centroids(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d)
    r = vectors.nearest_centroid(e, "vec_id", "embedding", vectors.centroids(e, ["label"], "embedding", DIMS), "label")
    return r.withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT e.vec_id, p.label, round(max(list_dot_product(e.v, p.c)), 6) AS score FROM {_E} e CROSS JOIN {_CEN} p GROUP BY e.vec_id, p.label")
def prompt_max_similarity(spark: SparkSession, d: str) -> DataFrame:
    """The mean vectors of the labels are the prompts."""
    e = emb(spark, d)
    prompts = vectors.centroids(e, ["label"], "embedding", DIMS, normalise=False)
    return vectors.max_similarity(e.select("vec_id", "embedding"), "vec_id", "embedding", prompts, "label", "centroid").withColumn("score", F.round("score", 6))


@query(f"SELECT label, count(*) // {DIMS} AS n, round(sqrt(sum(m * m)), 6) AS length FROM (SELECT label, i, sum(x * w) / sum(w) AS m, count(*) AS c FROM (SELECT *, 1 + vec_id % 5 AS w FROM {_D}) GROUP BY label, i), (SELECT 1) GROUP BY label".replace(f"count(*) // {DIMS} AS n", "CAST(max(c) AS BIGINT) AS n"))
def weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d).withColumn("w", 1 + F.col("vec_id") % 5)
    c = vectors.centroids(e, ["label"], "embedding", DIMS, weight="w", normalise=False)
    return c.select("label", "n", F.round(norm(F.col("centroid")), 6).alias("length"))


@query(f"SELECT label, CAST(max(k) AS BIGINT) AS n, round(sqrt(sum(m * m)), 6) AS length FROM (SELECT label, i, avg(m) AS m, count(*) AS k FROM (SELECT label, vec_id % 7 AS g, i, avg(x) AS m FROM {_D} GROUP BY 1, 2, 3) GROUP BY label, i) GROUP BY label")
def mean_of_means(spark: SparkSession, d: str) -> DataFrame:
    e = emb(spark, d).withColumn("g", F.col("vec_id") % 7)
    m = vectors.two_level_mean(e, "label", "g", "embedding", DIMS)
    return m.select("label", "n", F.round(norm(F.col("centroid")), 6).alias("length"))


@query(f"WITH e AS {_E}, p AS (SELECT a.vec_id, a.label, b.label AS l2, sum(1 - list_cosine_similarity(a.v, b.v)) AS s, count(*) AS n FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.label <> -1 AND b.label <> -1 GROUP BY 1, 2, 3), q AS (SELECT vec_id, max(CASE WHEN label = l2 THEN s / n END) AS a, min(CASE WHEN label <> l2 THEN s / n END) AS b FROM p GROUP BY vec_id) SELECT count(*) AS items, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM q")
def silhouette_score(spark: SparkSession, d: str) -> DataFrame:
    return metrics.silhouette(emb(spark, d), "label", "embedding", DIMS).withColumn("silhouette", F.round("silhouette", 6))


_COMP = f"d AS {_D}, c AS (SELECT label, i, avg(x) AS m, count(*) AS n FROM d WHERE label <> -1 GROUP BY label, i)"


@query(f"WITH {_COMP}, g AS (SELECT i, avg(x) AS g FROM d WHERE label <> -1 GROUP BY i), w AS (SELECT sum((x - m) ** 2) AS w, count(*) / {DIMS} AS items FROM d JOIN c ON d.label = c.label AND d.i = c.i), b AS (SELECT sum(n * (m - g) ** 2) AS b, count(DISTINCT label) AS k FROM c JOIN g ON c.i = g.i) SELECT CAST(items AS BIGINT) AS items, k AS clusters, round(b / (k - 1) / (w / (items - k)), 4) AS score FROM w, b")
def calinski_harabasz_score(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calinski_harabasz(emb(spark, d), "label", "embedding", DIMS).withColumn("score", F.round("score", 4))


@query(f"WITH {_COMP}, r AS (SELECT label, avg(dist) AS s FROM (SELECT d.label, vec_id, sqrt(sum((x - m) ** 2)) AS dist FROM d JOIN c ON d.label = c.label AND d.i = c.i GROUP BY 1, 2) GROUP BY label), p AS (SELECT a.label AS l1, b.label AS l2, sqrt(sum((a.m - b.m) ** 2)) AS dist FROM c a JOIN c b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2) SELECT count(*) AS clusters, round(avg(w), 6) AS score FROM (SELECT l1, max((x.s + y.s) / dist) AS w FROM p JOIN r x ON l1 = x.label JOIN r y ON l2 = y.label GROUP BY l1)")
def davies_bouldin_score(spark: SparkSession, d: str) -> DataFrame:
    return metrics.davies_bouldin(emb(spark, d), "label", "embedding", DIMS).withColumn("score", F.round("score", 6))


@query()
def top_components_removed(spark: SparkSession, d: str) -> DataFrame:
    return vectors.remove_top_components(emb(spark, d), "vec_id", "embedding", DIMS)


@query()
def pca_reduced(spark: SparkSession, d: str) -> DataFrame:
    return vectors.reduce_pca(emb(spark, d), "vec_id", "embedding", 15)


# --- text and vocabulary


@query(r"SELECT term, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY term")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)).alias("t"))
    return terms.term_counts(t, "t", ["doc_id"]).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


@query(f"SELECT lemma AS term, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, lemma) AS BIGINT) AS rank FROM {_TOK} WHERE lemma <> '' AND lemma NOT IN ({_STOPS}) GROUP BY lemma HAVING count(*) >= 5")
def vocabulary_min_freq(spark: SparkSession, d: str) -> DataFrame:
    counts = tokens(spark, d).filter("lemma <> ''").groupBy(F.col("lemma").alias("term")).agg(F.count("*").alias("n"))
    stops = spark.createDataFrame([(s,) for s in STOPS], "term string")
    return terms.vocabulary(counts, stops, 5).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"SELECT pos, count(*) AS n, count(DISTINCT lemma) AS lemmas FROM (SELECT substr(postag, 1, 1) AS pos, lemma FROM {_TOK}) WHERE pos IN ('n', 'v', 'a') AND lemma <> '' AND regexp_matches(lemma, '{_GREEK}') GROUP BY pos")
def content_words(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d).select(tx.decode_postag(F.col("postag"))["pos"].alias("pos"), "lemma")
    return t.filter(F.col("pos").isin(*tx.CONTENT_POS) & tx.is_content_word(F.col("lemma"), tx.ARTIFACTS_LONG)).groupBy("pos").agg(F.count("*").alias("n"), F.countDistinct("lemma").alias("lemmas"))


@query(rf"SELECT work, book, pos, gcase, number, count(*) AS n, max(line) AS last_line FROM (SELECT work, TRY_CAST(regexp_extract(cite, '^(\d+)\.(\d+)', 1) AS INT) AS book, TRY_CAST(regexp_extract(cite, '^(\d+)\.(\d+)', 2) AS INT) AS line, nullif(substr(p, 1, 1), '-') AS pos, nullif(substr(p, 8, 1), '-') AS gcase, nullif(substr(p, 3, 1), '-') AS number FROM (SELECT *, rpad(coalesce(postag, ''), 9, '-') AS p FROM {_TOK})) GROUP BY ALL")
def decoded_tokens(spark: SparkSession, d: str) -> DataFrame:
    tag, (book, line) = tx.decode_postag(F.col("postag")), tx.book_line(F.col("cite"))
    t = tokens(spark, d).select("work", book.alias("book"), line.alias("line"), tag["pos"].alias("pos"), tag["case"].alias("gcase"), tag["number"].alias("number"))
    return t.groupBy("work", "book", "pos", "gcase", "number").agg(F.count("*").alias("n"), F.max("line").alias("last_line"))


def _morphology_sql() -> str:
    at = lambda i: "CASE substr(p, %d, 1) %s END" % (i + 1, " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.MORPHOLOGY[i].items()))
    part, verb, other = (f"concat_ws(' ', {', '.join(at(i) for i in o)})" for o in ((3, 5, 4, 7, 2, 6), (3, 5, 4, 1, 2), (7, 2, 6, 8)))
    name = f"CASE WHEN substr(p, 1, 1) NOT IN ('n', 'a') THEN {at(0)} END"
    return f"SELECT postag, count(*) AS n, CASE WHEN coalesce(postag, '') = '' THEN '' WHEN substr(p, 1, 1) IN ('v', 't') THEN CASE WHEN substr(p, 5, 1) = 'p' THEN {part} ELSE {verb} END ELSE concat_ws(' ', {name}, nullif({other}, '')) END AS name FROM (SELECT postag, rpad(coalesce(postag, ''), 9, '-') AS p FROM {_TOK}) GROUP BY postag, p"


@query(_morphology_sql())
def morphology_names(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).groupBy("postag").agg(F.count("*").alias("n")).withColumn("name", tx.morphology(F.col("postag")))


@query(rf"SELECT doc_id, length(l) > 0 AND length(regexp_replace(l, '[^{_GREEK[1:-1]}]', '', 'g')) >= length(l) * 0.5 AS greek FROM (SELECT doc_id, regexp_replace(text, '[^\p{{L}}]', '', 'g') AS l FROM documents)")
def mostly_greek_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.mostly_greek(F.col("text")).alias("greek"))


@query(r"WITH s AS (SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(m) AS s FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '\*{1,2}', '**', 'g'), '\*\*([^\n]+?)\*\*', 1) AS m FROM documents WHERE text IS NOT NULL)), k AS (SELECT doc_id, min(i) AS i, trim(s, ' ,;:.—-') AS t FROM s WHERE length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= 3 AND length(regexp_replace(s, '[^A-Za-z]', '', 'g')) > length(regexp_replace(s, '[^" + _GREEK[1:-1] + r"]', '', 'g')) GROUP BY doc_id, t), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM k WHERE t <> '') SELECT d.doc_id, coalesce(string_agg(t, '; ' ORDER BY i), '') AS spans FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND n <= 4 WHERE d.text IS NOT NULL GROUP BY d.doc_id")
def marked_spans(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_replace("text", r"\*{1,2}", "**").alias("e"))
    return t.select("doc_id", F.array_join(tx.english_spans(F.col("e")), "; ").alias("spans"))


@query(f"SELECT lemma_id, CAST(generate_subscripts(s, 1) AS BIGINT) AS sense_no, unnest(s) AS sense FROM (SELECT lemma_id, CASE WHEN len(p) > 0 THEN p ELSE [lsj_glosses] END AS s FROM (SELECT lemma_id, lsj_glosses, list_filter(list_transform(string_split(lsj_glosses, ';'), lambda x: trim(x)), lambda x: x <> '') AS p FROM {_LEM}) WHERE lsj_glosses IS NOT NULL)")
def sense_split(spark: SparkSession, d: str) -> DataFrame:
    s = lemmas(spark, d).filter("lsj_glosses IS NOT NULL").select("lemma_id", F.posexplode(tx.split_senses(F.col("lsj_glosses"))).alias("i", "sense"))
    return s.select("lemma_id", (F.col("i") + 1).cast("bigint").alias("sense_no"), "sense")


@query(r"SELECT doc_id, array_to_string(list_slice(string_split_regex(trim(text, ' '), '[ \t\n\f\r\v]+'), 1, 60), ' ') AS head FROM documents WHERE text IS NOT NULL")
def first_sixty_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", tx.first_words(F.col("text"), 60).alias("head"))


@query(rf"SELECT lemma_id, regexp_replace(greek_lemma, '\d+$', '') AS base, TRY_CAST(regexp_extract(greek_lemma, '(\d+)$', 1) AS INT) AS number FROM {_LEM}")
def homograph_split(spark: SparkSession, d: str) -> DataFrame:
    base, number = tx.homograph(F.col("greek_lemma"))
    return lemmas(spark, d).select("lemma_id", base.alias("base"), number.alias("number"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{c}' AS category FROM documents WHERE regexp_matches(text, '(?i)\\b(?:{'|'.join(sorted(s, key=len, reverse=True))})\\b')" for c, s in SEEDS.items()))
def seed_match(spark: SparkSession, d: str) -> DataFrame:
    return classify.seed_hits(table(spark, d, "documents"), "doc_id", "text", SEEDS)


@query(rf"SELECT lemma_id, trim(regexp_replace(lower(lsj_glosses), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS words FROM {_LEM}")
def plain_gloss_words(spark: SparkSession, d: str) -> DataFrame:
    return lemmas(spark, d).select("lemma_id", tx.plain_words(F.col("lsj_glosses")).alias("words"))


@query(f"SELECT passage_id, CAST(token_pos AS BIGINT) AS token_pos, nfc_normalize(form) AS composed, regexp_replace(strip_accents(form), '[0-9]+$', '') AS bare, regexp_replace(regexp_replace(translate(nfc_normalize(trim(form, ' ')), '’ʼ', chr(39) || chr(39)), '\\s+', ' ', 'g'), '\\s+([,.;·])', '\\1', 'g') AS key, CASE substr(rpad(coalesce(postag, ''), 9, '-'), 6, 1) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in tx.VOICES.items())} WHEN '-' THEN '' ELSE substr(rpad(coalesce(postag, ''), 9, '-'), 6, 1) END AS voice FROM {_TOK}")
def token_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every form composed, bare and as a gloss key, with the name of its voice."""
    f = F.col("form")
    return tokens(spark, d).select("passage_id", F.col("token_pos").cast("bigint").alias("token_pos"), tx.nfc(f).alias("composed"), tx.bare(f).alias("bare"), tx.gloss_key(f).alias("key"), tx.voice_name(tx.decode_postag(F.col("postag"))["voice"]).alias("voice"))


_STRIP = tx.STRIP.replace("'", "''")


@query(f"SELECT passage_id, list_filter(list_transform(string_split_regex(trim(regexp_replace(nfc_normalize(text), '\\[[^\\]]*\\]', ' ', 'g'), ' '), '[ \\t\\n\\f\\r\\v]+'), lambda w: trim(w, '{_STRIP}')), lambda w: w <> '') AS words FROM (SELECT DISTINCT ON (passage_id) passage_id, text FROM passages)")
def tokenized_passages(spark: SparkSession, d: str) -> DataFrame:
    """The words of every passage's text."""
    p = one_per_id(table(spark, d, "passages"), "passage_id", "text")
    return p.select("passage_id", tx.tokenize_line(F.col("text")).alias("words"))


@query(r"SELECT doc_id, trim(coalesce(array_to_string(list_filter(k, lambda s, i: list_position(k, s) = i), '; '), ''), '; ') AS gloss FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s)\*\*(.+?)\*\*', 1), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'), ' ')), lambda s: s <> '' AND NOT (length(regexp_replace(s, '[^\p{L}]', '', 'g')) > 0 AND length(regexp_replace(regexp_replace(s, '[^\p{L}]', '', 'g'), '[^" + _GREEK[1:-1] + r"]', '', 'g')) >= length(regexp_replace(s, '[^\p{L}]', '', 'g')) * 0.5)) AS k FROM (SELECT doc_id, regexp_replace(text, '\*{1,2}', '**', 'g') AS text FROM documents WHERE text IS NOT NULL))")
def bold_glosses(spark: SparkSession, d: str) -> DataFrame:
    """The bold spans of every document that aren't mostly Greek (P10)."""
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.regexp_replace("text", r"\*{1,2}", "**").alias("e"))
    return t.select("doc_id", tx.bold_gloss(F.col("e")).alias("gloss"))


@query(f"SELECT lemma_id, round(log10(homer_count + 1), 6) AS log_count, round_even(homer_count / 8, 2) AS eighth, pos || '#' || lemma_id AS synset, pos, CASE WHEN pos IS NOT NULL THEN CAST(lemma_id AS VARCHAR) END AS key, substr(lsj_glosses, 1, length(regexp_extract(lsj_glosses, '(?s)^(.*?[.!?](?:\\s|$)|.*)', 1)) - CASE WHEN regexp_matches(regexp_extract(lsj_glosses, '(?s)^(.*?[.!?](?:\\s|$)|.*)', 1), '(?s)[.!?]\\s$') THEN 1 ELSE 0 END) AS sentence FROM {_LEM}")
def lemma_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Logarithms and ratios of counts, synset ids taken apart, first sentences."""
    synset = F.concat(F.col("pos"), F.lit("#"), F.col("lemma_id").cast("string"))
    pos, offset = tx.synset_parts(synset)
    return lemmas(spark, d).select("lemma_id", F.round(F.log10(F.col("homer_count") + 1), 6).alias("log_count"), tx.two_places(F.col("homer_count") / 8).alias("eighth"), synset.alias("synset"), pos.alias("pos"), offset.alias("key"), tx.first_sentence(F.col("lsj_glosses")).alias("sentence"))


# --- term weights, windows, topics

_STOPLIST = ", ".join(f"'{s}'" for s in terms.ENGLISH_STOPS)
_CT = rf"w AS (SELECT source, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}\p{{Mn}}_]+'), lambda x: regexp_full_match(x, '[a-z][a-z]+') AND x NOT IN ({_STOPLIST})) AS t FROM documents WHERE source IS NOT NULL), g AS (SELECT source, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM w), tf AS (SELECT source, term, count(*) AS n FROM g GROUP BY 1, 2), tot AS (SELECT source, sum(n) AS total FROM tf GROUP BY 1), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), sc AS (SELECT tf.source, tf.term, n / total * ln(1 + (SELECT count(DISTINCT source) FROM w) / df) AS score FROM tf JOIN tot ON tf.source = tot.source JOIN df ON tf.term = df.term)"


@query(f"WITH {_CT} SELECT source, term, round(score, 8) AS score FROM sc")
def class_tfidf_scores(spark: SparkSession, d: str) -> DataFrame:
    return terms.class_tfidf(table(spark, d, "documents"), "source", "text").withColumn("score", F.round("score", 8))


@query(f"WITH {_CT}, l AS (SELECT source, list(term ORDER BY round(score, 12) DESC, term) AS t FROM sc WHERE score > 0 GROUP BY source) SELECT source, coalesce(nullif(array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(t, lambda x: [x])), lambda acc, x: CASE WHEN len(acc) < 4 AND len(list_filter(acc, lambda y: contains(y, x[1]) OR contains(x[1], y))) = 0 THEN list_concat(acc, x) ELSE acc END), ', '), ''), '(unnamed)') AS name FROM (SELECT DISTINCT source FROM sc) LEFT JOIN l USING (source)")
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    return terms.name_clusters(terms.class_tfidf(table(spark, d, "documents"), "source", "text"), "source")


@query(f"WITH tf AS (SELECT passage_id, lemma AS term, count(*) AS n FROM {_TOK} WHERE lemma <> '' GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1 HAVING count(*) >= 3), w AS (SELECT passage_id, tf.term, n * (ln((1.0 + (SELECT count(DISTINCT passage_id) FROM {_TOK})) / (1.0 + df)) + 1) AS w FROM tf JOIN df ON tf.term = df.term) SELECT passage_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY passage_id)), 6) AS weight FROM w")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    docs = tokens(spark, d).groupBy("passage_id").agg(F.collect_list("lemma").alias("t"))
    return terms.tfidf(docs, "passage_id", "t", 3).withColumn("weight", F.round("weight", 6))


@query(rf"SELECT work, book, CAST(floor(line / 30) AS INT) AS win, array_to_string(list_sort(list(lemma)), ' ') AS terms, count(*) AS n FROM (SELECT work, lemma, CAST(regexp_extract(cite, '^(\d+)\.(\d+)', 1) AS INT) AS book, CAST(regexp_extract(cite, '^(\d+)\.(\d+)', 2) AS INT) AS line FROM {_TOK} WHERE substr(postag, 1, 1) IN ('n', 'v', 'a') AND lemma <> '' AND regexp_matches(lemma, '{_GREEK}') AND regexp_matches(cite, '^\d+\.\d+')) GROUP BY 1, 2, 3 HAVING count(*) >= 5")
def passage_windows(spark: SparkSession, d: str) -> DataFrame:
    book, line = tx.book_line(F.col("cite"))
    t = tokens(spark, d).filter(F.substring("postag", 1, 1).isin(*tx.CONTENT_POS) & tx.is_content_word(F.col("lemma"))).select("work", book.alias("book"), line.alias("line"), "lemma")
    w = terms.windows(t, ["work", "book"], "line", "lemma", 30, 5)
    return w.select("work", "book", F.col("window").alias("win"), F.array_join("terms", " ").alias("terms"), "n")


@query("WITH b AS (SELECT DISTINCT ON (book_id) * FROM topic_prevalence_by_book), u AS (UNPIVOT (SELECT work, " + ", ".join(f"topic_{i}" for i in range(20)) + " FROM b) ON " + ", ".join(f"topic_{i}" for i in range(20)) + " INTO NAME topic VALUE w) SELECT work, topic, round(sum(w) / sum(sum(w)) OVER (PARTITION BY work), 6) AS share FROM u GROUP BY work, topic")
def topic_prevalence_share(spark: SparkSession, d: str) -> DataFrame:
    cols = [f"topic_{i}" for i in range(20)]
    b = one_per_id(table(spark, d, "topic_prevalence_by_book"), "book_id").unpivot(["work"], cols, "topic", "w").filter("w IS NOT NULL")
    return terms.prevalence(b, ["work"], "topic", "w").withColumn("share", F.round("share", 6))


@query(f"SELECT work, lemma AS term, count(*) AS n, CAST(row_number() OVER (PARTITION BY work ORDER BY count(*) DESC, lemma) AS BIGINT) AS rank FROM {_TOK} WHERE lemma <> '' GROUP BY work, lemma QUALIFY rank <= 8")
def top_terms_by_work(spark: SparkSession, d: str) -> DataFrame:
    n = tokens(spark, d).filter("lemma <> ''").groupBy("work", F.col("lemma").alias("term")).agg(F.count("*").alias("n"))
    return terms.top_k(n, ["work"], [F.desc("n"), F.col("term")], 8).withColumn("rank", F.col("rank").cast("bigint"))


@query()
def nmf_topic_terms(spark: SparkSession, d: str) -> DataFrame:
    book, line = tx.book_line(F.col("cite"))
    t = tokens(spark, d).filter(tx.is_content_word(F.col("lemma"))).select("work", book.alias("book"), line.alias("line"), "lemma")
    w = terms.windows(t, ["work", "book"], "line", "lemma").withColumn("doc", F.concat_ws(" ", "work", "book", "window"))
    _, topic_terms = terms.nmf_topics(terms.tfidf(w, "doc", "terms", 3), "doc")
    return sinks.topic_listing(topic_terms)


@query()
def als_topic_terms(spark: SparkSession, d: str) -> DataFrame:
    docs = tokens(spark, d).groupBy("passage_id").agg(F.collect_list("lemma").alias("t"))
    return sinks.topic_listing(terms.als_topics(terms.tfidf(docs, "passage_id", "t", 3), "passage_id")[1])


@query()
def anchored_topic_scores(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("term"))
    anchors = spark.createDataFrame([(c, w) for c, ws in SEEDS.items() for w in ws], "topic string, term string")
    return terms.anchored_topics(t, "doc_id", anchors)


@query()
def anchored_correlation_terms(spark: SparkSession, d: str) -> DataFrame:
    """The terms of anchored topics over the windows of the passages."""
    docs = tokens(spark, d).filter(tx.is_content_word(F.col("lemma"))).select("passage_id", F.col("lemma").alias("term"))
    counts = docs.groupBy("term").agg(F.count("*").alias("n"))
    anchors = terms.ranked(counts, F.desc("n"), F.col("term")).filter("rank <= 10").select((F.col("rank") - 1).cast("int").alias("topic"), "term")
    return embed.anchored_correlation(docs, "passage_id", anchors)[1]


@query()
def subword_lemma_vectors(spark: SparkSession, d: str) -> DataFrame:
    s = tokens(spark, d).filter("lemma <> ''").groupBy("passage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("token_pos", "lemma"))), lambda x: x["lemma"]).alias("tokens"))
    return embed.subword_model(s)


@query()
def neighbours_reduced(spark: SparkSession, d: str) -> DataFrame:
    return embed.reduce_neighbours(emb(spark, d), "vec_id", "embedding")


@query()
def lemma_vectors(spark: SparkSession, d: str) -> DataFrame:
    s = tokens(spark, d).filter("lemma <> ''").groupBy("passage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("token_pos", "lemma"))), lambda x: x["lemma"]).alias("tokens"))
    return vectors.word_vectors(s)


# --- partitions


@query(f"SELECT A_primary AS a, B_primary AS b, count(*) AS n FROM {_LF} WHERE A_primary IS NOT NULL AND B_primary IS NOT NULL GROUP BY 1, 2")
def contingency_table(spark: SparkSession, d: str) -> DataFrame:
    lf = one_per_id(table(spark, d, "lemma_frames"), "row_id").select(F.col("A_primary").alias("a"), F.col("B_primary").alias("b"))
    return metrics.contingency(lf, "a", "b")


@query(f"WITH c AS (SELECT A_primary AS a, B_primary AS b, count(*) AS n FROM {_LF} WHERE A_primary IS NOT NULL AND B_primary IS NOT NULL GROUP BY 1, 2), s AS (SELECT sum(n) AS items, sum(n * (n - 1) / 2.0) AS s FROM c), x AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT CAST(items AS BIGINT) AS items, round((s - x.v * y.v / (items * (items - 1) / 2.0)) / ((x.v + y.v) / 2 - x.v * y.v / (items * (items - 1) / 2.0)), 6) AS ari FROM s, x, y")
def adjusted_rand_index(spark: SparkSession, d: str) -> DataFrame:
    lf = one_per_id(table(spark, d, "lemma_frames"), "row_id")
    return metrics.adjusted_rand(lf, "A_primary", "B_primary").withColumn("ari", F.round("ari", 6))


def _ami_sql(pairs: str) -> str:
    """SQL of the adjusted mutual information of a query with columns a and b."""
    h = lambda t: f"(SELECT -sum(n / w * ln(n / w)) FROM {t}, tot)"
    g = "lgamma(x.s + 1) + lgamma(y.s + 1) + lgamma(w - x.s + 1) + lgamma(w - y.s + 1) - lgamma(w + 1) - lgamma(v + 1) - lgamma(x.s - v + 1) - lgamma(y.s - v + 1) - lgamma(w - x.s - y.s + v + 1)"
    return f"WITH c AS (SELECT a, b, count(*) AS n FROM ({pairs}) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2), ra AS (SELECT a, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY 1), rb AS (SELECT b, CAST(sum(n) AS DOUBLE) AS n FROM c GROUP BY 1), tot AS (SELECT CAST(sum(n) AS DOUBLE) AS w FROM c), sa AS (SELECT n AS s, count(*) AS m FROM ra GROUP BY 1), sb AS (SELECT n AS s, count(*) AS m FROM rb GROUP BY 1), mi AS (SELECT sum(c.n / w * ln(c.n * w / (ra.n * rb.n))) AS mi FROM c JOIN ra USING (a) JOIN rb USING (b), tot), e AS (SELECT m, s, s2, w, unnest(range(CAST(greatest(1, s + s2 - w) AS BIGINT), CAST(least(s, s2) AS BIGINT) + 1)) AS v FROM (SELECT x.m * y.m AS m, x.s, y.s AS s2, w FROM sa x, sb y, tot)), emi AS (SELECT sum(m * v / w * ln(w * v / (s * s2)) * exp({g.replace('x.s', 's').replace('y.s', 's2')})) AS emi FROM e) SELECT CAST(w AS BIGINT) AS items, round(mi, 6) AS mi, round((mi - emi) / (({h('ra')} + {h('rb')}) / 2 - emi), 5) AS ami FROM mi, emi, tot"


@query(f"WITH p AS (SELECT a.pos AS a, b.lemma_group AS b FROM {_LEM} a JOIN {_LEM} b ON a.lemma_id = b.lemma_id WHERE a.pos IS NOT NULL AND b.lemma_group IS NOT NULL), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2), s AS (SELECT sum(n) AS items, sum(n * (n - 1) / 2.0) AS s FROM c), x AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY a)), y AS (SELECT sum(n * (n - 1) / 2.0) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY b)) SELECT CAST(items AS BIGINT) AS items, CASE WHEN items >= 10 THEN round((s - x.v * y.v / (items * (items - 1) / 2.0)) / ((x.v + y.v) / 2 - x.v * y.v / (items * (items - 1) / 2.0)), 6) END AS ari FROM s, x, y")
def partition_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two partitions of the lemmas compared over the lemmas that both label."""
    a, b = (lemmas(spark, d).select("lemma_id", F.col(c).alias("label")) for c in ("pos", "lemma_group"))
    return metrics.partition_agreement(a, b, "lemma_id", "label").withColumn("ari", F.round("ari", 6))


@query(_ami_sql(f"SELECT pos AS a, lemma_group AS b FROM {_LEM}"))
def adjusted_mutual_info(spark: SparkSession, d: str) -> DataFrame:
    return metrics.adjusted_mutual_information(lemmas(spark, d), "pos", "lemma_group").withColumns({"mi": F.round("mi", 6), "ami": F.round("ami", 5)})


@query(f"SELECT count(*) AS items, CAST(count_if(l = -1) AS BIGINT) AS noise, round(count_if(l = -1) / count(*), 6) AS noise_share, round(sum(CASE WHEN l = -1 THEN w ELSE 0 END) / sum(w), 6) AS weight_share FROM (SELECT CASE WHEN lsj_glosses IS NULL THEN -1 ELSE 0 END AS l, coalesce(homer_count, 0) AS w FROM {_LEM})")
def gloss_coverage(spark: SparkSession, d: str) -> DataFrame:
    t = lemmas(spark, d).select(F.when(F.col("lsj_glosses").isNull(), -1).otherwise(0).alias("label"), F.coalesce("homer_count", F.lit(0)).alias("w"))
    return metrics.coverage(t, "label", "w").withColumns({"noise_share": F.round("noise_share", 6), "weight_share": F.round("weight_share", 6)})


@query(f"WITH q AS (SELECT list_sort(list_distinct(quantile_cont(homer_count, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM {_LEM}), b AS (SELECT CASE WHEN homer_count IS NOT NULL THEN len(list_filter(e[2:len(e) - 1], lambda x: x < homer_count)) END AS bucket, homer_count FROM {_LEM}, q) SELECT CAST(bucket AS INT) AS bucket, count(*) AS n, min(homer_count) AS low, max(homer_count) AS high FROM b GROUP BY bucket")
def frequency_deciles(spark: SparkSession, d: str) -> DataFrame:
    return metrics.quantile_buckets(lemmas(spark, d), "homer_count", 10).groupBy("bucket").agg(F.count("*").alias("n"), F.min("homer_count").alias("low"), F.max("homer_count").alias("high"))


_DECILE = f"(WITH q AS (SELECT list_sort(list_distinct(quantile_cont(homer_count, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e FROM {_LEM}) SELECT *, CASE WHEN homer_count IS NOT NULL THEN len(list_filter(e[2:len(e) - 1], lambda x: x < homer_count)) END AS bucket FROM {_LEM}, q)"


@query(_ami_sql(f"SELECT lemma_group AS a, bucket AS b FROM {_DECILE}"))
def frequency_confound(spark: SparkSession, d: str) -> DataFrame:
    """How much groups follow the decile of frequency (M7)."""
    rows = metrics.quantile_buckets(lemmas(spark, d), "homer_count", 10)
    return metrics.adjusted_mutual_information(rows, "lemma_group", "bucket").withColumns({"mi": F.round("mi", 6), "ami": F.round("ami", 5)})


@query(f"SELECT pos, count(homer_count) AS n, round(avg(homer_count), 6) AS mean, median(homer_count) AS median, quantile_cont(homer_count, 0.1) AS p10, quantile_cont(homer_count, 0.9) AS p90, round(stddev_pop(homer_count), 6) AS sd FROM {_LEM} GROUP BY pos")
def frequency_statistics(spark: SparkSession, d: str) -> DataFrame:
    h = "homer_count"
    return lemmas(spark, d).groupBy("pos").agg(F.count(h).alias("n"), F.round(F.avg(h), 6).alias("mean"), F.percentile(h, F.lit(0.5)).alias("median"), F.percentile(h, F.lit(0.1)).alias("p10"), F.percentile(h, F.lit(0.9)).alias("p90"), F.round(F.stddev_pop(h), 6).alias("sd"))


@query(f"WITH f AS (SELECT lemma_group, strip_accents(lower(greek_lemma)) AS f FROM {_LEM}), n AS (SELECT lemma_group, count(*) AS n FROM f GROUP BY 1 HAVING count(*) >= 3), p AS (SELECT lemma_group, max(c) AS c FROM (SELECT lemma_group, left(f, 3) AS x, count(*) AS c FROM f WHERE length(f) >= 4 GROUP BY 1, 2) GROUP BY 1), s AS (SELECT lemma_group, max(c) AS c FROM (SELECT lemma_group, right(f, 3) AS x, count(*) AS c FROM f WHERE length(f) >= 4 GROUP BY 1, 2) GROUP BY 1) SELECT n.lemma_group, n, round(coalesce(p.c, 0) / n, 6) AS prefix_share, round(coalesce(s.c, 0) / n, 6) AS suffix_share FROM n LEFT JOIN p ON n.lemma_group = p.lemma_group LEFT JOIN s ON n.lemma_group = s.lemma_group")
def affix_shares(spark: SparkSession, d: str) -> DataFrame:
    f = lemmas(spark, d).select("lemma_group", tx.bare_lower(F.col("greek_lemma")).alias("f"))
    return metrics.affix_shares(f, "lemma_group", "f").withColumns({"prefix_share": F.round("prefix_share", 6), "suffix_share": F.round("suffix_share", 6)})


@query()
def form_confound(spark: SparkSession, d: str) -> DataFrame:
    """The groups whose shares of prefixes or suffixes exceed those of random groups of their sizes (M6)."""
    f = lemmas(spark, d).select("lemma_group", tx.bare_lower(F.col("greek_lemma")).alias("f"))
    return metrics.form_driven(f.filter("lemma_group IS NOT NULL AND f IS NOT NULL"), "lemma_group", "f")


@query()
def shuffled_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """The baseline of silhouette_score: the same labels dealt out at random (M1)."""
    return metrics.shuffled_silhouette(emb(spark, d), "label", "embedding", DIMS)


@query(f"WITH z AS (SELECT lemma_group, count(*) AS n FROM {_LEM} WHERE lemma_group IS NOT NULL GROUP BY 1) SELECT lemma_id, CAST(row_number() OVER () * 0 AS INT) + CAST(r - 1 AS INT) AS label FROM {_LEM} l JOIN (SELECT lemma_group, row_number() OVER (ORDER BY n DESC, lemma_group) AS r FROM z) k ON l.lemma_group = k.lemma_group")
def relabelled_by_size(spark: SparkSession, d: str) -> DataFrame:
    t = lemmas(spark, d).filter("lemma_group IS NOT NULL").select("lemma_id", F.col("lemma_group").alias("label"))
    return cluster.relabel_by_size(t, "label")


@query()
def sense_induction(spark: SparkSession, d: str) -> DataFrame:
    return cluster.induce_senses(emb(spark, d), "label", "vec_id", "embedding")


@query()
def ward_cuts(spark: SparkSession, d: str) -> DataFrame:
    return cluster.linkage_cuts(emb(spark, d), "vec_id", "embedding", (12, 25, 50), "ward")


@query()
def average_cuts(spark: SparkSession, d: str) -> DataFrame:
    return cluster.linkage_cuts(emb(spark, d), "vec_id", "embedding", (40, 80), "average")


@query()
def density_labels(spark: SparkSession, d: str) -> DataFrame:
    return cluster.density_clusters(emb(spark, d), "vec_id", "embedding", 8, 3, "cosine")


@query()
def graph_communities(spark: SparkSession, d: str) -> DataFrame:
    return cluster.communities(vectors.knn_edges(emb(spark, d), "vec_id", "embedding", 15), 1.0)


@query()
def seed_stability(spark: SparkSession, d: str) -> DataFrame:
    edges = cut(vectors.knn_edges(emb(spark, d), "vec_id", "embedding", 15), "edges")
    return stability.seed_stability(lambda seed: cluster.communities(edges, 1.0, seed))


@query()
def subsample_stability(spark: SparkSession, d: str) -> DataFrame:
    return stability.subsample_stability(emb(spark, d), "vec_id", "embedding", 10)


# --- lexicon


@query(f"WITH e AS (SELECT regexp_replace(greek_lemma, '\\d+$', '') AS h, list(lsj_glosses ORDER BY lemma_id) AS g FROM {_LEM} WHERE lsj_glosses <> '' GROUP BY 1), a AS (SELECT DISTINCT lemma, regexp_replace(lemma, '\\d+$', '') AS b, TRY_CAST(regexp_extract(lemma, '(\\d+)$', 1) AS INT) AS n FROM experiment WHERE lemma IS NOT NULL) SELECT lemma, CASE WHEN g IS NULL THEN '' WHEN n > 0 AND n <= len(g) THEN g[n] WHEN n > 0 THEN left(array_to_string(g, ' ; '), 400) ELSE g[1] END AS gloss, CASE WHEN g IS NULL THEN 'none' WHEN n > 0 AND n <= len(g) THEN 'lsj (homograph ' || n || ')' WHEN n > 0 THEN 'lsj (homographs merged)' ELSE 'lsj' END AS source FROM a LEFT JOIN e ON b = h")
def lemma_glosses(spark: SparkSession, d: str) -> DataFrame:
    base, _ = tx.homograph(F.col("greek_lemma"))
    entries = lemmas(spark, d).select(F.col("lemma_id").alias("seq"), base.alias("headword"), F.col("lsj_glosses").alias("gloss"))
    asked = table(spark, d, "experiment").select("lemma").filter("lemma IS NOT NULL").distinct()
    return lexicon.lemma_gloss(asked, entries)


@query(f"SELECT lemma, form AS matched_form, 'n' AS pos, synset_id FROM (SELECT DISTINCT lemma, lemma AS form FROM experiment WHERE lemma IS NOT NULL) w JOIN (SELECT greek_lemma AS f, A_primary AS synset_id, min(row_id) AS o FROM {_LF} GROUP BY 1, 2) i ON w.form = i.f")
def form_synset_links(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "experiment").select("lemma").filter("lemma IS NOT NULL").distinct().select("lemma", F.col("lemma").alias("form"), F.lit(0).alias("form_order"))
    index = one_per_id(table(spark, d, "lemma_frames"), "row_id").select(F.col("greek_lemma").alias("form"), F.lit("n").alias("pos"), F.lit(0).alias("pos_order"), F.col("A_primary").alias("synset_id"), F.col("row_id").alias("id_order"))
    return lexicon.form_links(wanted, index)


_FLAG = "CASE WHEN lower(trim(frame_status)) LIKE 'existing%' THEN 'core' WHEN lower(trim(frame_status)) LIKE 'proposed%' THEN 'plausible' ELSE 'noise' END"


@query(f"SELECT CASE WHEN grouping(lemma) = 1 THEN 'TOTAL' ELSE lemma END AS lemma, CAST(count_if(f = 'core') AS BIGINT) AS core, CAST(count_if(f = 'plausible') AS BIGINT) AS plausible, CAST(count_if(f = 'noise') AS BIGINT) AS noise, count(*) AS total FROM (SELECT greek_lemma AS lemma, {_FLAG} AS f FROM {_ASG}) GROUP BY ROLLUP (lemma)")
def flag_summary(spark: SparkSession, d: str) -> DataFrame:
    return lexicon.flag_summary(assignments(spark, d).select(F.col("greek_lemma").alias("lemma"), F.expr(_FLAG).alias("sense_flag")))


@query(f"WITH f AS (SELECT greek_lemma, frame, min({_FLAG}) AS sense_flag FROM {_ASG} WHERE assignment = 'primary' GROUP BY 1, 2), l AS (SELECT DISTINCT greek_lemma, frame FROM {_ASG}) SELECT l.greek_lemma AS lemma, l.frame AS synset_id, coalesce(sense_flag, 'noise') AS sense_flag FROM l LEFT JOIN f ON l.greek_lemma = f.greek_lemma AND l.frame = f.frame")
def flags_with_default(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of lemma and frame with the flag of their primary assignments."""
    a = assignments(spark, d).select(F.col("greek_lemma").alias("lemma"), F.col("frame").alias("synset_id"), F.expr(_FLAG).alias("f"), "assignment")
    flags = a.filter("assignment = 'primary'").groupBy("lemma", "synset_id").agg(F.min("f").alias("sense_flag"), F.lit("").alias("reason"))
    return lexicon.flag_synsets(a.select("lemma", "synset_id").distinct(), flags).drop("reason")


@query(f"SELECT row_id, greek_lemma, f AS sense_flag FROM (SELECT *, {_FLAG} AS f FROM {_ASG}) WHERE f IN ('core', 'plausible')")
def kept_senses(spark: SparkSession, d: str) -> DataFrame:
    """The assignments whose flag isn't noise."""
    return lexicon.kept_senses(assignments(spark, d).select("row_id", "greek_lemma", F.expr(_FLAG).alias("sense_flag")))


@query(f"WITH a AS (SELECT greek_lemma, min({_FLAG}) AS f FROM {_ASG} WHERE assignment = 'primary' GROUP BY 1), b AS (SELECT greek_lemma, min({_FLAG}) AS f FROM {_ASG} WHERE assignment <> 'primary' GROUP BY 1) SELECT a.f AS flag_a, b.f AS flag_b, count(*) AS n FROM a JOIN b ON a.greek_lemma = b.greek_lemma GROUP BY 1, 2")
def flag_confusion(spark: SparkSession, d: str) -> DataFrame:
    """The flags of primary against those of other assignments of the same lemma."""
    a = assignments(spark, d).withColumn("sense_flag", F.expr(_FLAG))
    side = lambda c: a.filter(c).groupBy("greek_lemma").agg(F.min("sense_flag").alias("sense_flag"))
    return lexicon.confusion(side("assignment = 'primary'"), side("assignment <> 'primary'"), ["greek_lemma"])


@query(f"WITH f AS (SELECT greek_lemma AS lemma, list_distinct(list(frame)) AS s FROM {_ASG} GROUP BY 1), m AS (SELECT lemma_group AS cluster, greek_lemma AS lemma FROM {_LEM} WHERE lemma_group IS NOT NULL), c AS (SELECT cluster, count_if(s IS NOT NULL) / count(*) AS coverage FROM m LEFT JOIN f ON m.lemma = f.lemma GROUP BY 1), v AS (SELECT cluster, field, count(*) AS votes FROM (SELECT cluster, unnest(s) AS field FROM m JOIN f ON m.lemma = f.lemma) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY votes DESC, field) AS r FROM v) SELECT r.cluster, field, votes, round(coverage, 6) AS coverage FROM r JOIN c ON r.cluster = c.cluster WHERE r <= 3 AND votes >= 2")
def field_votes(spark: SparkSession, d: str) -> DataFrame:
    f = assignments(spark, d).groupBy(F.col("greek_lemma").alias("lemma")).agg(F.collect_set("frame").alias("semfields")).withColumn("found", F.lit(True))
    m = lemmas(spark, d).filter("lemma_group IS NOT NULL").select(F.col("lemma_group").alias("cluster"), F.col("greek_lemma").alias("lemma"))
    return lexicon.field_votes(m, f).withColumn("coverage", F.round("coverage", 6))


_PF = "(SELECT DISTINCT ON (frame_id) * FROM proposed_frames)"


@query(f"WITH p AS {_PF}, r AS (SELECT name AS src, arg_min(inherits[1], frame_id) AS tgt FROM p WHERE len(inherits) > 0 GROUP BY 1), w AS (SELECT name AS tgt, min(definition) AS words FROM p GROUP BY 1) SELECT DISTINCT p.name AS synset_id, coalesce(words, '') AS hypernym_words FROM p LEFT JOIN r ON p.name = r.src LEFT JOIN w ON r.tgt = w.tgt")
def hypernym_words(spark: SparkSession, d: str) -> DataFrame:
    p = one_per_id(table(spark, d, "proposed_frames"), "frame_id")
    rel = p.filter(F.size("inherits") > 0).select(F.col("frame_id").alias("seq"), F.lit("@").alias("type"), F.col("name").alias("src"), F.col("inherits")[0].alias("tgt"))
    syn = p.groupBy(F.col("name").alias("synset_id")).agg(F.min("definition").alias("words"))
    return lexicon.hypernyms(p.select(F.col("name").alias("synset_id")).distinct(), rel, syn)


@query()
def resolved_synsets(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.filter(F.array_distinct(F.split(tx.plain_words(F.col(c)), " ")), lambda w: w != "")
    asked = lemmas(spark, d).filter("lsj_glosses <> ''").select(F.col("lemma_id").alias("id"), F.lit("n").alias("pos"), key("lsj_glosses").alias("words"), F.col("lsj_glosses").alias("gloss"))
    dictionary = one_per_id(table(spark, d, "lemma_frames"), "row_id").filter("gloss <> ''").select(F.col("row_id").alias("synset"), F.lit("n").alias("pos"), key("gloss").alias("lemmas"), F.col("gloss").alias("definition"))
    return lexicon.resolve_synsets(asked, dictionary).select("id", "synset", "id_match")


@query(f"SELECT frame, count(DISTINCT greek_lemma) AS lemmas FROM {_ASG} WHERE frame IS NOT NULL GROUP BY frame HAVING count(DISTINCT greek_lemma) > 1")
def shared_concepts(spark: SparkSession, d: str) -> DataFrame:
    return assignments(spark, d).filter("frame IS NOT NULL").groupBy("frame").agg(F.countDistinct("greek_lemma").alias("lemmas")).filter("lemmas > 1")


@query(f"SELECT greek_lemma, count(DISTINCT word_sense) AS senses, count(DISTINCT frame) AS frames FROM {_ASG} GROUP BY 1 HAVING count(DISTINCT word_sense) > 1 AND count(DISTINCT frame) >= 2")
def polysemy_spread(spark: SparkSession, d: str) -> DataFrame:
    return assignments(spark, d).groupBy("greek_lemma").agg(F.countDistinct("word_sense").alias("senses"), F.countDistinct("frame").alias("frames")).filter("senses > 1 AND frames >= 2")


@query(f"SELECT senses, count(*) AS lemmas FROM (SELECT count(DISTINCT word_sense) AS senses FROM {_ASG} GROUP BY greek_lemma) GROUP BY senses")
def senses_histogram(spark: SparkSession, d: str) -> DataFrame:
    return assignments(spark, d).groupBy("greek_lemma").agg(F.countDistinct("word_sense").alias("senses")).groupBy("senses").agg(F.count("*").alias("lemmas"))


@query(f"SELECT greek_lemma, word_sense, n FROM (SELECT greek_lemma, word_sense, count(*) AS n, row_number() OVER (PARTITION BY greek_lemma ORDER BY count(*) DESC, word_sense) AS r FROM {_ASG} WHERE word_sense IS NOT NULL GROUP BY 1, 2) WHERE r = 1")
def largest_sense(spark: SparkSession, d: str) -> DataFrame:
    n = assignments(spark, d).filter("word_sense IS NOT NULL").groupBy("greek_lemma", "word_sense").agg(F.count("*").alias("n"))
    return terms.top_k(n, ["greek_lemma"], [F.desc("n"), F.col("word_sense")], 1).drop("rank")


@query(f"SELECT lemma, p AS pos FROM (SELECT lemma, substr(postag, 1, 1) AS p, row_number() OVER (PARTITION BY lemma ORDER BY count(*) DESC, min((passage_id, token_pos))) AS r FROM {_TOK} WHERE lemma <> '' AND postag <> '' GROUP BY 1, 2) WHERE r = 1")
def majority_pos(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent part of speech of each lemma; of equally frequent ones the first seen."""
    n = tokens(spark, d).filter("lemma <> '' AND postag <> ''").groupBy("lemma", F.substring("postag", 1, 1).alias("p")).agg(F.count("*").alias("n"), F.min(F.struct("passage_id", "token_pos")).alias("at"))
    return n.groupBy("lemma").agg(F.min_by("p", F.struct(-F.col("n"), "at")).alias("pos"))


@query(f"WITH t AS {_TOK}, c AS (SELECT passage_id, lemma, count(*) AS k FROM t WHERE lemma <> '' AND lemma NOT IN ({_STOPS}) GROUP BY 1, 2), n AS (SELECT a.lemma, b.lemma AS context, CAST(sum(a.k * b.k) AS BIGINT) AS n FROM c a JOIN c b ON a.passage_id = b.passage_id WHERE a.lemma <> b.lemma GROUP BY 1, 2) SELECT lemma, context, n, CAST(row_number() OVER (PARTITION BY lemma ORDER BY n DESC, context) AS BIGINT) AS rank FROM n QUALIFY rank <= 12")
def context_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """The lemmas around every lemma of the passages."""
    return terms.context_lemmas(tokens(spark, d), "passage_id", "lemma", STOPS).withColumn("rank", F.col("rank").cast("bigint"))


# --- comparison and validation


def _run_sql(r: str) -> str:
    return f"(SELECT greek_lemma, coalesce(arg_min(frame, row_id) FILTER (prim), '') AS prim, list_sort(list_distinct(list(frame) FILTER (frame IS NOT NULL))) AS f FROM (SELECT row_id, greek_lemma, {r}_primary AS frame, true AS prim FROM {_LF} UNION ALL SELECT row_id, greek_lemma, unnest(string_split({r}_frames, '; ')), false FROM {_LF}) WHERE greek_lemma IS NOT NULL GROUP BY 1)"


def _run(spark: SparkSession, d: str, r: str) -> DataFrame:
    """Run A or B of lemma_frames as assignments."""
    lf = one_per_id(table(spark, d, "lemma_frames"), "row_id")
    first = lf.select("row_id", "greek_lemma", F.col(f"{r}_primary").alias("frame"), F.lit("primary").alias("assignment"))
    return first.union(lf.select("row_id", "greek_lemma", F.explode(F.split(f"{r}_frames", "; ")), F.lit("secondary")))


@query(f"SELECT coalesce(a.greek_lemma, b.greek_lemma) AS greek_lemma, coalesce(a.prim, '') AS a_primary, coalesce(b.prim, '') AS b_primary, coalesce(a.prim, '') = coalesce(b.prim, '') AS same_primary, array_to_string(list_filter(coalesce(a.f, []), lambda x: NOT list_contains(coalesce(b.f, []), x)), '; ') AS only_a, array_to_string(list_filter(coalesce(b.f, []), lambda x: NOT list_contains(coalesce(a.f, []), x)), '; ') AS only_b, round(CASE WHEN len(coalesce(a.f, [])) + len(coalesce(b.f, [])) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(a.f, []), coalesce(b.f, []))) / len(list_distinct(list_concat(coalesce(a.f, []), coalesce(b.f, [])))) END, 6) AS overlap FROM {_run_sql('A')} a FULL JOIN {_run_sql('B')} b ON a.greek_lemma = b.greek_lemma")
def compared_runs(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare_runs(_run(spark, d, "A"), _run(spark, d, "B")).withColumn("overlap", F.round("overlap", 6))


# existing frames are one run, the others another
_T = f"(SELECT sentence_id, s, e, k, min(frame) AS frame, list_sort(list_distinct(list(fe) FILTER (fe IS NOT NULL))) AS fes FROM (SELECT sentence_id, a.target.start AS s, a.target['end'] AS e, coalesce(a.frameStatus = 'existing', false) AS k, a.frameName AS frame, unnest(CASE WHEN len(a.FEs) > 0 THEN list_transform(a.FEs, lambda x: x.name) ELSE [NULL] END) AS fe FROM {_SET} WHERE a.target.start IS NOT NULL AND a.target['end'] IS NOT NULL) GROUP BY 1, 2, 3, 4)"


@query(f"WITH t AS {_T}, a AS (SELECT * FROM t WHERE k), b AS (SELECT * FROM t WHERE NOT k) SELECT coalesce(a.sentence_id, b.sentence_id) AS sentence_id, coalesce(a.s, b.s) AS s, coalesce(a.e, b.e) AS e, coalesce(a.frame, '–') AS a_frame, coalesce(b.frame, '–') AS b_frame, coalesce(a.frame = b.frame, false) AS same_frame, coalesce(a.frame = b.frame, false) AND coalesce(a.fes, []) = coalesce(b.fes, []) AS same_fes FROM a FULL JOIN b ON a.sentence_id = b.sentence_id AND a.s = b.s AND a.e = b.e")
def compared_targets(spark: SparkSession, d: str) -> DataFrame:
    s = one_per_id(table(spark, d, "odyssey_7_189_framenet"), "sentence_id", "annotationSets").select("sentence_id", F.posexplode("annotationSets").alias("i", "a")).filter("a.target.start IS NOT NULL AND a.target.end IS NOT NULL")
    t = s.select("sentence_id", F.col("a.target.start").alias("s"), F.col("a.target.end").alias("e"), F.coalesce(F.col("a.frameStatus") == "existing", F.lit(False)).alias("k"), F.col("a.frameName").alias("frame"), F.explode_outer("a.FEs.name").alias("fe"))
    g = t.groupBy("sentence_id", "s", "e", "k").agg(F.min("frame").alias("frame"), F.array_sort(F.collect_set("fe")).alias("fes"))
    return compare.compare_targets(g.filter("k"), g.filter("NOT k"), ["sentence_id", "s", "e"])


@query("WITH x AS (SELECT DISTINCT lemma, slug FROM experiment WHERE lemma IS NOT NULL AND slug IS NOT NULL) SELECT a.slug AS slug_a, b.slug AS slug_b, count(*) AS shared FROM x a JOIN x b ON a.lemma = b.lemma AND a.slug < b.slug GROUP BY 1, 2")
def shared_experiment_lemmas(spark: SparkSession, d: str) -> DataFrame:
    return compare.shared_lemmas(table(spark, d, "experiment"))


@query(f"SELECT name, count(DISTINCT frame_id) AS proposals, CAST(count(DISTINCT l) AS BIGINT) AS lemmas FROM (SELECT name, frame_id, unnest(CASE WHEN len(lexical_units) > 0 THEN list_transform(lexical_units, lambda x: x.lemma) ELSE [NULL] END) AS l FROM {_PF} WHERE name IS NOT NULL) GROUP BY name")
def merged_proposals(spark: SparkSession, d: str) -> DataFrame:
    m = compare.merge_proposed(one_per_id(table(spark, d, "proposed_frames"), "frame_id"))
    return m.select("name", "proposals", F.size("lemmas").cast("bigint").alias("lemmas"))


@query(f"SELECT assignment, count(*) AS rows, count(DISTINCT greek_lemma) AS lemmas, count(DISTINCT frame) AS frames, CAST(count_if(assignment = 'primary') AS BIGINT) AS primaries, CAST(count_if(assignment = 'primary' AND lower(trim(coalesce(frame_status, ''))) LIKE 'proposed%') AS BIGINT) AS proposed_primaries FROM {_ASG} GROUP BY assignment")
def run_statistics(spark: SparkSession, d: str) -> DataFrame:
    return compare.run_stats(assignments(spark, d), ["assignment"])


@query(f"SELECT row_id, round(CASE WHEN len(u) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / len(u) END, 6) AS overlap FROM (SELECT row_id, a, b, list_distinct(list_concat(a, b)) AS u FROM (SELECT row_id, list_distinct(string_split(A_frames, '; ')) AS a, list_distinct(string_split(B_frames, '; ')) AS b FROM {_LF})) WHERE a IS NOT NULL AND b IS NOT NULL")
def frame_set_overlap(spark: SparkSession, d: str) -> DataFrame:
    lf = one_per_id(table(spark, d, "lemma_frames"), "row_id").filter("A_frames IS NOT NULL AND B_frames IS NOT NULL")
    return lf.select("row_id", F.round(tx.jaccard(F.split("A_frames", "; "), F.split("B_frames", "; ")), 6).alias("overlap"))


_PLANTED = "CASE WHEN kind = 'target' THEN s + 1 ELSE s END"


@query(f"SELECT sentence_id, CAST(set_pos AS BIGINT) AS set_pos, kind, CAST(item_pos AS BIGINT) AS item_pos FROM {_SPAN} WHERE s IS NOT NULL AND e IS NOT NULL AND NOT coalesce(substr(text, {_PLANTED} + 1, e - ({_PLANTED}) + 1) = span_text, false)")
def span_violations(spark: SparkSession, d: str) -> DataFrame:
    """The spans of a copy of the table whose targets begin one place late: all targets with both bounds, besides what is broken in the table."""
    late = spans_of(spark, d).withColumn("start", F.when(F.col("kind") == "target", F.col("start") + 1).otherwise(F.col("start")))
    return validate.span_violations(late).select("sentence_id", F.col("set_pos").cast("bigint").alias("set_pos"), "kind", F.col("item_pos").cast("bigint").alias("item_pos"))


@query(f"WITH r AS (SELECT row_id, frame, list_sort(list_distinct(string_split(coalesce(frame_core_FEs, ''), ', '))) AS c FROM {_ASG} WHERE lower(trim(frame_status)) LIKE 'existing%'), k AS (SELECT name AS frame, arg_min(list_sort(list_distinct(list_transform(core_FEs, lambda x: x.name))), frame_id) AS c FROM {_PF} WHERE name IS NOT NULL AND len(core_FEs) > 0 GROUP BY 1) SELECT row_id, r.frame, CASE WHEN k.c IS NULL THEN 'unknown frame' ELSE 'core FEs differ' END AS problem FROM r LEFT JOIN k ON r.frame = k.frame WHERE k.c IS NULL OR k.c <> r.c")
def frame_violations(spark: SparkSession, d: str) -> DataFrame:
    """The assignments of existing frames against the frames of proposed_frames, the first of each name with core FEs."""
    a = assignments(spark, d).withColumn("core_fes", F.split(F.coalesce("frame_core_FEs", F.lit("")), ", "))
    known = one_per_id(table(spark, d, "proposed_frames"), "frame_id").filter("name IS NOT NULL AND size(core_FEs) > 0").groupBy(F.col("name").alias("frame")).agg(F.min_by(F.array_compact("core_FEs.name"), "frame_id").alias("core_fes"))
    return validate.frame_violations(a.select("row_id", "frame", F.col("frame_status").alias("status"), "core_fes"), known)


_FES = f"(SELECT name AS frame, f.name AS fe FROM (SELECT name, unnest(core_FEs) AS f FROM {_PF} UNION ALL SELECT name, unnest(noncore_FEs) FROM {_PF}))"


@query(f"SELECT sentence_id, CAST(set_pos AS BIGINT) AS set_pos, CAST(item_pos AS BIGINT) AS item_pos, frame, name AS fe FROM {_SPAN} WHERE kind = 'FE' AND name IS NOT NULL AND frame IN (SELECT name FROM {_PF}) AND (frame, name) NOT IN (SELECT frame, fe FROM {_FES} WHERE frame IS NOT NULL AND fe IS NOT NULL)")
def element_violations(spark: SparkSession, d: str) -> DataFrame:
    """Annotated elements that their frame, where it is a proposed one, doesn't have (V2)."""
    e = spans_of(spark, d).filter("kind = 'FE'").select("sentence_id", F.col("set_pos").cast("bigint").alias("set_pos"), F.col("item_pos").cast("bigint").alias("item_pos"), "frame", F.col("name").alias("fe"))
    p = one_per_id(table(spark, d, "proposed_frames"), "frame_id")
    none = F.array().cast("array<string>")
    return validate.element_violations(e, p.select(F.col("name").alias("frame"), F.concat(F.coalesce("core_FEs.name", none), F.coalesce("noncore_FEs.name", none)).alias("fes")))


@query(f"SELECT name AS frame, u.lemma AS lemma, u.pos AS pos FROM (SELECT name, unnest(lexical_units) AS u FROM {_PF}) WHERE regexp_matches(u.lemma, '^[αἀἁ]')")
def searched_units(spark: SparkSession, d: str) -> DataFrame:
    p = one_per_id(table(spark, d, "proposed_frames"), "frame_id")
    return validate.search_units(p.select(F.col("name").alias("frame"), "lexical_units"), "^[αἀἁ]")


@query(f"SELECT DISTINCT greek_lemma FROM {_LF} WHERE greek_lemma IS NOT NULL AND greek_lemma NOT IN (SELECT greek_lemma FROM lemmas WHERE greek_lemma IS NOT NULL)")
def missing_lemmas(spark: SparkSession, d: str) -> DataFrame:
    return validate.missing(table(spark, d, "lemma_frames"), table(spark, d, "lemmas"), "greek_lemma")


@query(f"SELECT frame_id, name FROM {_PF} WHERE regexp_matches(name, '(?i)^(loom|hearth)_')")
def frame_lookup(spark: SparkSession, d: str) -> DataFrame:
    return validate.lookup(one_per_id(table(spark, d, "proposed_frames"), "frame_id"), "name", "^(loom|hearth)_").select("frame_id", "name")


@query(f"WITH a AS (SELECT DISTINCT lemma FROM experiment), b AS (SELECT DISTINCT greek_lemma AS lemma FROM {_ASG}) SELECT lemma, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT lemma, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def lemma_set_difference(spark: SparkSession, d: str) -> DataFrame:
    return validate.set_difference(table(spark, d, "experiment").select("lemma"), assignments(spark, d).select(F.col("greek_lemma").alias("lemma")))


# --- spans and passages


@query(f"SELECT passage_id, CAST(token_pos AS BIGINT) AS token_pos, CAST(coalesce(sum(length(form) + 1) OVER (PARTITION BY passage_id ORDER BY token_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, CAST(coalesce(sum(length(form) + 1) OVER (PARTITION BY passage_id ORDER BY token_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(form) AS BIGINT) AS e FROM {_TOK} WHERE form IS NOT NULL")
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    t = spans.running_offsets(tokens(spark, d).filter("form IS NOT NULL"), ["passage_id"], "token_pos")
    return t.select("passage_id", F.col("token_pos").cast("bigint").alias("token_pos"), F.col("start").cast("bigint").alias("s"), F.col("end").cast("bigint").alias("e"))


@query(f"WITH f AS (SELECT * FROM {_SPAN} WHERE s IS NOT NULL AND e IS NOT NULL) SELECT a.sentence_id, CAST(a.set_pos * 1000 + a.item_pos AS BIGINT) AS a_id, CAST(b.set_pos AS BIGINT) AS b_id FROM f a JOIN f b ON a.sentence_id = b.sentence_id WHERE a.kind = 'FE' AND b.kind = 'target' AND a.s < a.e + 1 AND b.s < b.e + 1 AND a.s < b.e + 1 AND a.e + 1 > b.s")
def span_overlaps(spark: SparkSession, d: str) -> DataFrame:
    s = spans_of(spark, d).filter("start IS NOT NULL AND end IS NOT NULL").withColumn("end", F.col("end") + 1)
    a = s.filter("kind = 'FE'").withColumn("a_id", (F.col("set_pos") * 1000 + F.col("item_pos")).cast("bigint"))
    b = s.filter("kind = 'target'").withColumn("b_id", F.col("set_pos").cast("bigint"))
    return spans.overlaps(a, b, ["sentence_id"]).select("sentence_id", "a_id", "b_id")


@query(f"WITH f AS (SELECT * FROM {_SPAN} WHERE s IS NOT NULL AND e IS NOT NULL) SELECT a.sentence_id, CAST(a.set_pos * 1000 + a.item_pos AS BIGINT) AS token_pos, CAST(min(b.set_pos) AS BIGINT) AS target_pos FROM f a JOIN f b ON a.sentence_id = b.sentence_id WHERE a.kind = 'FE' AND b.kind = 'target' AND a.s <= b.e AND a.e >= b.s GROUP BY 1, 2")
def first_targets(spark: SparkSession, d: str) -> DataFrame:
    s = spans_of(spark, d).filter("start IS NOT NULL AND end IS NOT NULL")
    t = s.filter("kind = 'FE'").withColumn("token_pos", (F.col("set_pos") * 1000 + F.col("item_pos")).cast("bigint"))
    return spans.first_target(t, s.filter("kind = 'target'").withColumn("target_pos", F.col("set_pos").cast("bigint")), "sentence_id")


@query(f"WITH f AS (SELECT * FROM {_SPAN} WHERE s <= e) SELECT a.sentence_id, CAST(b.set_pos * 1000 + b.item_pos AS BIGINT) AS fe_id, CAST(a.set_pos AS BIGINT) AS token_pos FROM f a JOIN f b ON a.sentence_id = b.sentence_id WHERE a.kind = 'target' AND b.kind = 'FE' AND a.s >= b.s AND a.e <= b.e")
def contained_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets that lie wholly inside an element, as tokens do."""
    s = spans_of(spark, d)
    t = s.filter("kind = 'target'").withColumn("token_pos", F.col("set_pos").cast("bigint"))
    e = s.filter("kind = 'FE'").withColumn("fe_id", (F.col("set_pos") * 1000 + F.col("item_pos")).cast("bigint"))
    return spans.contained_tokens(t, e, "sentence_id")


@query(f"SELECT slug, passage_id, n_lemmas, n_words FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY n_lemmas DESC, n_words, passage_id) AS r FROM (SELECT slug, passage_id, count(DISTINCT t.lemma) AS n_lemmas FROM (SELECT DISTINCT slug, lemma FROM experiment) w JOIN {_TOK} t ON w.lemma = t.lemma GROUP BY 1, 2 HAVING count(DISTINCT t.lemma) >= 2) JOIN (SELECT passage_id AS p, count(*) AS n_words FROM {_TOK} GROUP BY 1) ON passage_id = p) WHERE r <= 15")
def ranked_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages with most lemmas of each experiment (L3)."""
    return spans.rank_passages(tokens(spark, d), "passage_id", "lemma", table(spark, d, "experiment"), "slug")


@query(f"WITH t AS {_TOK}, p AS (SELECT passage_id AS passage, work, cite FROM t WHERE passage_id % 100 = 0) SELECT DISTINCT p.passage, t.work, t.passage_id AS sentence_id FROM p JOIN t ON p.work = t.work AND p.cite = t.cite")
def passage_collection(spark: SparkSession, d: str) -> DataFrame:
    t = tokens(spark, d)
    asked = t.filter("passage_id % 100 = 0").groupBy(F.col("passage_id").alias("passage"), "work").agg(F.collect_set("cite").alias("cites"))
    return spans.passage_sentences(t.withColumnRenamed("passage_id", "sentence_id"), asked)


# --- trees, over a synthetic tree of each passage: word i hangs from word i/2


def _forest(spark: SparkSession, d: str) -> DataFrame:
    tag = tx.decode_postag(F.col("postag"))
    i = F.col("token_pos")
    rel = F.element_at(F.array(*[F.lit(x) for x in ("COORD", "OBJ_CO", "SBJ", "AuxP", "ADV", "PNOM", "OBJ")]), (i % 7 + 1).cast("int"))
    return tokens(spark, d).select("work", F.col("passage_id").alias("sentence_id"), F.lit(1).alias("book"), F.lit(1).alias("line"), i.alias("word_id"), F.when(i > 1, (i / 2).cast("int")).alias("head"), F.coalesce("lemma", F.lit("")).alias("lemma"), rel.alias("relation"), *[c.alias(n) for n, c in tag.items()])


_FOREST = f"(SELECT work, passage_id AS sid, token_pos AS id, CASE WHEN token_pos > 1 THEN token_pos // 2 END AS head, coalesce(lemma, '') AS lemma, ['COORD', 'OBJ_CO', 'SBJ', 'AuxP', 'ADV', 'PNOM', 'OBJ'][token_pos % 7 + 1] AS rel, nullif(substr(rpad(coalesce(postag, ''), 9, '-'), 1, 1), '-') AS pos, nullif(substr(rpad(coalesce(postag, ''), 9, '-'), 8, 1), '-') AS gcase FROM {_TOK})"
_ARGS = f"t AS {_FOREST}, k AS (SELECT *, rel LIKE '%\\_CO' ESCAPE '\\' AS marked, replace(rel, '_CO', '') AS base, coalesce(pos IN ('n', 'p', 'a', 'm'), false) AND lemma <> '' AND regexp_matches(lemma, '{_GREEK}') AS filler FROM t), o AS (SELECT work, sid, head, arg_min(lemma, id) AS ol, min(id) AS oid FROM k WHERE filler GROUP BY 1, 2, 3), w AS (SELECT work, sid, id AS verb, id AS node FROM t WHERE pos = 'v' AND lemma <> '' AND regexp_matches(lemma, '{_GREEK}')), x AS (SELECT work, sid, verb, node FROM w UNION ALL SELECT x.work, x.sid, verb, k.id FROM x JOIN k ON x.work = k.work AND x.sid = k.sid AND k.head = x.node WHERE base = 'COORD' OR (base IN ('SBJ', 'OBJ', 'PNOM') AND marked)), e AS (SELECT x.work, x.sid, x.verb, k.base, k.id, CASE WHEN base IN ('SBJ', 'OBJ', 'PNOM') AND filler THEN lower(base) WHEN base = 'AuxP' AND ol IS NOT NULL THEN 'oblique' WHEN base = 'ADV' AND filler THEN 'oblique' END AS slot, CASE WHEN base = 'AuxP' THEN ol ELSE k.lemma END AS filler FROM x JOIN k ON x.work = k.work AND x.sid = k.sid AND k.head = x.node LEFT JOIN o ON k.work = o.work AND k.sid = o.sid AND o.head = k.id)"


@query(f"WITH RECURSIVE {_ARGS} SELECT work, sid AS sentence_id, CAST(verb AS BIGINT) AS verb_id, slot, filler, count(*) AS n FROM e WHERE slot IS NOT NULL GROUP BY ALL")
def argument_edges(spark: SparkSession, d: str) -> DataFrame:
    e = tree.argument_edges(_forest(spark, d))
    return e.groupBy("work", "sentence_id", F.col("verb_id").cast("bigint").alias("verb_id"), "slot", "filler").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {_ARGS} SELECT t.lemma AS verb_lemma, slot, filler AS term, count(*) AS n FROM e JOIN t ON e.work = t.work AND e.sid = t.sid AND e.verb = t.id WHERE slot IN ('sbj', 'obj') GROUP BY ALL")
def slot_fillers(spark: SparkSession, d: str) -> DataFrame:
    return tree.slot_fillers(tree.predicate_arguments(_forest(spark, d)))


@query()
def predicate_arguments(spark: SparkSession, d: str) -> DataFrame:
    return tree.predicate_arguments(_forest(spark, d))


@query()
def verb_profile_vectors(spark: SparkSession, d: str) -> DataFrame:
    fillers = tree.slot_fillers(tree.predicate_arguments(_forest(spark, d)))
    words = vectors.hashed_embedding(lemmas(spark, d).filter("greek_lemma IS NOT NULL").select(F.col("greek_lemma").alias("term")), "term", "term", 32)
    return tree.verb_vectors(fillers, words, 32)


# --- category search: each vector a sense, five senses an entry

# an entry of a sense with label 0, 1 or 2 holds a seed of that category
_SC = "(SELECT vec_id // 5 AS entry, vec_id AS sense, c.category, label = c.k - 1 AS is_seed, CAST(embedding[c.k] AS DOUBLE) * 4 AS pos, CAST(embedding[c.k + 3] AS DOUBLE) * 4 AS neg FROM embeddings CROSS JOIN (VALUES ('c1', 1), ('c2', 2), ('c3', 3)) c(category, k))"
_GATE = f"(SELECT entry, category, max(pos) AS pos_score, max(neg) AS neg_score, max(pos - neg) AS margin, bool_or(pos - neg >= 0.06 AND pos >= 0.7) AS base, bool_or(pos - neg >= 0.06 AND pos >= 0.4) AND bool_or(is_seed) AS seed FROM {_SC} GROUP BY 1, 2)"


def _gate(spark: SparkSession, d: str) -> DataFrame:
    x = lambda i: F.col("embedding")[i].cast("double") * 4
    e = emb(spark, d).select(F.floor(F.col("vec_id") / 5).alias("entry"), F.col("vec_id").alias("sense"), F.explode(F.array(*[F.struct(F.lit(f"c{k}").alias("category"), x(k - 1).alias("pos"), x(k + 2).alias("neg")) for k in (1, 2, 3)])).alias("s")).select("entry", "sense", "s.*")
    seeds = emb(spark, d).filter("label BETWEEN 0 AND 2").select(F.floor(F.col("vec_id") / 5).alias("entry"), F.concat(F.lit("c"), (F.col("label") + 1).cast("string")).alias("category")).distinct()
    return classify.sense_gate(e, seeds)


@query(f"SELECT entry, category, round(pos_score, 6) AS pos_score, round(neg_score, 6) AS neg_score, round(margin, 6) AS margin, CASE WHEN base AND seed THEN 'both' WHEN base THEN 'embedding' ELSE 'seed' END AS method FROM {_GATE} WHERE base OR seed")
def sense_gate(spark: SparkSession, d: str) -> DataFrame:
    return _gate(spark, d).withColumns({c: F.round(c, 6) for c in ("pos_score", "neg_score", "margin")})


@query(f"SELECT entry, category, r = 1 AS is_best FROM (SELECT entry, category, pos_score, max(pos_score) OVER (PARTITION BY entry) AS m, row_number() OVER (PARTITION BY entry ORDER BY pos_score DESC, category) AS r FROM {_GATE} WHERE base OR seed) WHERE m - pos_score <= 0.04")
def best_categories(spark: SparkSession, d: str) -> DataFrame:
    return classify.best_categories(_gate(spark, d)).select("entry", "category", "is_best")


@query(f"SELECT category, entry, round(pos_score, 6) AS pos_score, CAST(row_number() OVER (ORDER BY category, pos_score DESC, entry) AS BIGINT) AS place FROM {_GATE} WHERE base OR seed")
def sorted_categories(spark: SparkSession, d: str) -> DataFrame:
    """Assignments by category and falling score, with their place in that order (L4)."""
    placed = terms.ranked(_gate(spark, d), F.col("category"), F.desc("pos_score"), F.col("entry"))
    return placed.select("category", "entry", F.round("pos_score", 6).alias("pos_score"), F.col("rank").cast("bigint").alias("place"))


@query(f"SELECT entry, string_agg(category, ',' ORDER BY category) AS categories FROM (SELECT DISTINCT entry, category FROM {_GATE} WHERE base OR seed) GROUP BY entry")
def categories_by_entry(spark: SparkSession, d: str) -> DataFrame:
    g = _gate(spark, d)
    u = classify.seed_or_embedding(g.filter("method <> 'embedding'"), g.filter("method <> 'seed'"))
    return u.select("entry", F.array_join("categories", ",").alias("categories"))


# --- sinks


_LIST = f"(SELECT *, dense_rank() OVER (ORDER BY lemma_group) AS cluster, row_number() OVER (PARTITION BY lemma_group ORDER BY homer_count DESC NULLS LAST, lemma_id) AS r FROM {_LEM} WHERE lemma_group IS NOT NULL)"


@query(f"SELECT CAST(cluster AS BIGINT) AS cluster, count(*) AS size, 'cluster ' || cluster || ' (' || count(*) || ')' || chr(10) || string_agg('  ' || coalesce(greek_lemma, 'null') || ' (' || coalesce(homer_count, 0) || '): ' || substr(coalesce(lsj_glosses, ''), 1, 90), chr(10) ORDER BY r) AS body FROM {_LIST} GROUP BY cluster")
def cluster_listing(spark: SparkSession, d: str) -> DataFrame:
    m = lemmas(spark, d).filter("lemma_group IS NOT NULL")
    m = m.withColumn("rank", F.row_number().over(Window.partitionBy("lemma_group").orderBy(F.desc_nulls_last("homer_count"), "lemma_id")))
    ids = terms.ranked(m.select("lemma_group").distinct(), F.col("lemma_group")).withColumnRenamed("rank", "cluster")
    return sinks.cluster_listing(m.join(ids, "lemma_group").select("cluster", F.col("greek_lemma").alias("lemma"), F.coalesce("homer_count", F.lit(0)).alias("freq"), F.col("lsj_glosses").alias("gloss"), "rank"))


@query()
def annotation_xml(spark: SparkSession, d: str) -> DataFrame:
    return sinks.annotation_xml(one_per_id(table(spark, d, "odyssey_7_189_framenet"), "sentence_id"), "odyssey")


@query(f"SELECT greek_lemma AS lemma, homer_count AS freq FROM {_LEM} WHERE lsj_glosses IS NULL OR lsj_glosses = ''")
def unglossed_lemmas(spark: SparkSession, d: str) -> DataFrame:
    return sinks.unglossed(lemmas(spark, d).select(F.col("greek_lemma").alias("lemma"), F.col("homer_count").alias("freq"), F.col("lsj_glosses").alias("gloss")))
