"""Queries of the problems on training data; oracle SQL where it can express the operator."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm import clusters, distinctive, ngrams, oracles, packing, subjects, tokens, unify
from lexforge.operators.records import one_per_id
from lexforge.session import cut, table


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


# --- 1: visually identical text


def _tokens(spark: SparkSession, d: str, *fields: str) -> DataFrame:
    """record_id, token_pos and the named fields of every token, one passage per id."""
    rows = one_per_id(table(spark, d, "passages"), "passage_id", *[F.col(f"tokens.{f}").alias(f) for f in fields])
    return rows.select(F.col("passage_id").alias("record_id"), F.posexplode(F.arrays_zip(*fields)).alias("_p", "t")).select("record_id", (F.col("_p") + 1).alias("token_pos"), *[F.col(f"t.{f}").alias(f) for f in fields])


def _values(spark: SparkSession, d: str) -> DataFrame:
    """field, record_id, token_pos, value of the three fields of problem 1."""
    t = _tokens(spark, d, "lemma", "form")
    both = t.select("record_id", "token_pos", F.explode(F.array(*[F.struct(F.lit(f"passages.tokens.{f}").alias("field"), F.col(f).alias("value")) for f in ("lemma", "form")])).alias("x"))
    frames = one_per_id(table(spark, d, "lemma_frames"), "row_id", "greek_lemma")
    return both.select("x.field", "record_id", "token_pos", "x.value").union(frames.select(F.lit("lemma_frames.greek_lemma"), "row_id", F.lit(0), "greek_lemma")).filter("value IS NOT NULL")


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """word: the words of the three fields, of lemmas.greek_lemma and of the passages' text."""
    passages = table(spark, d, "passages")
    kept = [passages.select(F.explode(unify.words_of(F.col("text"))).alias("word"))]
    kept += [passages.select(F.explode(F.col(f"tokens.{f}")).alias("word")) for f in ("lemma", "form")]
    kept += [table(spark, d, t).select(F.col("greek_lemma").alias("word")) for t in ("lemmas", "lemma_frames")]
    return _union(kept)


def _forms(spark: SparkSession, d: str, values: DataFrame) -> DataFrame:
    return cut(unify.consistent_forms(values.select("value"), _vocabulary(spark, d)), "forms")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The values that differ from their consistent form, or mix scripts in a way the vocabulary doesn't settle."""
    dirty = cut(_values(spark, d).filter(~unify.is_clean(F.col("value"))), "dirty")  # few, and read twice
    forms = _forms(spark, d, dirty).filter("form <> value OR open").select("value")
    return dirty.join(forms, "value", "left_semi").select("field", "record_id", F.col("token_pos").cast("int").alias("token_pos"))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every value of the three fields with its consistent form; open: scripts are mixed and no reading is a known word.

    Values that are clean already pass as they are; only the others are shuffled to meet their form.
    """
    values = _values(spark, d)
    forms = _forms(spark, d, values)
    clean = unify.is_clean(F.col("value"))
    same = values.filter(clean).select("field", "record_id", "token_pos", "value", F.col("value").alias("form"), F.lit(False).alias("open"))
    return same.union(values.filter(~clean).join(forms, "value").select("field", "record_id", "token_pos", "value", "form", "open"))


def p1_frame_lemmas(spark: SparkSession, d: str) -> DataFrame:
    """row_id, lemma_id: lemma_frames met with lemmas by the consistent form of greek_lemma (null where none is)."""
    frames = one_per_id(table(spark, d, "lemma_frames"), "row_id", F.col("greek_lemma").alias("value"))
    forms = _forms(spark, d, frames)
    lemmas = one_per_id(table(spark, d, "lemmas"), "lemma_id", "greek_lemma")
    return frames.join(forms, "value", "left").withColumn("greek_lemma", F.coalesce("form", "value")).join(lemmas, "greek_lemma", "left").select("row_id", "greek_lemma", "lemma_id")


# --- 3: distinctive terms


def _gloss_records(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    of = {"lemmas": ("lemma_id", "lsj_glosses"), "lemma_frames": ("row_id", "gloss")}
    return {t: one_per_id(table(spark, d, t), i, F.col(c).alias("_g")).select(F.col(i).cast("bigint").alias("record_id"), distinctive.letter_runs(F.col("_g")).alias("terms")) for t, (i, c) in of.items()}


def p3_weights(spark: SparkSession, d: str) -> DataFrame:
    rows = _union([distinctive.log_entropy(r).select(F.lit(t).alias("record_table"), "*") for t, r in _gloss_records(spark, d).items()])
    return rows.withColumns({c: F.round(c, 6) for c in ("entropy_weight", "score")})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _union([distinctive.standing_out(r).select(F.lit(t).alias("record_table"), "record_id", "term") for t, r in _gloss_records(spark, d).items()])


# --- 4: clusters

BOOK_TOPICS = 20


def _gloss_sets(spark: SparkSession, d: str) -> DataFrame:
    """record_id, content (sorted distinct terms) of the lemmas whose gloss has a term."""
    r = _gloss_records(spark, d)["lemmas"]
    return r.select("record_id", F.array_sort(F.array_distinct("terms")).alias("content")).filter(F.size("content") > 0)


def _topic_vectors(spark: SparkSession, d: str) -> DataFrame:
    """record_id, content (weights scaled to sum to one) of the books without null, of a sum over 0."""
    cols = [f"topic_{i}" for i in range(BOOK_TOPICS)]
    r = one_per_id(table(spark, d, "topic_prevalence_by_book"), "book_id", *cols)
    total = reduce(lambda a, b: a + b, [F.col(c) for c in cols])
    return r.withColumn("_s", total).filter("_s > 0").select(F.col("book_id").cast("bigint").alias("record_id"), F.array(*[F.col(c) / F.col("_s") for c in cols]).alias("content"))


def _clustered(spark: SparkSession, d: str) -> dict[str, tuple[DataFrame, DataFrame, DataFrame, DataFrame]]:
    """By table: records, classes, links, clusters."""
    out = {}
    for t, records, link in (("lemmas", _gloss_sets(spark, d), clusters.set_links), ("topic_prevalence_by_book", _topic_vectors(spark, d), clusters.vector_links)):
        classes = cut(clusters.copy_classes(records), "classes")
        links = cut(link(classes), "pairs")
        out[t] = records, classes, links, clusters.pivot_clusters(classes, links)
    return out


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """record_table, id_a, id_b, apart: all pairs of similar records; apart: linked, but the pivots put them into different clusters."""
    return _union([clusters.linked_pairs(r, c, clusters.split_by_pivots(l, g)).select(F.lit(t).alias("record_table"), "id_a", "id_b", "apart") for t, (r, c, l, g) in _clustered(spark, d).items()])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The pairs inside the clusters and those of linked records that the pivots put apart."""
    return p4_pairs(spark, d).select("record_table", "id_a", "id_b")


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    """One row per record with its cluster (named by the medoid), the cluster's size and the record's closeness to it."""
    out = []
    for t, (r, c, l, g) in _clustered(spark, d).items():
        m = cut(clusters.medoids(c, g, l), "medoids")
        heads = clusters.typical_members(m, 1).select("pivot", F.col("class_id").alias("cluster_id"))
        rows = r.join(c.select("content", "class_id"), "content").select("record_id", "class_id").join(m, "class_id").join(heads, "pivot")
        out.append(rows.select(F.lit(t).alias("record_table"), "record_id", "cluster_id", "size", "closeness"))
    return _union(out)


def p4_clusters(spark: SparkSession, d: str, typical: int = 5) -> DataFrame:
    """One row per cluster of two records or more: size, number of different contents, the ids of its most typical members."""
    out = []
    for t, (_, c, l, g) in _clustered(spark, d).items():
        m = cut(clusters.medoids(c, g, l).filter("size > 1"), "medoids")
        top = clusters.typical_members(m, typical).groupBy("pivot").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "class_id"))), lambda x: x["class_id"]).alias("typical"))
        rows = m.groupBy("pivot").agg(F.first("size").alias("size"), F.count("*").alias("contents")).join(top, "pivot")
        out.append(rows.select(F.lit(t).alias("record_table"), F.col("typical")[0].alias("cluster_id"), "size", "contents", "typical"))
    return _union(out)


# --- 5: frequencies

MAX_N = 3


def _sequences(spark: SparkSession, d: str) -> DataFrame:
    """field, record_id, terms: the lemmas of a passage in the form of problem 1; the homer_count of a lemma as text."""
    rows = one_per_id(table(spark, d, "passages"), "passage_id", F.col("tokens.lemma").alias("lemma"))
    # the forms of all values, of rows sent again too, so that only the sequences themselves have one row per id
    every = table(spark, d, "passages").select("passage_id", F.explode(F.array_distinct(F.filter("tokens.lemma", lambda x: x.isNotNull() & ~unify.is_clean(x)))).alias("value"))
    dirty = cut(every.filter("passage_id IS NOT NULL").distinct(), "dirty")
    # only passages with a lemma in another form get a map; the rest pass as they are
    forms = dirty.join(_forms(spark, d, dirty), "value").groupBy("passage_id").agg(F.map_from_entries(F.collect_list(F.struct("value", "form"))).alias("to"))
    form = lambda x: F.nullif(F.coalesce(F.try_element_at(F.col("to"), x), x), F.lit(""))
    passages = rows.join(forms, "passage_id", "left").select(F.lit("passages.tokens.lemma").alias("field"), F.col("passage_id").alias("record_id"), F.transform("lemma", form).alias("terms"))
    counts = one_per_id(table(spark, d, "lemmas"), "lemma_id", "homer_count")
    return passages.union(counts.select(F.lit("lemmas.homer_count"), "lemma_id", F.array(F.col("homer_count").cast("string"))))


def p5_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """field, ngram, n, records of every n-gram of up to MAX_N lemmas of a passage and of every homer_count."""
    return ngrams.suffix_counts(_sequences(spark, d), MAX_N)


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, records and mark: rare in one record only, common over the field's share of all records."""
    one = ngrams.suffix_counts(_sequences(spark, d), MAX_N).filter(F.size("ngram") == 1).select("field", F.col("ngram")[0].alias("term"), "n", "records")
    sizes = _union([table(spark, d, t).agg(F.countDistinct(i).alias("total")).select(F.lit(f).alias("field"), "total", F.lit(s).alias("share")) for t, i, f, s in (("passages", "passage_id", "passages.tokens.lemma", 0.5), ("lemmas", "lemma_id", "lemmas.homer_count", 0.1))])
    # sizes has two rows
    mark = F.when(F.col("records") == 1, "rare").when(F.col("records") > F.col("share") * F.col("total"), "common")
    return one.join(F.broadcast(sizes), "field").select("field", "term", "n", "records", mark.alias("mark"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_terms(spark, d).filter("mark IS NOT NULL").select("field", "term", "mark")


# --- 7 and 8: token ids and packs


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, ids: every document by byte_bpe_50k without special tokens; [] for null and empty texts."""
    return table(spark, d, "documents").select("doc_id", tokens.token_ids(F.col("text")).alias("ids"))


def p7_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tokens.token_count(F.col("text")).alias("n_tokens"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = cut(p7_lengths(spark, d).select(F.col("doc_id").alias("item_id"), F.col("n_tokens").alias("size")), "sizes")
    return packing.pack_items(sizes, table(spark, d, "pack_sizes"))


def p8_packs(spark: SparkSession, d: str) -> DataFrame:
    """Every document with text in a pack of each capacity; part and start tell the pieces of one too long for any pack."""
    return _packed(spark, d).withColumnRenamed("item_id", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(_packed(spark, d), table(spark, d, "pack_sizes"))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """By kind of pack: documents in packs, packs over capacity, documents of which tokens are missing or double, and documents split though they fit."""
    packed = cut(_packed(spark, d), "packed")
    kinds = table(spark, d, "pack_sizes").select("pack_name", F.col("capacity").cast("bigint").alias("capacity"))
    over = packed.groupBy("pack_name", "pack_id").agg(F.sum("size").alias("s")).join(F.broadcast(kinds), "pack_name").groupBy("pack_name").agg(F.count_if(F.col("s") > F.col("capacity")).alias("overfull"))
    by_doc = packed.groupBy("pack_name", "item_id").agg(F.sum("size").alias("s"), F.count("*").alias("parts")).join(F.broadcast(kinds), "pack_name")
    sizes = p7_lengths(spark, d).select(F.col("doc_id").alias("item_id"), "n_tokens")
    whole = by_doc.join(sizes, "item_id").groupBy("pack_name", "capacity").agg(F.count("*").alias("documents"), F.count_if(F.col("s") != F.col("n_tokens")).alias("incomplete"), F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("split"))
    return whole.join(over, "pack_name")


# --- 9: subject areas


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, subject: the subjects that a main share of the text's sentences is about."""
    documents = table(spark, d, "documents")
    model = subjects.train(documents, table(spark, d, "doc_labels"))
    return subjects.subject_shares(documents, model).filter("about").select("doc_id", "subject")


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    """subject, given, agreed, labelled on the labelled texts held out from fitting and from thresholds."""
    documents, labels = table(spark, d, "documents"), table(spark, d, "doc_labels")
    texts = subjects.labelled_texts(documents, labels)
    return subjects.quality(texts, subjects.train(documents, labels, texts=texts))


def p9_lifts(spark: SparkSession, d: str) -> DataFrame:
    """What each step of the address paths and each section tells about each subject."""
    found = subjects.lifts(subjects.labelled_texts(table(spark, d, "documents"), table(spark, d, "doc_labels")))
    return found.select("field", "value", "subject", "n", *[F.round(c, 5).alias(c) for c in ("lift", "precision", "z")])


def p9_path_rules(spark: SparkSession, d: str) -> DataFrame:
    """The steps of address paths and the sections that serve as weak labels; none where they tell nothing."""
    return subjects.path_rules(subjects.labelled_texts(table(spark, d, "documents"), table(spark, d, "doc_labels")))


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """subject, documents, share of all documents with text: the make-up of the corpus by subject."""
    documents = table(spark, d, "documents")
    n = documents.filter(F.length(F.trim("text")) > 0).agg(F.count("*")).scalar()
    return p9_found(spark, d).groupBy("subject").agg(F.count("*").alias("documents")).withColumn("share", F.col("documents") / n)


QUERIES = {f.__name__: f for f in (p1_found, p1_forms, p1_frame_lemmas, p3_found, p3_weights, p4_found, p4_pairs, p4_members, p4_clusters, p5_found, p5_ngrams, p5_terms, p7_ids, p7_lengths, p8_packs, p8_fill, p8_checks, p9_found, p9_quality, p9_lifts, p9_path_rules, p9_composition)}
_G = {"lemmas": "SELECT DISTINCT ON (lemma_id) lemma_id AS id, lsj_glosses AS g FROM lemmas", "lemma_frames": "SELECT DISTINCT ON (row_id) row_id AS id, gloss AS g FROM lemma_frames"}


def _weights_sql(t: str) -> str:
    tf = f"SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(regexp_extract_all(lower(g), '\\p{{L}}+')) AS term FROM ({_G[t]})) GROUP BY 1, 2"
    st = f"SELECT term, count(*) AS df, sum(tf) AS gf, sum(tf * ln(tf)) AS s FROM ({tf}) GROUP BY 1"
    return f"SELECT '{t}' AS record_table, id AS record_id, a.term, tf, df, CAST(gf AS BIGINT) AS gf, 1 + (s / gf - ln(gf)) / ln((SELECT count(*) FROM ({_G[t]}))) AS w FROM ({tf}) a JOIN ({st}) b ON a.term = b.term"


_SETS = f"(SELECT id, list_distinct(regexp_extract_all(lower(g), '\\p{{L}}+')) AS t FROM ({_G['lemmas']}) WHERE g IS NOT NULL)"
_BOOKS = "(SELECT book_id, [" + ", ".join(f"topic_{i} / (" + " + ".join(f"topic_{k}" for k in range(BOOK_TOPICS)) + ")" for i in range(BOOK_TOPICS)) + "] AS v FROM (SELECT DISTINCT ON (book_id) * FROM topic_prevalence_by_book) WHERE " + " AND ".join(f"topic_{i} IS NOT NULL" for i in range(BOOK_TOPICS)) + ")"

ORACLE: dict[str, str] = oracles.ORACLE | {
    "p8_checks": "SELECT pack_name, CAST(capacity AS BIGINT) AS capacity, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0 AS overfull, 0 AS incomplete, 0 AS split FROM pack_sizes",
    "p9_lifts": "WITH a AS (SELECT doc_id, list(subject) AS s FROM doc_labels WHERE doc_id IS NOT NULL GROUP BY 1), t AS (SELECT d.doc_id, source, kind, list_distinct(s) AS s FROM documents d JOIN a ON d.doc_id = a.doc_id WHERE trim(text, ' ') <> ''), m AS (SELECT doc_id, s, 'kind' AS field, kind AS value FROM t WHERE kind IS NOT NULL UNION ALL SELECT doc_id, s, 'source', unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/'))) FROM (SELECT doc_id, s, string_split_regex(source, '[/_.:-]') AS p FROM t WHERE source IS NOT NULL)), v AS (SELECT field, value, count(*) AS n_v FROM m GROUP BY 1, 2), x AS (SELECT subject, count(*) / (SELECT count(*) FROM t) AS p FROM (SELECT unnest(s) AS subject FROM t) WHERE subject IS NOT NULL GROUP BY 1), b AS (SELECT field, value, subject, count(*) AS n FROM (SELECT field, value, unnest(s) AS subject FROM m) WHERE subject IS NOT NULL GROUP BY 1, 2, 3) SELECT b.field, b.value, b.subject, n, round(n / n_v / p, 5) AS lift, round(n / n_v, 5) AS precision, round((n - n_v * p) / sqrt(n_v * p * (1 - p) + 1e-9), 5) AS z FROM b JOIN v ON b.field = v.field AND b.value = v.value JOIN x ON b.subject = x.subject",
    "p3_weights": " UNION ALL ".join(f"SELECT record_table, record_id, term, tf, df, gf, round(w, 6) AS entropy_weight, round(ln(1 + tf) * w, 6) AS score FROM ({_weights_sql(t)})" for t in _G),
    "p3_found": " UNION ALL ".join(f"SELECT record_table, record_id, term FROM ({_weights_sql(t)}) WHERE tf >= 2 AND df BETWEEN 2 AND 8" for t in _G),
    "p4_found": f"SELECT 'lemmas' AS record_table, a.id AS id_a, b.id AS id_b FROM {_SETS} a JOIN {_SETS} b ON a.id < b.id WHERE len(list_intersect(a.t, b.t)) * 5 >= 3 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) AND len(a.t) > 0 AND len(b.t) > 0 UNION ALL SELECT 'topic_prevalence_by_book', a.book_id, b.book_id FROM {_BOOKS} a JOIN {_BOOKS} b ON a.book_id < b.book_id WHERE list_max(list_transform(range(1, {BOOK_TOPICS + 1}), lambda i: abs(a.v[i] - b.v[i]))) <= 0.01",
}
