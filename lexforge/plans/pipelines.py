"""The corpus pipelines from end to end, composed of the operators; every result is a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions import text as tx
from lexforge.operators import cluster, compare, lexicon, metrics, spans, terms, tree, validate, vectors
from lexforge.session import cut


@dataclass
class Fields:
    glosses: DataFrame  # lemma, n, gloss, source
    labels: DataFrame  # lemma, label, ward_<k>
    names: DataFrame  # label, name
    listing: DataFrame  # cluster, size, body
    report: DataFrame  # one row of metrics


def emergent_fields(counts: DataFrame, entries: DataFrame, stops: DataFrame, cache: DataFrame | None = None, vectors_of: DataFrame | None = None, least: int = 5, dims: int = 64, cuts: tuple[int, ...] = (12, 25, 50)) -> Fields:
    """From lemma frequencies (term, n) and dictionary glosses (seq, headword, gloss) to named semantic fields.

    vectors_of (lemma, vector) are the encoder's; without it glosses are hashed. The density and linkage steps work
    on types (thousands), not tokens, and refuse more than their limit.
    """
    from lexforge.sources import sinks

    vocabulary = terms.vocabulary(counts, stops, least).select(F.col("term").alias("lemma"), "n")
    glossed = cut(vocabulary.join(lexicon.lemma_gloss(vocabulary, entries, cache), "lemma"), "glosses")
    have = glossed.filter("gloss <> ''")
    vec = vectors_of if vectors_of is not None else vectors.hashed_embedding(have, "lemma", "gloss", dims)
    vec = cut(have.select("lemma").join(vec, "lemma"), "vectors")
    labels = cluster.density_clusters(vec, "lemma", "vector", 8, 3, "cosine")
    wide = cluster.linkage_cuts(vec, "lemma", "vector", cuts, "ward").groupBy("lemma").pivot("k", list(cuts)).agg(F.first("label"))
    wide = wide.select("lemma", *[F.col(str(k)).alias(f"ward_{k}") for k in cuts])
    both = cut(labels.join(wide, "lemma"), "labels")
    rows = both.join(have, "lemma").join(vec, "lemma")
    names = terms.name_clusters(terms.class_tfidf(rows, "label", "gloss"), "label")
    ranked = vectors.rank_by_centroid(rows, "label", "lemma", "vector", dims).join(have, "lemma")
    listing = sinks.cluster_listing(ranked.select(F.col("label").alias("cluster"), "lemma", F.col("n").alias("freq"), "gloss", "rank"), names.withColumnRenamed("label", "cluster"))
    report = metrics.coverage(rows, "label", "n").join(metrics.silhouette(rows, "label", "vector", dims).select("silhouette"))  # one row each
    return Fields(glossed, both, names, listing, report)


@dataclass
class Frames:
    arguments: DataFrame
    fillers: DataFrame  # verb_lemma, slot, term, n
    labels: DataFrame  # verb_lemma, frame
    preferences: DataFrame  # frame, slot, term, n
    listing: DataFrame


def frame_induction(tokens: DataFrame, word_vectors: DataFrame, stops: DataFrame, dims: int, least: int = 5) -> Frames:
    """From a token table to verb frames: arguments, filler profiles, clusters of profile vectors, preferences per frame."""
    from lexforge.sources import sinks

    arguments = cut(tree.predicate_arguments(tokens), "arguments")
    fillers = cut(tree.slot_fillers(arguments), "fillers")
    verbs = terms.vocabulary(arguments.groupBy(F.col("verb_lemma").alias("term")).agg(F.count("*").alias("n")), stops, least)
    vec = cut(tree.verb_vectors(fillers, word_vectors, dims).join(verbs.select(F.col("term").alias("verb_lemma")), "verb_lemma", "left_semi"), "profiles")
    labels = cluster.density_clusters(vec, "verb_lemma", "vector", 5, 3, "cosine").withColumnRenamed("label", "frame")
    preferences = tree.frame_fillers(fillers, labels, stops)
    listing = sinks.frame_listing(labels.filter("frame <> -1").select("frame", F.col("verb_lemma").alias("verb")), preferences)
    return Frames(arguments, fillers, labels, preferences, listing)


def type_scenes(tokens: DataFrame, topics: int = 20, size: int = 30) -> tuple[DataFrame, DataFrame]:
    """(topic, line) and (work, book, topic, share): topics of windows of verse and their share per book."""
    from lexforge.sources import sinks

    kept = tokens.filter(F.col("pos").isin(*tx.CONTENT_POS) & tx.is_content_word(F.col("lemma"))).withColumn("lemma", F.lower("lemma"))
    w = cut(terms.windows(kept, ["work", "book"], "line", "lemma", size).withColumn("doc", F.concat_ws("|", "work", "book", "window")), "windows")
    by_doc, by_term = terms.nmf_topics(terms.tfidf(w, "doc", "terms", 3), "doc", topics)
    share = terms.prevalence(by_doc.join(w.select("doc", "work", "book"), "doc"), ["work", "book"], "topic", "weight")
    return sinks.topic_listing(by_term), share


def lexicon_mapping(wanted: DataFrame, index: DataFrame, synsets: DataFrame, flags: DataFrame, dictionary: DataFrame) -> DataFrame:
    """From wanted forms to flagged and resolved synsets, core first. A flag for a synset not extracted is an error."""
    links = cut(lexicon.attach_synsets(lexicon.form_links(wanted, index), synsets), "links")
    stray = flags.select("lemma", "synset_id").join(links, ["lemma", "synset_id"], "left_anti")
    validate.require_empty(stray, "flags for synsets not in the extraction")
    flagged = lexicon.flag_synsets(links, flags)
    asked = flagged.select(F.concat_ws("|", "lemma", "synset_id").alias("id"), "pos", F.split("english_words", " ").alias("words"), "gloss")
    found = lexicon.resolve_synsets(asked, dictionary).select("id", "synset", "id_match")
    return flagged.withColumn("id", F.concat_ws("|", "lemma", "synset_id")).join(found, "id").drop("id").orderBy("lemma", lexicon.flag_order(), "synset_id")


def run_comparison(a: DataFrame, b: DataFrame, equivalents: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per lemma, one row of agreement) of two runs' frame assignments."""
    rows = compare.compare_runs(a, b, equivalents)
    total = rows.agg(F.count("*").alias("lemmas"), F.count_if("same_primary").alias("same_primary"), F.avg("overlap").alias("mean_overlap"))
    return rows, total


def candidate_passages(tokens: DataFrame, experiment: DataFrame, top: int = 15) -> DataFrame:
    """The passages with most of the experiment's lemmas; both sides compared without accents and numbers."""
    wanted = experiment.select(tx.bare(F.col("lemma")).alias("lemma")).distinct()
    return spans.rank_passages(tokens.withColumn("_k", tx.bare(F.col("lemma"))), "passage_id", "_k", wanted.withColumn("_by", F.lit(1)), "_by", top).drop("_by")
