"""Predicate-argument extraction from dependency trees by bounded iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import base_relation, is_content_word, is_filler, voice_name
from lexforge.operators.terms import term_counts
from lexforge.operators.vectors import centroids
from lexforge.session import cut

KEY = ["work", "sentence_id"]


def children(tokens: DataFrame) -> DataFrame:
    """work, sentence_id, head, word_id of every edge with a head in the sentence's words (J12); null heads have none."""
    t = tokens.select(*KEY, F.col("word_id").alias("head"))
    return tokens.select(*KEY, "head", "word_id").filter("head IS NOT NULL").join(t, [*KEY, "head"], "left_semi")


def argument_edges(tokens: DataFrame, verbs: DataFrame | None = None) -> DataFrame:
    """work, sentence_id, verb_id, path, slot, prep, case, filler: the arguments and obliques of every verb.

    From a verb down: a child that is SBJ, OBJ or PNOM gives its lemma if it is a content filler; COORD and APOS are
    looked through, and so is a child whose relation carries _CO or _AP. AuxP gives the preposition with its first
    content filler; ADV gives a bare oblique. The rest is no argument and isn't entered. path holds the word ids from
    the verb down, which orders the result as a depth-first walk. A node is entered once per verb: a cycle ends where
    it would meet its own path.

    One join per level of looking through, repeated until no row is left to enter; each level is written to the
    shared folder. Levels are few, as only coordination and apposition are entered.
    """
    rel = base_relation(F.col("relation"))
    nodes = tokens.select(*KEY, "word_id", "head", "lemma", "case", rel.alias("base"), (F.coalesce("relation", F.lit("")) != rel).alias("marked"), is_filler(F.col("pos"), F.col("lemma")).alias("filler"))
    kids = cut(nodes.filter("head IS NOT NULL"), "kids")
    first = kids.filter("filler").groupBy(*KEY, F.col("head").alias("word_id")).agg(F.min_by(F.struct("case", "lemma"), "word_id").alias("of"))
    kids = cut(kids.join(first, [*KEY, "word_id"], "left"), "kids")
    at = tokens.filter((F.col("pos") == "v") & is_content_word(F.col("lemma"))) if verbs is None else verbs
    front = at.select(*KEY, F.col("word_id").alias("verb_id"), F.col("word_id").alias("head"), F.array("word_id").alias("path"))
    steps = []
    while True:
        step = cut(front.join(kids, [*KEY, "head"]).filter(~F.array_contains("path", F.col("word_id"))).withColumn("path", F.concat("path", F.array("word_id"))), "level")
        steps.append(step)
        front = step.filter(F.col("base").isin("COORD", "APOS") | (F.col("base").isin("SBJ", "OBJ", "PNOM") & F.col("marked"))).select(*KEY, "verb_id", F.col("word_id").alias("head"), "path")
        if front.isEmpty():
            break
    every = steps[0]
    for s in steps[1:]:
        every = every.union(s)
    slot = F.when(F.col("base").isin("SBJ", "OBJ", "PNOM") & F.col("filler"), F.lower("base")).when((F.col("base") == "AuxP") & F.col("of").isNotNull(), "oblique").when((F.col("base") == "ADV") & F.col("filler"), "oblique")
    prep = F.when(F.col("base") == "AuxP", F.col("lemma"))
    return every.withColumn("slot", slot).filter("slot IS NOT NULL").select(*KEY, "verb_id", "path", "slot", F.when(F.col("slot") == "oblique", prep).alias("prep"), F.when(F.col("slot") == "oblique", F.coalesce("of.case", "case")).alias("case"), F.when(F.col("base") == "AuxP", F.col("of.lemma")).otherwise(F.col("lemma")).alias("filler"))


def predicate_arguments(tokens: DataFrame) -> DataFrame:
    """One row per verb occurrence with its arrays of arguments and obliques, and n_args (G1)."""
    edges = argument_edges(tokens)
    ordered = lambda s, x: F.transform(F.array_sort(F.collect_list(F.when(F.col("slot") == s, F.struct("path", x.alias("x"))))), lambda r: r["x"])
    oblique = F.struct("prep", "case", F.col("filler").alias("lemma"))
    slots = edges.groupBy(*KEY, "verb_id").agg(*[ordered(s, F.col("filler")).alias(s) for s in ("sbj", "obj", "pnom")], ordered("oblique", oblique).alias("obliques"))
    verbs = tokens.filter((F.col("pos") == "v") & is_content_word(F.col("lemma"))).select("work", "book", "line", "sentence_id", F.col("word_id").alias("verb_id"), F.col("lemma").alias("verb_lemma"), voice_name(F.col("voice")).alias("voice"), F.coalesce("mood", F.lit("")).alias("mood"), F.coalesce("tense", F.lit("")).alias("tense"))
    out = verbs.join(slots, [*KEY, "verb_id"], "left")
    for s in ("sbj", "obj", "pnom"):
        out = out.withColumn(s, F.coalesce(s, F.array().cast("array<string>")))
    out = out.withColumn("obliques", F.coalesce("obliques", F.array().cast("array<struct<prep:string,case:string,lemma:string>>")))
    return out.withColumn("n_args", F.size("sbj") + F.size("obj") + F.size("pnom") + F.size("obliques"))


def slot_fillers(arguments: DataFrame, slots: tuple[str, ...] = ("sbj", "obj")) -> DataFrame:
    """verb_lemma, slot, term, n (A2)."""
    parts = [term_counts(arguments, s, ["verb_lemma"]).select("verb_lemma", F.lit(s).alias("slot"), "term", "n") for s in slots]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def frame_fillers(fillers: DataFrame, frames: DataFrame, stops: DataFrame) -> DataFrame:
    """frame, slot, term, n: fillers summed over the frame's verbs, without stop words and noise (A3). frames: verb_lemma, frame."""
    kept = fillers.join(stops.select("term").distinct(), "term", "left_anti")
    return kept.join(frames.filter("frame <> -1"), "verb_lemma").groupBy("frame", "slot", "term").agg(F.sum("n").alias("n"))


def verb_vectors(fillers: DataFrame, words: DataFrame, dims: int) -> DataFrame:
    """verb_lemma, vector: unit mean vector of the subjects and of the objects side by side, zeros for a missing one (E5).

    words: term, vector. Verbs without any known filler have no row.
    """
    from lexforge.functions.vectors import unit

    means = centroids(fillers.join(words, "term"), ["verb_lemma", "slot"], "vector", dims, weight="n")
    zero = F.array_repeat(F.lit(0.0), dims)
    both = means.groupBy("verb_lemma").agg(*[F.max(F.when(F.col("slot") == s, F.col("centroid"))).alias(s) for s in ("sbj", "obj")])
    return both.select("verb_lemma", unit(F.concat(F.coalesce("sbj", zero), F.coalesce("obj", zero))).alias("vector"))
