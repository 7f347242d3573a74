from __future__ import annotations

import pytest
from conftest import DATA, needs_data
from pyspark.sql import functions as F

from lexforge.operators.records import one_per_id
from lexforge.operators.vectors import hashed_embedding
from lexforge.plans import pipelines, reference
from lexforge.session import table
from lexforge.streaming.windows import read_events, windowed_counts


@needs_data
def test_fields(spark):
    lem = one_per_id(table(spark, DATA, "lemmas"), "lemma_id").filter("lsj_glosses <> ''")
    counts = lem.select(F.col("greek_lemma").alias("term"), F.coalesce("homer_count", F.lit(1)).alias("n"))
    entries = lem.select(F.col("lemma_id").alias("seq"), F.regexp_replace("greek_lemma", r"\d+$", "").alias("headword"), F.col("lsj_glosses").alias("gloss"))
    stops = spark.createDataFrame([("ὁ",)], "term string")
    f = pipelines.emergent_fields(counts, entries, stops, least=1, cuts=(5, 10))
    assert f.glosses.filter("gloss = ''").count() == 0
    assert f.labels.columns == ["lemma", "label", "ward_5", "ward_10"]
    assert f.labels.select("ward_10").distinct().count() == 10
    r = f.report.first()
    assert 0 <= r["noise_share"] <= 1
    assert f.listing.count() == f.names.count()


@needs_data
def test_frames_and_scenes(spark):
    t = reference._forest(spark, DATA)
    words = hashed_embedding(t.filter("lemma <> ''").select(F.col("lemma").alias("term")).distinct(), "term", "term", 16)
    stops = spark.createDataFrame([("ὁ",)], "term string")
    f = pipelines.frame_induction(t, words, stops, 16, least=1)
    assert f.arguments.filter("n_args > 0").count() > 0
    assert f.labels.count() > 0
    scenes, share = pipelines.type_scenes(t.withColumn("line", F.col("sentence_id").cast("int")), 4)
    assert scenes.count() == 4
    assert share.groupBy("work", "book").agg(F.round(F.sum("share"), 6).alias("s")).filter("s <> 1").count() == 0


def test_mapping(spark):
    wanted = spark.createDataFrame([("A", "a", 0)], "lemma string, form string, form_order int")
    index = spark.createDataFrame([("a", "n", 0, "n#1", 0), ("a", "n", 0, "n#2", 1)], "form string, pos string, pos_order int, synset_id string, id_order int")
    syn = spark.createDataFrame([("n#1", "gift", "a thing given")], "synset_id string, words string, gloss string")
    flags = spark.createDataFrame([("A", "n#2", "core", "")], "lemma string, synset_id string, sense_flag string, reason string")
    d = spark.createDataFrame([("gift.n.01", "n", ["gift"], "a thing given")], "synset string, pos string, lemmas array<string>, definition string")
    got = [(r["synset_id"], r["sense_flag"], r["synset"], r["id_match"]) for r in pipelines.lexicon_mapping(wanted, index, syn, flags, d).collect()]
    assert got == [("n#2", "core", None, "unresolved"), ("n#1", "noise", "gift.n.01", "exact_gloss")]
    with pytest.raises(ValueError, match="flags for synsets"):
        pipelines.lexicon_mapping(wanted, index, syn, flags.withColumn("synset_id", F.lit("n#9")), d)


@needs_data
def test_comparison_and_passages(spark):
    a = reference.assignments(spark, DATA)
    rows, total = pipelines.run_comparison(a, a)
    t = total.first()
    assert t["lemmas"] == t["same_primary"] == rows.count()
    assert t["mean_overlap"] == 1.0
    assert pipelines.candidate_passages(reference.tokens(spark, DATA), table(spark, DATA, "experiment")).count() > 0


@needs_data
def test_stream_equals_batch(spark, tmp_path):
    e = table(spark, DATA, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    q = windowed_counts(read_events(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        got = {tuple(r) for r in spark.sql("SELECT window_start, event_type, n FROM windows").collect()}
    finally:
        q.stop()
    assert got == {tuple(r) for r in windowed_counts(e).select("window_start", "event_type", "n").collect()}
