"""Queries of the general problems: nested records (2) and packed fields (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.operators.nested import label_nodes, link_by_interval, linked_nodes, node_table
from lexforge.operators.packed import explode_packed
from lexforge.operators.records import one_per_id
from lexforge.session import table

# The keys under which tools deliver the same container, and the containers that may be JSON text.
RENAME = {"annotation_sets": "annotationSets"}
CONTAINERS = ("annotationSets", "FEs", "target", "sentences")
PACKED_FIELDS = (
    ("lemmas", "lemma_id", "cluster_forms"),
    ("experiment", "entry_id", "agwn_forms"),
    ("cluster128_field_framenet_full", "row_id", "frame_core_FEs"),
    ("lemma_frames", "row_id", "A_frames"),
)


def _docs(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    return one_per_id(df, id_col, *cols).select(F.col(id_col).alias("doc_id"), F.to_json(F.struct(F.col(id_col).alias("id"), *cols)).alias("payload"))


def _typed_sentences(spark: SparkSession, d: str) -> DataFrame:
    return _docs(table(spark, d, "odyssey_7_189_framenet"), "sentence_id", "source", "text", "translation", "annotationSets")


def _raw_sentences(spark: SparkSession, d: str) -> DataFrame:
    return one_per_id(table(spark, d, "raw_annotations"), "raw_id", "payload").select(F.col("raw_id").alias("doc_id"), "payload")


def sentence_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of odyssey_7_189_framenet and raw_annotations; a payload's sentences are the roots of its forest."""
    typed = label_nodes(_typed_sentences(spark, d), "odyssey_7_189_framenet", "sentence")
    return typed.union(label_nodes(_raw_sentences(spark, d), "raw_annotations", "sentence", containers=CONTAINERS, rename=RENAME, unwrap="sentences"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per non-null FEs.name, target.start and lexical_units.lemma, with its record, set and place.

    Sentences whose id is no integer, and items outside any sentence or set, have no rows.
    """
    parts, in_set = {"FEs": ("name",), "target": ("start",)}, {"record_id": ("sentence", "id"), "set_pos": ("annotationSets", None)}
    typed = linked_nodes(_docs(table(spark, d, "odyssey_7_189_framenet"), "sentence_id", "annotationSets"), "odyssey_7_189_framenet", "sentence", parts, in_set)
    raw = linked_nodes(_raw_sentences(spark, d), "raw_annotations", "sentence", parts, in_set, containers=CONTAINERS, rename=RENAME, unwrap="sentences")
    units = linked_nodes(_docs(table(spark, d, "proposed_frames"), "frame_id", "lexical_units"), "proposed_frames", "frame", {"lexical_units": ("lemma",)}, {"record_id": ("frame", "id")})
    child = F.expr("CASE kind WHEN 'FEs' THEN 'FE' WHEN 'target' THEN 'target' ELSE 'lexical_unit' END").alias("child")
    item_pos = F.when(F.col("kind") == "target", 0).otherwise(F.col("pos")).cast("int").alias("item_pos")
    found = typed.union(raw).filter("set_pos IS NOT NULL").union(units.withColumn("set_pos", F.lit("0")))
    return found.select("record_table", F.col("record_id").try_cast("bigint").alias("record_id"), child, F.col("set_pos").cast("int").alias("set_pos"), item_pos, F.col("value").alias("item")).filter("item IS NOT NULL AND record_id IS NOT NULL")


def p2_annotation_sets(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of annotation sets with the labels that link it to its sentence and its children."""
    kept = sentence_nodes(spark, d).filter(F.col("kind").isin("sentence", "annotationSets"))
    linked = link_by_interval(kept, {"sentence": {"record_id": F.col("fields").getItem("id").try_cast("bigint")}}, in_order=True)
    return node_table(linked, "annotationSets", {"id": "bigint", "luName": "string", "frameName": "string", "frameStatus": "string"}, "record_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """field, record_id, value_pos, value: every value of the four packed fields."""
    parts = [explode_packed(table(spark, d, t), i, c, f"{t}.{c}") for t, i, c in PACKED_FIELDS]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


QUERIES = {"p2_found": p2_found, "p2_annotation_sets": p2_annotation_sets, "p6_found": p6_found}


def _list_sql(x: str) -> str:
    """A JSON value as a list: JSON text as what it encodes, a lone value as a list of one."""
    y = f"(CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END)"
    return f"CASE WHEN {y} IS NULL OR json_type({y}) = 'NULL' THEN [] WHEN json_type({y}) = 'ARRAY' THEN json_extract({y}, '$[*]') ELSE [{y}] END"


_PARTS = f"""
WITH p AS (SELECT CAST(payload AS JSON) AS p FROM (SELECT DISTINCT ON (raw_id) payload FROM raw_annotations) WHERE json_valid(payload)),
s AS (SELECT unnest({_list_sql("(CASE WHEN json_type(p) = 'OBJECT' THEN coalesce(p -> 'sentences', p) ELSE p END)")}) AS s FROM p),
l AS (SELECT TRY_CAST(s ->> 'id' AS BIGINT) AS id, {_list_sql("coalesce(s -> 'annotationSets', s -> 'annotation_sets')")} AS l FROM s WHERE json_type(s) = 'OBJECT'),
a AS (SELECT id, generate_subscripts(l, 1) AS set_pos, unnest(l) AS a FROM l),
f AS (SELECT id, set_pos, {_list_sql("(a -> 'FEs')")} AS fes, {_list_sql("(a -> 'target')")} AS ts FROM a),
o AS (SELECT sentence_id AS id, generate_subscripts(annotationSets, 1) AS set_pos, unnest(annotationSets) AS a FROM (SELECT DISTINCT ON (sentence_id) * FROM odyssey_7_189_framenet)),
u AS (SELECT frame_id AS id, generate_subscripts(lexical_units, 1) AS item_pos, unnest(lexical_units) AS u FROM (SELECT DISTINCT ON (frame_id) * FROM proposed_frames))
SELECT 'raw_annotations' AS record_table, id AS record_id, 'FE' AS child, CAST(set_pos AS INT) AS set_pos, CAST(item_pos AS INT) AS item_pos, f ->> 'name' AS item FROM (SELECT id, set_pos, generate_subscripts(fes, 1) AS item_pos, unnest(fes) AS f FROM f)
UNION ALL SELECT 'raw_annotations', id, 'target', CAST(set_pos AS INT), 0, t ->> 'start' FROM (SELECT id, set_pos, unnest(ts) AS t FROM f)
UNION ALL SELECT 'odyssey_7_189_framenet', id, 'FE', CAST(set_pos AS INT), CAST(item_pos AS INT), f.name FROM (SELECT id, set_pos, generate_subscripts(a.FEs, 1) AS item_pos, unnest(a.FEs) AS f FROM o)
UNION ALL SELECT 'odyssey_7_189_framenet', id, 'target', CAST(set_pos AS INT), 0, CAST(a.target.start AS VARCHAR) FROM o
UNION ALL SELECT 'proposed_frames', id, 'lexical_unit', 0, CAST(item_pos AS INT), u.lemma FROM u
"""

ORACLE: dict[str, str] = {"p2_found": f"SELECT * FROM ({_PARTS}) WHERE item IS NOT NULL AND record_id IS NOT NULL"}
