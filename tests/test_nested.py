from __future__ import annotations

import json

import pyarrow.parquet as pq
from conftest import DATA, needs_data, rows
from pyspark.sql import functions as F

from lexforge.operators.nested import label_nodes, label_tree, link_by_interval, linked_nodes, node_table, parse_whole
from lexforge.plans.problems import CONTAINERS, RENAME, p2_annotation_sets, p2_found


def test_intervals_contain_their_children():
    nodes = label_tree({"a": [{"b": {"c": 1}}, None, {"b": 2}], "x": 5}, "root", frozenset(), {})
    kinds = [(k, pos, depth) for _, _, depth, k, pos, _ in nodes]
    assert kinds == [("root", 1, 0), ("a", 1, 1), ("b", 1, 2), ("a", 3, 1)]
    labels = [(a, b) for a, b, *_ in nodes]
    assert sorted(x for p in labels for x in p) == list(range(1, 9))
    assert labels[0][0] < labels[2][0] < labels[2][1] < labels[1][1] < labels[3][0] < labels[0][1]


def test_parse_whole():
    assert parse_whole(None) is parse_whole("") is parse_whole('{"a": ') is parse_whole("{} x") is parse_whole("[NaN]") is None
    assert parse_whole("[1]") == [1]


def test_deep_nesting_does_not_crash():
    deep: dict = {}
    at = deep
    for _ in range(5000):
        at["x"] = {}
        at = at["x"]
    assert len(label_tree(deep, "r", frozenset(), {})) == 5001
    assert label_tree(parse_whole("[" * 100_000), "r", frozenset(), {}) == []


def test_lone_objects_text_and_places(spark):
    s = {"id": "7", "annotation_sets": json.dumps({"FEs": [None, {"name": "A"}, {"name": None}], "target": {"start": "3"}, "review": {"marks": [{"name": "no"}]}})}
    docs = spark.createDataFrame([(1, json.dumps({"sentences": [s]})), (2, "{"), (3, None), (4, json.dumps([s, {"id": 8}]))], "doc_id bigint, payload string")
    n = label_nodes(docs, "t", "sentence", containers=CONTAINERS, rename=RENAME, unwrap="sentences")
    linked = link_by_interval(n, {"sentence": {"sid": F.col("fields").getItem("id")}, "annotationSets": {"set_pos": F.col("pos")}})
    got = rows(linked.filter("kind = 'FEs'").select("doc_id", "sid", "set_pos", "pos", F.col("fields").getItem("name")))
    assert got == [(1, "7", 1, 2, "A"), (1, "7", 1, 3, None), (4, "7", 1, 2, "A"), (4, "7", 1, 3, None)]
    assert rows(node_table(n, "target", {"start": "int"}).select("doc_id", "start")) == [(1, 3), (4, 3)]


def test_kinds_inside_their_own_kind(spark):
    tree = {"sub": [{"name": "A", "sub": [{"name": "B", "leaf": [{"v": 0}]}], "leaf": [{"v": 1}]}, {"name": "C"}], "leaf": [{"v": 2}]}
    docs = spark.createDataFrame([(i, json.dumps(tree)) for i in range(3)], "doc_id bigint, payload string")
    n = label_nodes(docs, "t", "root")
    want = sorted([(i, v, name) for i in range(3) for v, name in (("0", "B"), ("1", "A"), ("2", None))], key=repr)
    above = {"sub": {"in_sub": F.col("fields").getItem("name")}}
    for nodes, in_order in ((n, True), (n, False), (n.repartition(5).orderBy(F.rand(3)), False), (n.filter("kind <> 'root'"), True)):
        linked = link_by_interval(nodes, above, in_order)
        assert rows(linked.filter("kind = 'leaf'").select("doc_id", F.col("fields").getItem("v"), "in_sub")) == want
        assert rows(linked.filter("fields['name'] = 'B' AND doc_id = 0").select("in_sub")) == [("A",)]
    one = linked_nodes(docs, "t", "root", {"leaf": ("v",), "sub": ("name",)}, {"in_sub": ("sub", "name"), "at": ("sub", None), "top": ("root", None)})
    assert rows(one.filter("kind = 'leaf'").select("doc_id", "value", "in_sub")) == want
    both = link_by_interval(n, {"sub": {"in_sub": F.col("fields").getItem("name"), "at": F.col("pos").cast("string")}, "root": {"top": F.col("pos").cast("string")}}).filter("kind <> 'root'")
    keys = ["doc_id", "pre", "post", "depth", "kind", "pos"]
    assert rows(one.select(*keys, "value", "in_sub", "at", "top")) == rows(both.select(*keys, F.coalesce(F.col("fields").getItem("v"), F.col("fields").getItem("name")), "in_sub", "at", "top"))


def brute(d: str) -> list[tuple]:
    """The rows of p2_found by plain loops."""
    lst = lambda x: x if isinstance(x, list) else [x]
    out, sentences = [], []
    for r in {r["raw_id"]: r for r in pq.read_table(f"{d}/raw_annotations.parquet").to_pylist()}.values():
        x = parse_whole(r["payload"])
        if isinstance(x, dict) and "sentences" in x:
            x = x["sentences"]
        sentences += [("raw_annotations", int(s["id"]), s.get("annotationSets", s.get("annotation_sets"))) for s in lst(x) if s]
    sentences += [("odyssey_7_189_framenet", i, r["annotationSets"]) for i, r in {r["sentence_id"]: r for r in pq.read_table(f"{d}/odyssey_7_189_framenet.parquet").to_pylist()}.items()]
    for t, i, sets in sentences:
        sets = parse_whole(sets) if isinstance(sets, str) else sets
        for k, a in enumerate(lst(sets), 1):
            if a:
                if (a.get("target") or {}).get("start") is not None:
                    out.append((t, i, "target", k, 0, str(a["target"]["start"])))
                out += [(t, i, "FE", k, j, f["name"]) for j, f in enumerate(lst(a.get("FEs")), 1) if f and f.get("name") is not None]
    for i, r in {r["frame_id"]: r for r in pq.read_table(f"{d}/proposed_frames.parquet").to_pylist()}.items():
        out += [("proposed_frames", i, "lexical_unit", 0, j, u["lemma"]) for j, u in enumerate(r["lexical_units"] or [], 1) if u and u["lemma"] is not None]
    return sorted(out, key=repr)


@needs_data
def test_found_against_loops(spark):
    assert rows(p2_found(spark, DATA)) == brute(DATA)


@needs_data
def test_empty_and_clashing_columns(spark, empty_dir, wide_dir):
    assert p2_found(spark, empty_dir).count() == 0
    assert rows(p2_found(spark, wide_dir)) == brute(DATA)
    assert p2_annotation_sets(spark, DATA).filter("record_id IS NULL").count() == 0
