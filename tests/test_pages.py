from __future__ import annotations

import json

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lexforge.functions import glossing
from lexforge.functions import text as tx
from lexforge.operators import lexicon, vectors
from lexforge.sources import pages, sinks

GLOSSES = {"ξένος": "guest", "ἐπ' οὐδῷ": "on the threshold", "μῆνιν … θεά": "wrath, goddess"}


def test_greek_runs():
    t = "a ξένος, ἐπ’ οὐδῷ... χρυσῷ; δ’ἄρα ὁ"
    assert [t[a:b] for a, b in glossing.greek_runs(t)] == ["ξένος", "ἐπ’ οὐδῷ... χρυσῷ", "δ", "ἄρα ὁ"]
    assert glossing.greek_runs("") == glossing.greek_runs("abc") == []


def test_glosses_in_text_and_lines():
    assert tx.gloss_greek("ξένος and ξένος (‘host’), λόγος", GLOSSES) == "ξένος ‘guest’ and ξένος (‘host’), λόγος"
    line = "**ξένος**2 [x](http://ξένος) ξένος ἐπ’ οὐδῷ, ὁ ἡ"
    assert glossing.gloss_line("**ξένος** and ξένος; ἐπ’ οὐδῷ.", GLOSSES) == "**ξένος** ‘guest’ and ξένος; ἐπ’ οὐδῷ ‘on the threshold’."
    assert "http://ξένος)" in glossing.gloss_line(line, GLOSSES)
    assert glossing.gloss_line("[[ξένος]] 'host' then ξένος", GLOSSES) == "[[ξένος]] 'host' then ξένος"


def test_glosses_in_markdown():
    md = "---\ntitle: ξένος\n---\n```\nξένος\n```\n| Lemma | Note |\n|---|---|\n| ξένος | of ξένος and ἐπ’ οὐδῷ |\n| – | x |\n\nξένος"
    got = glossing.gloss_markdown(md, GLOSSES).split("\n")
    assert got[:6] == md.split("\n")[:6]
    assert got[6:8] == ["| Lemma | Gloss | Note |", "| --- | --- | --- |"]
    assert got[8] == "| ξένος | guest | of ξένος and ἐπ’ οὐδῷ ‘on the threshold’ |"
    assert got[9] == "| – |  | x |"
    assert got[-1] == "ξένος ‘guest’"
    assert glossing.gloss_markdown("", GLOSSES) == ""


def test_offsets_and_passages(spark):
    assert tx.place_tokens("μῆνιν ἄειδε, θεά ἄειδε", ["μῆνιν", ",", "ἄειδε", None, "no", "ἄειδε", "θεά"]) == [(0, 0, 4), (2, 6, 10), (5, 17, 21)]
    assert tx.place_tokens(None, ["a"]) == tx.place_tokens("a", None) == []
    t = spark.createDataFrame([("Odyssey", "2", 1, "ξεῖνε", "ξένος", "n", "urn:x:7.189"), ("Odyssey", "2", 2, ",", ",", "u", "urn:x:7.189"), ("Odyssey", "10", 1, "χαῖρε", "χαίρω", "v", "urn:x:7.190"), ("Iliad", "2", 1, "no", "no", "n", "urn:x:7.189")], "work string, sentence_id string, position int, form string, lemma string, postag string, cite string")
    p = spark.createDataFrame([(1, "Homer, Odyssey 7.189-190", "t", None, "Odyssey", ["urn:x:7.189", "urn:x:7.190"]), (2, "Homer, Odyssey 9.1-2", "t", "given", "Odyssey", ["urn:x:9.1"]), (3, "x", "t", "χαῖρε", "Odyssey", ["urn:x:7.189"])], "passage int, source string, text_source string, text string, work string, cites array<string>")
    got = {r["passage"]: r for r in sinks.passage_documents(t, p).collect()}
    assert got[1]["text"] == "ξεῖνε, χαῖρε" and got[1]["unplaced"] == 0
    assert [(x["form"], x["cite"], x["start"], x["end"]) for x in got[1]["tokens"]] == [("ξεῖνε", "7.189", 0, 4), ("χαῖρε", "7.190", 7, 11)]
    assert got[2]["text"] == "given" and got[2]["tokens"] == [] and got[2]["unplaced"] == 0
    assert got[3]["unplaced"] == 1
    s = p.select(tx.slug(F.col("source")).alias("s"), tx.escape_url(F.lit("ξ a/b")).alias("u"))
    assert [r["s"] for r in s.collect()] == ["odyssey_7_189_framenet", "odyssey_9_1_framenet", None]
    assert s.first()["u"] == "%CE%BE%20a/b"
    assert [r[0] for r in spark.createDataFrame([(0.125,), (0.375,), (None,)], "x double").select(tx.two_places(F.col("x"))).collect()] == [0.12, 0.38, None]
    assert spark.range(1).select(tx.detokenize(F.array(F.lit("μη"), F.lit("δέ"), F.lit(".")))).first()[0] == "μηδέ."


def test_pages_and_notes(spark):
    kind = "sentence_id bigint, source string, text string, translation string, annotationSets array<struct<id:int,luName:string,frameName:string,frameStatus:string,target:struct<name:string,start:int,end:int,text:string>,FEs:array<struct<name:string,start:int,end:int,text:string,itype:string>>>>"
    sets = [(1, "l", "F<", "existing", ("T", 2, 3, "cd"), [("A", 0, 3, "abcd", None), None, ("B", None, None, None, "INI"), ("C", 3, 9, "x", None)]), None]
    got = {r["sentence_id"]: r["html"] for r in pages.passage_pages(spark.createDataFrame([(1, "S", "abcd", "t", sets), (2, None, None, None, None)], kind)).collect()}
    assert '<mark class="fe" title="A">ab<mark class="t" title="F&lt;">cd</mark></mark>' in got[1]
    assert "<title>2</title>" in got[2]
    assert pages.marked_text("abcdef", [(0, 2, "x", ""), (1, 5, "y", "")]) == '<mark class="x" title="">a<mark class="y" title="">bc</mark></mark>def'
    f = spark.createDataFrame([("ξένος", "guest", None, "s1", "F", "existing", "A, B"), ("ξένος", "guest", None, None, "G", None, None), (None,) * 7], "lemma string, gloss string, note string, sense string, frame string, status string, core string")
    note = pages.lemma_notes(f, GLOSSES).collect()
    assert len(note) == 1 and note[0]["markdown"].startswith("# ξένος ‘guest’\n\nguest\n") and "| s1 | F | existing | A, B |" in note[0]["markdown"]
    assert "| ξένος | guest |" in pages.terms_table(f.filter("sense = 's1'").select("lemma", "frame"), GLOSSES)
    assert rows(pages.glossed_column(f.select("lemma", F.lit("ξένος").alias("t")).filter("lemma IS NOT NULL").distinct(), "lemma", "t", GLOSSES)) == [("ξένος", "ξένος ‘guest’")]
    html = pages.table_page(f.select("lemma", "frame"), "t", ("frame",))
    assert html.count("<tr>") == 4 and "<option>G</option>" in html
    with pytest.raises(ValueError, match="more than 1"):
        pages.table_page(f, "t", most=1)
    report = pages.text_report("Run", {"all": spark.createDataFrame([(3, 0.25)], "n int, share double"), "by": f.select("frame", "status").filter("frame IS NOT NULL").orderBy("frame")})
    assert report == "Run\n===\n\nall\n  n: 3\n  share: 0.25\n\nby\n  frame  status\n  F      existing\n  G      –\n"


def test_snapshot_of_pages(spark):
    def get(url):
        if url == "bad":
            raise OSError
        pages = {"u/a": (200, {"results": []}), "u/b": (200, {"results": [1], "next": "u/b2"}), "u/b2": (200, {"results": [2], "next": "u/b"}), "u/c": (404, {})}
        return pages[url]

    asked = spark.createDataFrame([("x", ["a", " b "]), ("y", ["c", "d"]), ("z", None), ("w", ["a"])], "lemma string, forms array<string>")
    known = spark.createDataFrame([("w",)], "lemma string")
    got = {r["lemma"]: r for r in lexicon.snapshot(asked, known, get, lambda f: "bad" if f == "d" else f"u/{f}").collect()}
    assert got["x"]["found"] and got["x"]["form"] == "b" and len(json.loads(got["x"]["pages"])) == 2
    assert [(a["status"], a["found"]) for a in got["y"]["attempts"]] == [(404, False), (0, False)] and not got["y"]["found"]
    assert got["z"]["attempts"] == [] and "w" not in got
    page = {"results": [{"synsets": {"other": [{"gloss": "no", "semfield": [{"english": "A"}, {}]}], "literal": [{"semfield": None}, {"gloss": "g" * 200, "semfield": [{"english": "A"}]}]}}]}
    assert lexicon.fetched_row("x", [page]) == ("x", True, ["A", "A"], "g" * 120, False)
    assert lexicon.fetched_row("x", None) == ("x", False, [], "", True)
    with pytest.raises(ValueError, match="more than"):
        lexicon.fetch_pages(lambda u: (200, {"next": u + "x"}), "u", 5)


def test_encoders(spark):
    df = spark.createDataFrame([(i, "ab" * i if i % 4 else None) for i in range(9)], "i int, t string")
    load = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    first = vectors.encode_texts(df.filter("i < 4"), "i", "t", load, 2)
    got = {r["i"]: r["vector"] for r in vectors.encode_texts(df, "i", "t", load, 2, first).collect()}
    assert sorted(got) == [1, 2, 3, 5, 6, 7]
    assert np.allclose(got[2], np.array([4, 1]) / np.sqrt(17))
    assert vectors.encode_texts(df.limit(0), "i", "t", load).count() == 0
    pieces = lambda: lambda texts: [(np.array([[0, 0], [2, 0], [0, 2], [9, 9]]), [(0, 0), (0, 2), (2, 4), (4, 4)]) for _ in texts]
    o = df.filter("t IS NOT NULL").withColumn("targets", F.expr("array(struct(0 AS start, 2 AS end), struct(1 AS start, 3 AS end), struct(7 AS start, 9 AS end), struct(null AS start, 1 AS end), null)"))
    r = [(x["target"], [round(v, 3) for v in x["vector"]]) for x in vectors.encode_occurrences(o.filter("i = 1"), "i", "t", "targets", pieces).collect()]
    assert r == [(0, [1, 0]), (1, [0.707, 0.707])]


def test_plot_rows_and_copies(spark, tmp_path):
    p = spark.createDataFrame([(i, 0.0, 1.0, -1 if i == 0 else i % 2, 10 - i) for i in range(6)], "item int, x double, y double, label int, freq int")
    assert [r["item"] for r in sinks.plot_rows(p, 2).filter("text IS NOT NULL").orderBy("item").collect()] == [1, 2]
    (tmp_path / "a.csv").write_text("x")
    sinks.copy_files(spark, {f"{tmp_path}/a.csv": f"{tmp_path}/out/b.csv"})
    assert (tmp_path / "out" / "b.csv").read_text() == "x"
