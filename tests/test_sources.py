from __future__ import annotations

import pandas as pd
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexforge.functions.text import is_content_word
from lexforge.sources import readers, sinks

XML = """<?xml version="1.0"?><treebank>
<sentence id="1" document_id="urn:cts:greekLit:tlg0012.tlg001" subdoc="1.1">
<word id="1" form="μῆνιν" lemma="μῆνις" postag="n-s---fa-" head="2" relation="OBJ" cite="urn:cts:x:1.1"/>
<word id="2" form="ἄειδε" lemma="ἀείδω" postag="v2spma" head="0" relation="PRED" cite="urn:cts:x:1.1"/>
<word id="x" form="," head="" relation="AuxX" cite="pr"/></sentence>
<sentence id="1" document_id="urn:cts:greekLit:tlg0012.tlg002"><word id="1" form="ἄνδρα" lemma=" ἀνήρ " postag="n-s---ma-" head="0"/></sentence>
</treebank>"""


def test_treebank(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML, encoding="utf-8")
    words = readers.treebank_words(spark, [str(tmp_path / "a.xml")])
    t = readers.token_table(words)
    assert t.columns == readers.TOKEN_COLUMNS
    got = rows(t.select("work", "book", "line", "word_id", "lemma", "pos", "mood", "head"))
    assert got == sorted([("Iliad", 1, 1, 1, "μῆνις", "n", None, 2), ("Iliad", 1, 1, 2, "ἀείδω", "v", "m", 0), ("Iliad", None, None, None, "", None, None, None), ("Odyssey", None, None, 1, "ἀνήρ", "n", None, 0)], key=repr)
    assert readers.lemma_words(words).count() == 3
    s = readers.training_sentences(t, is_content_word(F.col("lemma")))
    assert rows(s.select("work", "tokens")) == [("Iliad", ["μῆνις", "ἀείδω"]), ("Odyssey", ["ἀνήρ"])]


def test_treebank_of_two_files(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n},x.xml").write_text(XML.replace("μῆνις", f"μῆνις{n}"), encoding="utf-8")
    words = readers.treebank_words(spark, [str(tmp_path / f"{n},x.xml") for n in "ab"])
    assert words.count() == 8
    assert {r["lemma"] for r in words.collect()} >= {"μῆνιςa", "μῆνιςb"}


def test_alignment_of_many_columns(spark, tmp_path):
    wide = ",".join(f"h{i}" for i in range(100))
    (tmp_path / "w.csv").write_text(f'about Lemmas,here\nno Lemmas\nCitation,Greek text,{wide},"Lemmas"\n1.1,"a\nb",{"," * 99},last,over\n', encoding="utf-8")
    assert rows(readers.alignment_rows(spark, str(tmp_path / "w.csv"))) == [("1.1", "a\nb", "last")]
    (tmp_path / "n.csv").write_text("Citation,Greek text\n1,Lemmas of\n", encoding="utf-8")
    with pytest.raises(ValueError, match="no row"):
        readers.alignment_rows(spark, str(tmp_path / "n.csv"))


def test_alignment(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿http://junk\nCitation,Greek text,English,Lemmas,x,Lemmas\n1.1,"μῆνιν, ἄειδε",wrath,μῆνις ἀείδω,,later one\n1.2,θεά,goddess,θεά,,\n1.3,ἓν δύο,x,εἷς,,\n', encoding="utf-8")
    last = readers.alignment_rows(spark, str(tmp_path / "a.csv"))
    assert rows(last) == [("1.1", "μῆνιν, ἄειδε", "later one"), ("1.2", "θεά", "θεά"), ("1.3", "ἓν δύο", "εἷς")]
    first = readers.alignment_rows(spark, str(tmp_path / "a.csv"), pick="first")
    assert rows(readers.aligned_pairs(first).select("Citation", "lemma_list")) == [("1.1", ["μῆνις", "ἀείδω"]), ("1.2", ["θεά"])]


def test_dictionary(spark):
    lines = spark.createDataFrame([("1#urn:x:1#·ξέν-ος#**ξένος** **guest**, **host # x**",), ("bad",), ("2#no#y#z",), ("3#urn:x:3#λόγος#plain",)], "value string")
    e = readers.cex_entries(lines)
    assert rows(e.select("seq", "headword")) == [(1, "·ξέν-ος"), (3, "λόγος")]
    assert rows(readers.dictionary_glosses(e)) == [(1, "urn:x:1", "ξένος", "guest; host # x")]
    assert readers.cex_entries(lines, 1).count() == 1


def test_dump(spark):
    lines = spark.createDataFrame([("INSERT INTO t VALUES ('it''s','a\\'b',NULL, 12,'(x, y)');",), ("INSERT INTO u VALUES ('no');",), ("",)], "value string")
    assert rows(readers.dump_rows(lines, "t", list("abcdef"))) == [("it's", "a'b", None, "12", "(x, y)", None)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=8), st.integers(0, 99)), min_size=1, max_size=5))
def test_tuple_round_trip(values):
    sql = ",".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "''") + "'" for v in values)
    assert readers.parse_tuple(sql) == [None if v is None else str(v) for v in values]


def test_listing_round_trip(spark, tmp_path):
    m = spark.createDataFrame([(3, "ξένος", 10, "guest", 1), (3, "δῶρον", 5, None, 2), (4, "οἶκος", 7, "house", 1)], "cluster int, lemma string, freq int, gloss string, rank int")
    sinks.write_listing(sinks.cluster_listing(m), str(tmp_path / "l"))
    lines = spark.createDataFrame([(i, x) for i, x in enumerate("\n".join(r["value"] for r in spark.read.text(str(tmp_path / "l")).collect()).split("\n"))], "line_no int, value string")
    assert rows(readers.cluster_members(lines)) == sorted([(3, "ξένος", 10, "guest"), (3, "δῶρον", 5, ""), (4, "οἶκος", 7, "house")], key=repr)


def test_xml_and_tables(spark, tmp_path):
    s = spark.sql("SELECT 1L AS sentence_id, 'a < b' AS text, array(named_struct('id', 1, 'luName', 'l', 'frameName', 'F', 'target', named_struct('start', 0, 'end', 1), 'FEs', array(named_struct('name', 'A', 'start', 0, 'end', 1, 'itype', null), named_struct('name', 'B', 'start', null, 'end', null, 'itype', 'DNI'))), null) AS annotationSets")
    xml = sinks.annotation_xml(s, "c").first()["xml"]
    assert "a &lt; b" in xml
    assert '<label name="B" itype="DNI"/>' in xml
    assert '<label name="A" start="0" end="1"/>' in xml
    half = spark.sql("SELECT 1L AS sentence_id, 'a' AS text, array(named_struct('id', 1, 'luName', 'l', 'frameName', 'F', 'target', named_struct('start', 0, 'end', cast(null AS int)), 'FEs', array(named_struct('name', 'A', 'start', 1, 'end', cast(null AS int), 'itype', 'INI')))) AS annotationSets")
    assert sinks.annotation_xml(half, "c").first()["xml"].endswith('<layer name="FE"><label name="A" itype="INI"/></layer></annotationSet></sentence>')
    p = pd.DataFrame({"a": ["x|y"], "b": [1]})
    assert sinks.markdown_table(p).endswith("| x\\|y | 1 |")
    assert "<table" in sinks.html_table(p, "t")
    sinks.write_table(spark.range(3), str(tmp_path / "t"), "csv")
    assert readers.csv_rows(spark, str(tmp_path / "t")).count() == 3
    sinks.write_back(spark.range(3), spark.range(5), "id", str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 5
    sinks.report(spark.range(1), str(tmp_path / "r"))
    assert readers.json_documents(spark, str(tmp_path / "r"), "id bigint").first()["id"] == 0
