"""Readers of the corpus' file formats."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions.text import book_line, decode_postag, english_spans, first_words, nfc, tokenize_line

TREEBANK_SCHEMA = "_id string, _document_id string, _subdoc string, word array<struct<_id:string,_form:string,_lemma:string,_postag:string,_head:string,_relation:string,_cite:string,_VALUE:string>>"
# The columns of the token table.
TOKEN_COLUMNS = ["work", "sentence_id", "subdoc", "book", "line", "word_id", "form", "lemma", "pos", "person", "number", "tense", "mood", "voice", "gender", "case", "degree", "head", "relation", "postag"]


def treebank_words(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per <word> of every <sentence>, in any of the files, all attributes as text."""
    s = spark.read.format("xml").option("rowTag", "sentence").schema(TREEBANK_SCHEMA).load(paths)
    doc = F.coalesce("_document_id", F.lit(""))
    work = F.when(doc.contains("tlg0012.tlg001"), "Iliad").when(doc.contains("tlg0012.tlg002"), "Odyssey").otherwise("?")
    return s.select(work.alias("work"), F.col("_id").alias("sentence_id"), F.col("_subdoc").alias("subdoc"), F.posexplode("word").alias("position", "w")).select("work", "sentence_id", "subdoc", "position", *[F.col(f"w._{c}").alias(c) for c in ("id", "form", "lemma", "postag", "head", "relation", "cite")])


def token_table(words: DataFrame) -> DataFrame:
    """The token table (S3) of treebank words: citation, head and postag decoded, lemma trimmed and composed ('' for null)."""
    book, line = book_line(F.col("cite"))
    tags = decode_postag(F.col("postag"))
    out = words.select("work", "sentence_id", "subdoc", book.alias("book"), line.alias("line"), F.col("id").try_cast("int").alias("word_id"), F.coalesce("form", F.lit("")).alias("form"), F.coalesce(nfc(F.trim("lemma")), F.lit("")).alias("lemma"), *[c.alias(n) for n, c in tags.items()], F.col("head").try_cast("int").alias("head"), F.coalesce("relation", F.lit("")).alias("relation"), F.coalesce("postag", F.lit("")).alias("postag"))
    return out.select(*TOKEN_COLUMNS)


def lemma_words(words: DataFrame) -> DataFrame:
    """The words that have a lemma."""
    return words.filter("lemma IS NOT NULL AND lemma <> ''")


def training_sentences(tokens: DataFrame, content: Column) -> DataFrame:
    """work, sentence_id, tokens: the kept lemmas of each sentence in word order. The key holds the work, as ids repeat between works."""
    return tokens.filter(content).groupBy("work", "sentence_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("word_id", "lemma"))), lambda x: x["lemma"]).alias("tokens"))


def alignment_rows(spark: SparkSession, path: str, marker: str = "Lemmas", pick: str = "last", columns: tuple[str, ...] = ("Citation", "Greek text")) -> DataFrame:
    """The named columns and the lemma column of an alignment CSV whose header isn't its first line.

    The header is the first row with a cell equal to marker. pick 'last' takes the last non-empty of the columns of
    that name, 'first' the first one. A first pass finds that row and how many cells it has, so no named column is
    dropped however many there are; cells of other rows beyond it have no name. Only rows up to the header that hold
    the marker come to the driver. A file without header gives an error.
    """
    schema = "c0 string, c1 string, _corrupt_record string"  # a record of any other number of cells is kept as text
    texts = spark.read.csv(path, header=False, multiLine=True, escape='"', schema=schema, mode="PERMISSIVE")
    text = F.coalesce("_corrupt_record", F.concat_ws(",", "c0", "c1"))
    width = 0
    for r in texts.select("c0", "c1", "_corrupt_record").filter(text.contains(marker)).toLocalIterator():
        record = r["_corrupt_record"] or f"{r['c0'] or ''},{r['c1'] or ''}"
        cells = [c.lstrip("\ufeff").strip() for c in next(csv.reader([record] if "\n" not in record else io.StringIO(record, newline="")))]
        if marker in cells:
            width = len(cells)
            break
    if not width:
        raise ValueError(f"no row of {path} has a cell {marker}")
    raw = spark.read.csv(path, header=False, multiLine=True, escape='"', schema=", ".join(f"c{i} string" for i in range(width)), mode="PERMISSIVE")
    cells = raw.select(F.array(*[F.trim(F.regexp_replace(c, "^\\x{FEFF}", "")) for c in raw.columns]).alias("r"), F.monotonically_increasing_id().alias("i"))
    head = cells.filter(F.array_contains("r", marker)).orderBy("i").first()
    names, at = head["r"], head["i"]
    places = [i for i, n in enumerate(names) if n == marker]
    body = cells.filter(F.col("i") > at)
    options = [F.nullif(F.col("r")[i], F.lit("")) for i in places]
    lemma = F.coalesce(*reversed(options)) if pick == "last" else F.col("r")[places[0]]
    return body.select(*[F.col("r")[names.index(c)].alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in columns], lemma.alias(marker))


def aligned_pairs(rows: DataFrame, text: str = "Greek text", lemmas: str = "Lemmas") -> DataFrame:
    """rows with words and lemma_list, kept where both have the same number over 0."""
    w = rows.withColumn("words", tokenize_line(F.col(text))).withColumn("lemma_list", F.filter(F.split(F.trim(nfc(F.col(lemmas))), r"\s+"), lambda x: x != ""))
    return w.filter((F.size("words") > 0) & (F.size("words") == F.size("lemma_list")))


def cex_entries(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """seq, urn, headword, entry of lines (column value) seq#urn#headword#entry whose second field begins urn:."""
    p = F.split(F.trim("value"), "#", 4)
    rows = lines.select(p.alias("p")).filter((F.size("p") >= 4) & F.col("p")[1].startswith("urn:"))
    out = rows.select(F.col("p")[0].try_cast("bigint").alias("seq"), F.col("p")[1].alias("urn"), F.col("p")[2].alias("headword"), F.col("p")[3].alias("entry"))
    return out.limit(limit) if limit else out


def dictionary_glosses(entries: DataFrame, words: int = 60) -> DataFrame:
    """seq, urn, headword (cleaned), gloss: the English bold spans joined, cut to the first words; entries without any are left out."""
    head = F.regexp_replace(F.btrim(F.trim("headword"), F.lit("·—")), "-", "")
    out = entries.select("seq", "urn", head.alias("headword"), first_words(F.array_join(english_spans(F.col("entry")), "; "), words).alias("gloss"))
    return out.filter("headword <> '' AND gloss <> ''")


def parse_tuple(text: str) -> list[str | None]:
    """The values of the inside of an SQL VALUES (...) tuple: '..' with '' and backslash escapes, NULL, bare words."""
    import re

    out: list[str | None] = []
    for quoted, null, plain in re.findall(r"\s*(?:'((?:[^'\\]|\\.|'')*)'|(NULL)(?=\s*(?:,|$))|([^,]+))\s*(?:,|$)", text, re.S):
        if null:
            out.append(None)
        elif plain:
            out.append(plain.strip())
        else:
            out.append(re.sub(r"\\(.)|''", lambda m: m[1] or "'", quoted, flags=re.S))
    return out


def dump_rows(lines: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The rows inserted into one table of an SQL dump, one statement per line (S10). Missing values are null, further ones dropped."""
    prefix = f"INSERT INTO {name} VALUES ("
    body = lines.filter(F.col("value").startswith(prefix)).select(F.regexp_replace(F.substr("value", F.lit(len(prefix) + 1)), r"\)\s*;?\s*$", "").alias("t"))
    schema = ", ".join(f"`{c}` string" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(parse_tuple(t) + [None] * len(columns))[: len(columns)] for t in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in range(len(columns))], names=columns)

    return body.mapInArrow(run, schema)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON documents by a given schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all columns text."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def cluster_members(lines: DataFrame) -> DataFrame:
    """cluster_id, lemma, freq, gloss of a cluster listing: 'cluster N ' lines, then indented 'lemma (freq): gloss' (S15).

    lines: value and line_no (the order in the file), and file where there are several; the lines of one file, which
    is a small text report, form one window.
    """
    id_ = F.regexp_extract("value", r"^cluster (-?\d+) ", 1).try_cast("int")
    file = [F.col("file")] if "file" in lines.columns else [F.lit(0)]
    at = lines.withColumn("cluster_id", F.last(id_, ignorenulls=True).over(Window.partitionBy(*file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)))
    pattern = r"^\s+(\S+) \((\d+)\): (.*)"
    return at.filter(F.col("value").rlike(pattern)).select("cluster_id", F.regexp_extract("value", pattern, 1).alias("lemma"), F.regexp_extract("value", pattern, 2).cast("int").alias("freq"), F.regexp_extract("value", pattern, 3).alias("gloss"))
