"""Writers of listings, reports, documents and caches."""

from __future__ import annotations

from collections.abc import Iterator
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexforge.functions.text import detokenize, nfc, token_offsets
from lexforge.operators.spans import passage_sentences


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Parquet by default; csv gets a header and quotes by need."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    (w.option("header", True).option("escape", '"') if fmt == "csv" else w).format(fmt).save(path)


def cluster_listing(members: DataFrame, names: DataFrame | None = None, gloss_chars: int = 90) -> DataFrame:
    """cluster, size, body: clusters as text, members by rank (K2). members: cluster, lemma, freq, gloss, rank; names: cluster, name."""
    line = F.format_string("  %s (%d): %s", "lemma", "freq", F.substring(F.coalesce("gloss", F.lit("")), 1, gloss_chars))
    rows = members.groupBy("cluster").agg(F.count("*").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]).alias("lines"))
    if names is not None:
        rows = rows.join(names, "cluster", "left")
    else:
        rows = rows.withColumn("name", F.lit(None).cast("string"))
    head = F.concat(F.format_string("cluster %d (%d)", "cluster", "size"), F.coalesce(F.concat(F.lit(": "), "name"), F.lit("")))
    return rows.select("cluster", "size", F.concat_ws("\n", head, F.array_join("lines", "\n")).alias("body"))


def write_listing(listing: DataFrame, path: str) -> None:
    """Text files in the order of their names, clusters by descending size then id (L7); a small listing is one file.

    The sort is over ranges, so no task holds the whole listing.
    """
    listing.orderBy(F.desc("size"), "cluster").select(F.concat("body", F.lit("\n"))).write.mode("overwrite").text(path)


def frame_listing(members: DataFrame, fillers: DataFrame, k: int = 8) -> DataFrame:
    """frame, body: members, and the k most frequent fillers of each slot (K3). members: frame, verb; fillers: frame, slot, term, n."""
    verbs = members.groupBy("frame").agg(F.array_join(F.array_sort(F.collect_list("verb")), ", ").alias("verbs"))
    ranked = fillers.withColumn("_r", F.row_number().over(Window.partitionBy("frame", "slot").orderBy(F.desc("n"), "term"))).filter(F.col("_r") <= k)
    slots = ranked.groupBy("frame", "slot").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term", "n"))), lambda x: F.concat(x["term"], F.lit(" "), x["n"].cast("string"))), ", ").alias("t"))
    lines = slots.groupBy("frame").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "slot", "t"))), "\n  ").alias("f"))
    return verbs.join(lines, "frame", "left").select("frame", F.concat_ws("\n  ", F.concat(F.lit("frame "), F.col("frame").cast("string")), "verbs", "f").alias("body"))


def topic_listing(terms: DataFrame, k: int = 15) -> DataFrame:
    """topic, line: its k heaviest terms (K4, L2). terms: topic, term, weight."""
    ranked = terms.withColumn("_r", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))).filter(F.col("_r") <= k)
    return ranked.groupBy("topic").agg(F.concat(F.lit("topic "), F.first("topic").cast("string"), F.lit(": "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]), ", ")).alias("line"))


def report(metrics: DataFrame, path: str) -> None:
    """A one-row table of metrics as JSON (K5)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def unglossed(lemmas: DataFrame) -> DataFrame:
    """lemma, freq without gloss, most frequent first (K6)."""
    return lemmas.filter("gloss IS NULL OR gloss = ''").select("lemma", "freq").orderBy(F.desc("freq"), "lemma")


def passage_documents(tokens: DataFrame, passages: DataFrame) -> DataFrame:
    """passage, source, text_source, text, tokens ARRAY<STRUCT<form, lemma, postag, cite, start, end>>, unplaced.

    tokens: work, sentence_id, position, form, lemma, postag, cite; passages: passage, source, text_source, text (null:
    made of the forms), work, cites ARRAY. A passage has the sentences of its work that share a citation with it, in the
    order of sentence and position. Offsets are found from left to right, end inclusive; unplaced counts the forms with
    a letter or digit that weren't found. A passage without sentences has no tokens.
    """
    kept = passage_sentences(tokens, passages.select("passage", "work", "cites"))
    word = F.struct(F.col("sentence_id").try_cast("bigint").alias("s"), "sentence_id", "position", nfc(F.coalesce("form", F.lit(""))).alias("form"), nfc(F.col("lemma")).alias("lemma"), "postag", F.element_at(F.split("cite", ":"), -1).alias("cite"))
    words = tokens.join(kept, ["work", "sentence_id"]).groupBy("passage").agg(F.array_sort(F.collect_list(word)).alias("w"))
    rows = passages.select("passage", "source", "text_source", F.col("text").alias("_t")).join(words, "passage", "left")
    placed = rows.withColumn("text", F.coalesce("_t", detokenize(F.col("w.form")))).withColumn("_o", token_offsets(F.col("text"), F.coalesce(F.col("w.form"), F.array().cast("array<string>"))))
    at = lambda o: F.get(F.col("w"), o["at"])
    found = F.transform("_o", lambda o: F.struct(*[at(o)[c].alias(c) for c in ("form", "lemma", "postag", "cite")], o["start"].alias("start"), o["end"].alias("end")))
    spoken = F.size(F.filter(F.coalesce(F.col("w.form"), F.array().cast("array<string>")), lambda f: f.rlike(r"[\p{L}\p{N}_]")))
    return placed.select("passage", "source", "text_source", "text", found.alias("tokens"), (spoken - F.size("_o")).alias("unplaced"))


def passages_json(sentences: DataFrame) -> DataFrame:
    """value: one JSON sentence per row (K7); write with write.text."""
    return sentences.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def plot_rows(points: DataFrame, top: int = 140) -> DataFrame:
    """item, x, y, label, freq, text: the points of a map, noise without colour and the `top` most frequent others named.

    points: item, x, y, label, freq. Ties of frequency go to the lesser item; the drawing itself is left to the caller.
    """
    named = points.filter("label <> -1").orderBy(F.desc("freq"), "item").limit(top).select("item", F.col("item").cast("string").alias("text"))
    return points.join(named, "item", "left").select("item", "x", "y", "label", "freq", "text")


def copy_files(spark: SparkSession, files: dict[str, str]) -> None:
    """Copies of a run's files, source to target, on any file system that Spark reads (K14); a missing source is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for source, target in files.items():
        a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
        b.getFileSystem(conf).mkdirs(b.getParent())
        jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def annotation_xml(sentences: DataFrame, corpus: str) -> DataFrame:
    """sentence_id, xml: a full-text annotation document per sentence with Target and FE layers (K8).

    Elements with bounds become labels; those with an itype only are null instantiations. Null sets and elements are
    skipped, and so is the label of a target without both bounds.
    """

    def one(r: dict) -> str:
        out = [f"<sentence ID={quoteattr(str(r['sentence_id']))} corpus={quoteattr(corpus)}>", f"<text>{escape(r['text'] or '')}</text>"]
        for a in r["annotationSets"] if r["annotationSets"] is not None else []:
            if a is None:
                continue
            out.append(f"<annotationSet ID={quoteattr(str(a['id']))} frameName={quoteattr(a['frameName'] or '')} luName={quoteattr(a['luName'] or '')}>")
            t = a["target"]
            if t is not None and t["start"] is not None and t["end"] is not None:
                out.append(f"<layer name=\"Target\"><label name=\"Target\" start=\"{int(t['start'])}\" end=\"{int(t['end'])}\"/></layer>")
            out.append('<layer name="FE">')
            for f in a["FEs"] if a["FEs"] is not None else []:
                if f is not None and f["name"]:
                    place = f"start=\"{int(f['start'])}\" end=\"{int(f['end'])}\"" if f["start"] is not None and f["end"] is not None else f"itype={quoteattr(f['itype'] or '')}"
                    out.append(f"<label name={quoteattr(f['name'])} {place}/>")
            out.append("</layer></annotationSet>")
        return "".join(out) + "</sentence>"

    def run(batches: Iterator[object]) -> Iterator[object]:
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            yield pa.record_batch([pa.array([r["sentence_id"] for r in rows], pa.int64()), pa.array([one(r) for r in rows], pa.string())], names=["sentence_id", "xml"])

    return sentences.select("sentence_id", "text", "annotationSets").mapInArrow(run, "sentence_id bigint, xml string")


def markdown_table(rows: pd.DataFrame) -> str:
    """A small result as a Markdown table."""
    esc = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(map(esc, rows.columns)) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(esc, r)) + " |" for r in rows.itertuples(index=False)])


def html_table(rows: pd.DataFrame, title: str) -> str:
    """A small result as a static page (K9)."""
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>" + rows.to_html(index=False, escape=True, border=0)


def write_back(cache: DataFrame, fresh: DataFrame, key: str, path: str) -> None:
    """The cache with the rows of fresh that it lacks, written to a new folder, so that a failure leaves the old one."""
    cache.unionByName(fresh.join(cache.select(key), key, "left_anti")).write.mode("errorifexists").parquet(path)
