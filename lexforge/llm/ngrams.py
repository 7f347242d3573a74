"""Counts of all terms and n-grams by suffix sorting (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.session import cut

_OUT = pa.schema([("field", pa.string()), ("ngram", pa.list_(pa.string())), ("n", pa.int64()), ("records", pa.int64())])


def stack_counts(rows: Iterator[tuple[str, int, list[str], int, list[int]]]) -> Iterator[tuple[str, list[str], int, int]]:
    """(field, n-gram, occurrences, records) of all prefixes of suffixes that come in reverse lexicographic order.

    rows: field, salt, suffix, n, records. One stack entry per term of the suffix at hand: its count and record set.
    When the next suffix leaves a prefix, the entries above it are complete; each is given out and added to the one
    below. The stack is emptied where the salt changes, so a set never holds the records of more than one salt.
    """
    path: list[str] = []
    counts: list[int] = []
    sets: list[set[int]] = []
    at = None, 0

    def leave(keep: int) -> Iterator[tuple[str, list[str], int, int]]:
        while len(path) > keep:
            yield at[0], path[:], counts[-1], len(sets[-1])
            path.pop()
            n, s = counts.pop(), sets.pop()
            if path:
                counts[-1] += n
                if len(sets[-1]) < len(s):
                    sets[-1], s = s, sets[-1]
                sets[-1] |= s

    for field, salt, suffix, n, records in rows:
        keep = 0
        if (field, salt) == at:
            while keep < len(path) and keep < len(suffix) and path[keep] == suffix[keep]:
                keep += 1
        yield from leave(keep)
        at = field, salt
        for term in suffix[keep:]:
            path.append(term)
            counts.append(0)
            sets.append(set())
        counts[-1] += n
        sets[-1].update(records)
    yield from leave(0)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*[c.to_pylist() for c in b.columns], strict=True)

    cols: list[list] = [[], [], [], []]
    for row in stack_counts(rows()):
        for c, v in zip(cols, row, strict=True):
            c.append(v)
        if len(cols[0]) >= 20_000:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)
            cols = [[], [], [], []]
    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)


SALT_ROWS, HOT_TERMS = 200_000, 1 << 16


def suffix_counts(sequences: DataFrame, max_n: int = 3, salt_rows: int = SALT_ROWS) -> DataFrame:
    """field, ngram ARRAY<STRING>, n (occurrences), records (distinct): of every n-gram of up to max_n terms.

    sequences has field, record_id (one row per record and field) and terms ARRAY<STRING>; a null term ends a run,
    no n-gram spans it. Null and empty arrays count nothing. A first term that begins more than salt_rows suffixes is
    routed by the hash of the record into parts of about that many; a part's record sets are disjoint from those of
    others, so their counts add up. Where more than HOT_TERMS first terms could be hot, parts are larger instead,
    which bounds what is broadcast.

    sequences is written once, as it is read for the first terms and for the suffixes. Equal suffixes are gathered
    with their records before the rows are routed by first term and sorted.
    """
    rows = cut(sequences.filter(F.size("terms") > 0).select("field", "record_id", "terms"), "sequences")
    by_first = cut(rows.select("field", F.explode("terms").alias("first")).filter("first IS NOT NULL").groupBy("field", "first").agg(F.count("*").alias("_n")), "terms")
    part = max(salt_rows, (by_first.agg(F.sum("_n")).first()[0] or 0) // HOT_TERMS)
    hot = by_first.filter(F.col("_n") > part).select("field", "first", F.ceil(F.col("_n") / part).cast("int").alias("_salts"))
    starts = F.expr(f"transform(sequence(1, size(terms)), i -> slice(terms, i, {max_n}))")
    whole = F.expr("CASE WHEN exists(s, x -> x IS NULL) THEN slice(s, 1, int(array_position(transform(s, x -> x IS NULL), true)) - 1) ELSE s END")
    suffixes = rows.select("field", "record_id", F.explode(starts).alias("s")).filter("s[0] IS NOT NULL").select("field", F.col("s")[0].alias("first"), "record_id", whole.alias("suffix"))
    routed = suffixes.join(F.broadcast(hot), ["field", "first"], "left").withColumn("_salt", F.pmod(F.xxhash64("record_id"), F.coalesce("_salts", F.lit(1))).cast("int"))
    gathered = routed.groupBy("field", "first", "_salt", "suffix").agg(F.count("*").alias("n"), F.collect_set("record_id").alias("records"))
    ordered = gathered.repartition("field", "first", "_salt").sortWithinPartitions("field", "first", "_salt", F.col("suffix").desc())
    counted = ordered.select("field", "_salt", "suffix", "n", "records").mapInArrow(_run, "field string, ngram array<string>, n bigint, records bigint")
    return counted.groupBy("field", "ngram").agg(F.sum("n").alias("n"), F.sum("records").alias("records"))
