"""Joining rows with one row of statistics per key where some keys are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.session import cut

# Rows of a key up to which one task may hold them, keys that may be broadcast as hot ones, and bytes of all
# statistics up to which they are broadcast whole.
KEY_ROWS, HOT_KEYS, BROADCAST_BYTES = 1 << 22, 1 << 16, 16 << 20


def join_stats(rows: DataFrame, stats: DataFrame, key: str, weight: str, spread_by: str, slices: int = 256, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows with the other columns of stats (one row per key, not null), as an inner join on a string key.

    weight is the number of rows that a key has. stats is written first; where it measures no more than
    broadcast_bytes it is broadcast and rows aren't shuffled. Beyond that, keys of more than one slices-th of all rows
    or more than KEY_ROWS rows (HOT_KEYS of them at most) are broadcast. The remaining keys meet their rows by
    shuffle; rows whose key was broadcast take part in it under a key of their own, spread by the hash of spread_by,
    so no task gets a hot key's rows. What is left of skew adaptive execution may split, as both sides are plain
    shuffles. Rows with a null key are dropped.
    """
    stats = cut(stats, "stats")
    names = [c for c in stats.columns if c != key]
    kinds = dict(stats.dtypes)
    nested = [c for c in names if "<" in kinds[c]]  # measured as text; other values take eight bytes
    wide = F.max(F.length(F.to_json(F.struct(*nested)))) if nested else F.lit(0)
    total, largest, rest, keys = stats.agg(F.sum(weight), F.max(F.octet_length(key)), wide, F.count("*")).first()
    if keys * ((largest or 0) + (rest or 0) + 16 + 8 * len(names)) <= broadcast_bytes:
        return rows.join(F.broadcast(stats), key).select(*rows.columns, *names)
    least = max(min(total // slices, KEY_ROWS), total // HOT_KEYS)
    hot = stats.filter(F.col(weight) > least).select(key, F.struct(*names).alias("_hot"))
    cold = stats.select(F.concat(F.lit("k"), F.col(key)).alias("_key"), F.struct(*names).alias("_cold"))
    own = F.when(F.col("_hot").isNull(), F.concat(F.lit("k"), F.col(key))).otherwise(F.concat(F.lit("h"), F.pmod(F.xxhash64(key, spread_by), F.lit(1 << 20)).cast("string")))
    met = rows.join(F.broadcast(hot), key, "left").withColumn("_key", own).join(cold, "_key", "left")
    out = met.withColumn("_s", F.coalesce("_hot", "_cold")).filter("_s IS NOT NULL")
    return out.select(*rows.columns, *[F.col(f"_s.{c}").alias(c) for c in names])
