"""One row per record: rows sent again are counted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_per_id(df: DataFrame, id_col: str, *cols: str | Column) -> DataFrame:
    """Keep one row per id, of the columns named (all if none).

    The row with the latest loaded_at is kept where that column exists; otherwise any of the copies, which are
    alike but for loaded_at. Rows with a null id mark no record and are dropped. An empty table gives an empty one.
    """
    keep = [F.col(id_col), *[c if isinstance(c, Column) else F.col(c) for c in cols]] if cols else [F.col(f"`{c}`") for c in df.columns]
    rows = df.filter(F.col(id_col).isNotNull())
    if "loaded_at" not in df.columns:
        return rows.select(*keep).dropDuplicates([id_col])
    packed = rows.select(F.col(id_col).alias("_id"), F.coalesce(F.col("loaded_at"), F.lit("1900-01-01").cast("timestamp")).alias("_at"), F.struct(*keep).alias("_row"))
    return packed.groupBy("_id").agg(F.max_by("_row", "_at").alias("_row")).select("_row.*")
