"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.text import ROW_ID


def write_csv(frame: DataFrame, path: str, *, one_file: bool = True) -> None:
    """A header and the rows in their order, without the row ids; one_file for tables that people open."""
    if ROW_ID in frame.columns:
        frame = frame.orderBy(ROW_ID).drop(ROW_ID)
    flat = frame.select([F.to_json(c).alias(c) if k.startswith(("array", "map", "struct")) else F.col(f"`{c}`") for c, k in frame.dtypes])
    (flat.coalesce(1) if one_file else flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)
