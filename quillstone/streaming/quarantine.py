"""Rules and fitted repairs on a stream: the same functions, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from quillstone.operators.rules import Rule, validate


def quarantine(stream: DataFrame, rules: list[Rule], valid: str, rejected: str, checkpoint: str, repair: Callable[[DataFrame], DataFrame] | None = None) -> DataStreamWriter:
    """A writer that puts valid rows (after repair) and rejected ones with their reasons into Parquet folders.

    Each micro-batch writes to a folder of its own id, overwritten if the batch is
    tried again, so a lost executor or a restart gives no row twice. unique is checked
    within a micro-batch.
    """

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        found = validate(batch, rules)
        good = repair(found.valid) if repair else found.valid
        good.write.mode("overwrite").parquet(f"{valid}/batch={number}")
        found.rejected.write.mode("overwrite").parquet(f"{rejected}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
