"""Incremental upkeep of a corpus by Structured Streaming: each micro-batch is a merge of its keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import commits


def upsert_stream(changes: DataFrame, root: str, key: str, version: str, checkpoint: str, deleted: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Commit, after each batch, the corpus with the newest row of each key by ``version``; other keys stay.

    A batch writes the buckets that its keys are in and no others (see ``commits.merge``), one that is run again after a crash changes
    nothing, and a row older than the stored one doesn't replace it. Where the flag ``deleted`` is true the key goes.
    """

    def apply(batch: DataFrame, number: int) -> None:
        order = Window.partitionBy(key).orderBy(F.desc(version))
        newest = batch.withColumn("__nth", F.row_number().over(order)).filter("__nth = 1").drop("__nth")
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        kept = newest.filter(~gone).drop(*([deleted] if deleted else []))
        commits.merge(kept, root, key, F.current_timestamp(), deletes=newest.filter(gone).select(key), newer=version, tag=(checkpoint, number), buckets=buckets)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
