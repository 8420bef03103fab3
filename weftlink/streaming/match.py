"""Matching a stream of records against fixed references.

Normalisation and blocking need nothing but the record and the references, so each micro-batch is blocked on its
own. Decisions that weigh all records of a reference stay with batch jobs over what was appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.query import StreamingQuery

from weftlink.operators.block import Caps, key_weights, ranked
from weftlink.operators.keys import with_keys


def match_stream(queries: DataFrame, weighed: DataFrame, path: str, checkpoint: str, top: int = 12) -> StreamingQuery:
    """Appends (batch, qid, s1, score, nk, rank) of every streamed record to Parquet under ``path``, one folder a batch: a batch that is run again replaces its own.

    ``weighed``: reference_index(). Ties go to the smaller reference.
    """
    def block(batch: DataFrame, number: int) -> None:
        keys = with_keys(batch, False).withColumnRenamed("id", "qid")
        scored = keys.join(weighed, ["country", "ty", "key"]).groupBy("qid", "s1").agg(F.sum("w").alias("score"), F.count("*").alias("nk"))
        ranked(scored, top).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(block).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reference_index(references: DataFrame, caps: Caps = Caps()) -> DataFrame:
    """(country, ty, key, s1, w) of the references' keys within their caps."""
    keys = with_keys(references, True)
    return keys.join(key_weights(keys, references, caps), ["country", "ty", "key"]).select("country", "ty", "key", F.col("id").alias("s1"), "w")
