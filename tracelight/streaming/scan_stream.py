"""The passage scan over arriving documents: an extension, the batch scan is the measure.

Each micro-batch of documents (doc_id, text) is matched against the passages, which do not change; hits
are deduplicated within the watermark and counted by passage and window of time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.operators.detect import shingle_keys


def matched(arriving: DataFrame, passages: DataFrame, late: str = "1 hour") -> DataFrame:
    """``item_id, doc_id, at``: each pair once, for a stream with ``doc_id, text, at``."""
    keys = shingle_keys(passages, "item_id")
    asked = shingle_keys(arriving.withWatermark("at", late), "doc_id", "at")
    return asked.join(F.broadcast(keys), "key").select("item_id", "doc_id", "at").dropDuplicatesWithinWatermark(["item_id", "doc_id"])


def counted(arriving: DataFrame, passages: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Hits by passage and window of time; late rows are counted until the watermark has passed."""
    keys = shingle_keys(passages, "item_id")
    asked = shingle_keys(arriving.withWatermark("at", late), "doc_id", "at")
    hits = asked.join(F.broadcast(keys), "key")
    return hits.groupBy(F.window("at", window), "item_id").agg(F.approx_count_distinct("doc_id").alias("documents"))
