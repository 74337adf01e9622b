"""Streaming forms: a micro-batch score log and the point-in-time join of two streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.registry import append_scores


def log_scores(scores: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends a stream of scores to the log, one commit per micro-batch; restarts go on from the checkpoint."""
    w = scores.writeStream.foreachBatch(lambda batch, _: append_scores(batch, path)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 second")).start()


def window_join(leads: DataFrame, events: DataFrame, ts: str, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Events of each lead within hours of its creation, both sides streams with watermarks; state is bounded by the range."""
    s = leads.withWatermark("created_at", late).select(F.col("lead_id").alias("_lead"), "created_at")
    e = events.withWatermark(ts, late)
    return e.join(s, F.expr(f"lead_id = _lead and {ts} >= created_at and {ts} < created_at + interval {hours} hours")).drop("_lead")


def hourly_counts(events: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"), "direction").agg(F.count("*").alias("n"))
