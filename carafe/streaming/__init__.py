"""Job state over streams of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.jobs import final_status


def job_status(events: DataFrame) -> DataFrame:
    """A row per job whenever it has new events (update mode): job_id, status, n_events. ``events`` has job_id, seq and status.

    The batch operator itself, as a streaming aggregation: of several terminal events the one with the least seq counts, whatever order they
    arrive in. The state of a job is two statuses and their seqs; it stays as long as the stream's checkpoint.
    """
    return final_status(events, "job_id", F.col("status"), F.col("seq"))


def deduplicated(events: DataFrame, key: str, time: str, within: str = "24 hours") -> DataFrame:
    """The first event of each key; keys are forgotten after ``within``."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])
