"""What the stored records of a run say about it: whether a stopped run may be recovered, whether polling pauses, what can be shown in order.

Scale. All records of a job meet in one aggregation: each table gives rows of one shape, tagged by what they are, so there is one shuffle by job and counts
are reduced before it. Claims meet the letters by message and job; which messages have letters at all is a join of distinct messages, whose hot keys
adaptive execution can split. Only message ids are gathered, of which a job has one a worker.

Defined results: a job of which only other records exist is missing. Null ids are left out. Repeated records count each; of a repeated job record the latest
counts. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import is_terminal
from .keyed import best_per_key

_ROW = {"status": "string", "worker_count": "long", "updated_at": "timestamp", "message": "string", "asked": "string", "lettered": "boolean", "letter_fits": "boolean", "worker": "long", "worker_started": "long", "started": "long", "leased": "long", "done": "long", "result": "long", "record": "long"}


def _rows(df: DataFrame, job: str, **columns: Column) -> DataFrame:
    return df.where(F.col(job).isNotNull()).select(F.col(job).cast("string").alias("job_id"), *[columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in _ROW.items()])


def stopped_evidence(asked: DataFrame, jobs: DataFrame, workers: DataFrame, work: DataFrame, results: DataFrame, letters: DataFrame) -> DataFrame:
    """One row per job with its status and counts of what it has, from asked(job_id, message_id): the deliveries that may have stalled; jobs(job_id,
    status, worker_count, message_id, updated_at), workers(job_id, status, message_id), work(job_id, status, attempts, owner), results(job_id), and
    letters(message_id, job_id): deliveries that were given up."""
    c, one = F.col, F.lit(1)
    flag = lambda test: F.coalesce(test, F.lit(False)).cast("long")
    # one message may have very many letters and claims, so letters are met by message and job, never gathered by message
    given_up = letters.where(c("message_id").isNotNull()).select(c("message_id").alias("_m"), c("job_id").cast("string").alias("_of"))
    own = given_up.where(c("_of").isNotNull()).distinct().select(c("_m").alias("_own_m"), "_of")
    claims = asked.join(given_up.select("_m").distinct(), c("message_id") == c("_m"), "left")
    claims = claims.join(own, (c("message_id") == c("_own_m")) & (c("job_id").cast("string") == c("_of")), "left")
    latest = best_per_key(jobs, ["job_id"], F.struct("updated_at", "status", "message_id", "worker_count"), True)
    rows = [
        _rows(claims, "job_id", asked=c("message_id"), lettered=c("_m").isNotNull(), letter_fits=F.when(c("_m").isNotNull(), c("_of").isNotNull())),
        _rows(latest, "job_id", status=c("status"), worker_count=c("worker_count"), updated_at=c("updated_at"), message=c("message_id"), record=one),
        _rows(workers, "job_id", message=c("message_id"), worker=one, worker_started=flag(~c("status").eqNullSafe("queued"))),
        _rows(work, "job_id", started=flag(~c("status").eqNullSafe("queued") | (c("attempts") > 0) | c("owner").isNotNull()), leased=flag(c("owner").isNotNull()), done=flag(c("status").isin("completed", "failed"))),
        _rows(results, "job_id", result=one),
    ]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(rows[4])
    total = lambda n: F.coalesce(F.sum(n), F.lit(0)).alias(f"n_{n}")
    by_job = every.groupBy("job_id").agg(F.max("status").alias("status"), F.max("worker_count").alias("worker_count"), F.max("updated_at").alias("updated_at"), F.max("asked").alias("asked"), F.max("lettered").alias("lettered"), F.max("letter_fits").alias("letter_fits"), F.collect_set("message").alias("_messages"), *[total(n) for n in ("record", "worker", "worker_started", "started", "leased", "done", "result")])
    return by_job.withColumn("message_known", F.coalesce(F.array_contains("_messages", c("asked")), F.lit(False))).drop("_messages")


def recovery(evidence: DataFrame) -> DataFrame:
    """The evidence with ``reason``: why a stopped run may not be recovered, the first that holds; null if it may."""
    c = F.col
    reason = F.when(c("n_record") == 0, "no record").when(~F.coalesce(c("status").isin("queued", "processing"), F.lit(False)), "already ended").when(c("n_result") > 0, "has results").when(c("n_leased") > 0, "leased").when(c("n_done") > 0, "has progress")
    reason = reason.when(c("n_worker") != F.coalesce("worker_count", F.lit(0)), "workers missing").when(c("n_worker_started") > 0, "worker started").when(c("n_started") > 0, "work started")
    reason = reason.when(~c("message_known"), "other message").when(~F.coalesce("lettered", F.lit(False)), "may still be delivered").when(~F.coalesce("letter_fits", F.lit(False)), "letter of another job")
    return evidence.withColumn("reason", reason)


def polling_paused(status: Column, updated_at: Column, now: Column, stale_s: int = 600) -> Column:
    """A run that hasn't ended and hasn't changed for long looks stalled; without a time it doesn't."""
    return ~is_terminal(status) & F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(updated_at) >= stale_s, F.lit(False))


def released_in_order(results: DataFrame, job: str, place: str, arrival: str) -> DataFrame:
    """job, place, arrival, done, released: the first arrival of each place, how many of the job's places were done by then, and when it can be given out.

    Places count from 0, and what is given out is always a prefix: a place waits for all before it, for ever if one never comes (released is null).
    """
    first = results.where(F.col(job).isNotNull() & (F.col(place) >= 0) & F.col(arrival).isNotNull()).groupBy(job, place).agg(F.min(arrival).alias(arrival))
    by_place = Window.partitionBy(job).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.count(F.lit(1)).over(by_place) == F.col(place) + 1
    done = F.count(F.lit(1)).over(Window.partitionBy(job).orderBy(arrival).rangeBetween(Window.unboundedPreceding, 0))
    return first.select(job, place, arrival, done.alias("done"), F.when(whole, F.max(arrival).over(by_place)).alias("released"))
