"""Job state from an event log: rows of job, ``seq``, ``event`` and what the event is about.

Terminal states are final: the first terminal event of a job decides, whatever comes after it. Candidate events are replayed per job in
order of ``seq``; a claim holds for ``lease_ms`` and then may be taken by another owner.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# States that don't change any more, and how long a claim holds.
TERMINAL = ("failed", "canceled", "completed")
LEASE_MS = 75_000


def is_terminal(status: Column) -> Column:
    return F.coalesce(status.isin(*TERMINAL), F.lit(False))


def final_status(events: DataFrame, job: str, status: Column, seq: Column) -> DataFrame:
    """The first terminal status of each job, else its latest; an aggregation in one pass."""
    first = F.min_by(F.when(is_terminal(status), status), F.when(is_terminal(status), seq))
    return events.groupBy(job).agg(F.coalesce(first, F.max_by(status, seq)).alias("status"), F.count(F.lit(1)).alias("n_events"))


def rollup(work: DataFrame, job: str, status: Column, total: Column) -> DataFrame:
    """A job failed if any candidate did, is completed if all of them are, else processing; and capped progress."""
    done = F.count(F.when(status == "completed", 1))
    state = F.when(F.max((status == "failed").cast("int")) == 1, "failed").when(done >= F.max(total), "completed").otherwise("processing")
    return work.groupBy(job).agg(state.alias("status"), F.least(done, F.max(total)).alias("processed"), F.max(total).alias("total"))


def claims(events: DataFrame, job: str, item: str, owner: str, ms: str, seq: str, lease_ms: int = LEASE_MS) -> DataFrame:
    """Claim attempts with ``granted``, ``attempt`` and ``expires``: an item is granted to an owner that holds it, or if its claim has expired.

    Attempts are dealt by item and replayed in order; what is held at a time is one item's owner and expiry, however many attempts it has.
    """
    rows = events.select(F.col(job).alias("job"), F.col(item).alias("item"), F.col(seq).cast("long").alias("seq"), F.col(ms).cast("long").alias("ms"), F.col(owner).cast("string").alias("owner"))
    kinds = dict(rows.dtypes)
    schema = f"job {kinds['job']}, item {kinds['item']}, seq long, ms long, owner string, granted boolean, attempt int, expires long"
    replayed = rows.repartition("job", "item").sortWithinPartitions("job", "item", "seq").mapInPandas(lambda it: _replay_claims(it, lease_ms), schema)
    return replayed.withColumnsRenamed({"job": job, "item": item})


def _replay_claims(batches: Iterator[pd.DataFrame], lease_ms: int) -> Iterator[pd.DataFrame]:
    at, held, expires, attempt = None, None, 0, 0
    for batch in batches:
        out = []
        for key, when, who in zip(zip(batch["job"], batch["item"]), batch["ms"].tolist(), batch["owner"]):
            if key != at:
                at, held, expires, attempt = key, None, 0, 0
            granted = held is None or held == who or expires <= when
            if granted:
                held, expires, attempt = who, when + lease_ms, attempt + 1
            out.append((granted, attempt, expires))
        yield batch.assign(**dict(zip(("granted", "attempt", "expires"), zip(*out))) if out else {"granted": [], "attempt": [], "expires": []})


class _Job:
    """One job's items while its events are replayed: the queue, the claims by item and what is done."""

    def __init__(self, n_items: int):
        self.queue, self.held = deque(range(n_items)), {}
        self.n_items, self.done, self.status = n_items, 0, "processing"
        self.closed: set[int] = set()

    def claim(self, who: str, when: int, lease_ms: int) -> int | None:
        """The item that ``who`` holds already, else one whose claim has expired, else the head of the queue."""
        held = sorted((until, item) for item, (_, until) in self.held.items())
        mine = next((item for _, item in held if self.held[item][0] == who), None)
        late = held[0][1] if held and held[0][0] <= when else None
        item = mine if mine is not None else late if late is not None else self.queue.popleft() if self.queue else None
        if item is not None:
            self.held[item] = (who, when + lease_ms)
        return item

    def settle(self, kind: str, who: str, item: int) -> bool:
        """Complete, requeue or fail an item; only its owner may."""
        if self.held.get(item, (None, 0))[0] != who:
            return False
        del self.held[item]
        if kind == "requeue":
            self.queue.append(item)
        elif kind == "fail":
            self.status = "failed"
        else:
            self.closed.add(item)
            self.done = min(self.done + 1, self.n_items)
            self.status = "completed" if self.done >= self.n_items else "processing"
        return True


def transitions(events: DataFrame, job: str = "job", lease_ms: int = LEASE_MS) -> DataFrame:
    """job, seq, kind, item, updated, done, status after each event.

    ``events`` has the job, n_items, seq, ms, kind (claim, complete, requeue, fail, cancel), owner and item (of a claim: not read). Once a job is completed, failed
    or canceled nothing changes it. Events are dealt by job and replayed in order; what is held at a time is one job's items.
    """
    rows = events.select(F.col(job).alias("job"), F.col("n_items").cast("int").alias("n_items"), F.col("seq").cast("long").alias("seq"), F.col("ms").cast("long").alias("ms"), "kind", "owner", F.coalesce(F.col("item"), F.lit(-1)).cast("int").alias("item"))
    schema = f"job {dict(rows.dtypes)['job']}, seq long, kind string, item int, updated boolean, done int, status string"
    return rows.repartition("job").sortWithinPartitions("job", "seq").mapInPandas(lambda it: _replay_jobs(it, lease_ms), schema).withColumnRenamed("job", job)


def _replay_jobs(batches: Iterator[pd.DataFrame], lease_ms: int) -> Iterator[pd.DataFrame]:
    at, state = None, None
    for batch in batches:
        out = []
        for name, n_items, seq, ms, kind, who, item in batch.itertuples(index=False):
            if state is None or name != at:
                at, state = name, _Job(int(n_items))
            updated, taken = False, int(item)
            if state.status in TERMINAL:
                taken = None if kind == "claim" else taken
            elif kind == "claim":
                taken = state.claim(who, int(ms), lease_ms)
                updated = taken is not None
            elif kind == "cancel":
                state.status, updated = "canceled", True
            else:
                updated = state.settle(kind, who, taken)
            out.append((name, seq, kind, taken if taken is None or taken >= 0 else None, updated, state.done, state.status))
        frame = pd.DataFrame(out, columns=["job", "seq", "kind", "item", "updated", "done", "status"])
        frame["item"] = frame["item"].astype("Int32")
        yield frame


def admitted(events: DataFrame, key: str, group: str, order: list[Column], most: int, at: str | None = None, deadline: Column | None = None) -> DataFrame:
    """The first publication of each key, at most ``most`` in a group; of those before the ``deadline`` of their row, if one is given.

    What is late (or has no time or no deadline) takes no place.
    """
    timely = events if deadline is None else events.where(F.col(at) < deadline)
    w = Window.partitionBy(key).orderBy(*order)
    first = timely.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def paced(requests: DataFrame, keys: list[str], at: str, gap: int, out: str) -> DataFrame:
    """Earliest starts of requests that keep ``gap`` apart: the largest of at_j + (i - j) * gap over the requests j up to i."""
    w = Window.partitionBy(*keys).orderBy(at)
    numbered = requests.withColumn("_i", F.row_number().over(w))
    return numbered.withColumn(out, F.max(F.col(at) - F.col("_i") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i") * gap).drop("_i")


def recovery_plan(status: Column, delivered: Column, stopped: Column, age_s: Column, least_age_s: int = 300) -> Column:
    """struct(ok, reason): whether a stalled delivery may be recovered."""
    reason = F.when(is_terminal(status), "already terminal").when(~F.coalesce(stopped, F.lit(False)), "still running").when(F.coalesce(delivered, F.lit(0)) > 0, "delivered").when(age_s < least_age_s, "too recent")
    return F.struct(reason.isNull().alias("ok"), F.coalesce(reason, F.lit("stalled")).alias("reason"))


def backoff_ms(n: Column, base: int = 2_000) -> Column:
    return (F.lit(base) * F.pow(F.lit(2), n)).cast("long")


def retry_delay_s(n: Column) -> Column:
    return 5 + F.least(F.lit(20), 5 * n)


def pool_slot(seq: Column, size: int) -> Column:
    """Workers of a pool in turn."""
    return F.pmod(seq, F.lit(size))


def worker_count(n_items: Column, most: int = 10) -> Column:
    return F.least(n_items, F.lit(most))


def hands_off(n_refusals: Column, most: int = 2) -> Column:
    """Whether a refused job is handed on once more."""
    return n_refusals < most


def work_items(jobs: DataFrame, job: str, items: str) -> DataFrame:
    """One queued row per item of each job, in order: job, item, place, status, attempts."""
    return jobs.select(job, F.posexplode(items).alias("place", "item")).withColumns({"status": F.lit("queued"), "attempts": F.lit(0)})


def swapped_if(current: Column, expected: Column, new: Column) -> Column:
    """The new value if the current one is the expected; unset values are equal."""
    return F.when(current.eqNullSafe(expected), new).otherwise(current)
