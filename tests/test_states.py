"""Streams with states that end: against the batch operator, with late and shuffled events."""

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F

from carafe.operators.jobs import final_status
from carafe.streaming import states

START = dt.datetime(2025, 3, 1)
HOUR = dt.timedelta(hours=1)


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def run(spark, tmp_path, schema, batches, build):
    """Rows that the stream gives, by batch, and the rows of state after each."""
    source, out, sizes = tmp_path / "in", [], []
    source.mkdir()
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
    query = None
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"made{k}"))
        part = next((tmp_path / f"made{k}").glob("*.parquet"))
        shutil.move(part, source / f"{k:03}.parquet")
        got = []
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "check")).outputMode(MODE.get(build, "append")).foreachBatch(lambda df, _, got=got: got.extend(tuple(r) for r in df.collect())).trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
        out.append(sorted(got, key=repr))
        sizes.append(sum(s["numRowsTotal"] for s in (query.lastProgress or {"stateOperators": []})["stateOperators"]))
    return out, sizes


MODE = {states.expiring_job_status: "update"}


def test_job_states_end_and_equal_the_batch_before(spark, tmp_path):
    schema = "job_id string, seq long, status string, at timestamp"
    first = [("a", 1, "queued", START), ("a", 3, "completed", START + HOUR), ("b", 1, "queued", START), ("n", 1, "failed", None)]
    second = [("a", 2, "processing", START + 2 * HOUR), ("a", 4, "failed", START + 2 * HOUR), ("b", 2, "processing", START + 2 * HOUR)]
    third = [("c", 1, "queued", START + 40 * HOUR)]  # the watermark passes the ends of a and b
    fourth = [("b", 3, "completed", START + 2 * HOUR), ("a", 9, "processing", START + 41 * HOUR)]  # late; and anew
    fifth = [("d", 1, "queued", START + 42 * HOUR)]
    got, sizes = run(spark, tmp_path, schema, [first, second, third, fourth, fifth], states.expiring_job_status)
    assert got[0] == [("a", "completed", 2), ("b", "queued", 1)]
    so_far = spark.createDataFrame([r for r in first + second if r[3]], schema)
    batch = {tuple(r) for r in final_status(so_far, "job_id", F.col("status"), F.col("seq")).collect()}
    assert set(got[1]) == batch == {("a", "completed", 4), ("b", "processing", 2)}
    assert got[2] == [("c", "queued", 1)]
    assert got[3] == [("a", "processing", 1)]  # b's event was late, and a's old state is gone
    assert sizes == [4, 4, 2, 4, 6]  # a value and a time a job; only c is left after the third batch


def test_matches_are_remembered_for_their_days(spark, tmp_path):
    schema = "key string, id long, value string, at timestamp"
    day = dt.timedelta(days=1)
    batches = [
        [("k", 1, None, START), ("m", 2, "x", START)],  # a miss isn't remembered
        [("k", 3, "w7", START + day), ("m", 4, "other", START + day)],
        [("k", 5, "w8", START + 20 * day), ("k", 6, None, START + 21 * day)],
        [("k", 7, "w9", START + 31 * day)],  # 30 days after the write it is forgotten
        [("k", 8, None, START + 40 * day), ("m", 9, None, START + 40 * day)],
    ]
    got, _ = run(spark, tmp_path, schema, batches, states.remembered_matches)
    said = {i: (v, r) for rows in got for _, i, v, r in rows}
    assert said == {1: (None, False), 2: ("x", False), 3: ("w7", False), 4: ("x", True), 5: ("w7", True), 6: ("w7", True), 7: ("w9", False), 8: ("w9", True), 9: (None, False)}


def test_results_come_in_order_whatever_order_they_arrive_in(spark, tmp_path):
    schema = "job_id string, place long, result string, at timestamp"
    rows = [(job, i, f"{job}{i}", START + dt.timedelta(minutes=i)) for job in "ab" for i in range(12)]
    random.Random(2).shuffle(rows)
    rows += [rows[0][:2] + ("again", START)]
    cuts = [rows[k : k + 6] for k in range(0, len(rows), 6)]
    got, _ = run(spark, tmp_path, schema, cuts, lambda df: states.in_order(df, late="2 hours"))
    for job in "ab":
        given, arrived = [], set()
        for batch, out in zip(cuts, got):
            arrived |= {r[1] for r in batch if r[0] == job}
            given += sorted((r for r in out if r[0] == job), key=lambda r: r[1])
            # exactly the places up to the first that is missing
            assert [r[1] for r in given] == list(range(next(i for i in range(13) if i not in arrived)))
        assert [r[2] for r in given] == [f"{job}{i}" for i in range(12)] and [r[3] for r in given] == list(range(1, 13))
