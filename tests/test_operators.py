"""Keyed, layout, job and streaming operators against plain versions; nulls, ties and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from carafe.operators import jobs, keyed, layout
from carafe.operators.ranking import in_budget
from carafe.streaming import job_status


def test_a_reset_is_carried_forward(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "RESET"), (1, 4, None)], "k int, pos int, v string")
    marker = F.col("v").isNotNull()
    out = keyed.carried_forward(df, ["k"], F.col("pos"), marker, F.when(F.col("v") != "RESET", F.col("v")), "now")
    assert [r["now"] for r in out.orderBy("pos").collect()] == ["a", "a", None, None]


def test_unpriced_twins_go_and_nulls_equal_nulls(spark):
    df = spark.createDataFrame([(None, "a", None), (None, "a", "$5"), ("s", "a", None), ("s", "b", None)], "section string, name string, price string")
    out = keyed.without_priceless_twins(df, ["section", "name"], "price")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(None, "a", "$5"), ("s", "a", None), ("s", "b", None)], key=repr)


def test_the_kept_row_depends_on_the_order(spark):
    rows = [(1, 1, 3, 0.5, "a"), (1, 2, 1, 0.9, "b"), (2, 1, 1, 0.9, "a"), (2, 2, 3, 0.5, "b")]
    df = spark.createDataFrame(rows, "k int, pos int, rank int, score double, p string")
    out = {r["k"]: (r["payload"], r["score"]) for r in keyed.ordered_fold_best(df, ["k"], F.col("pos"), F.col("rank"), F.col("score"), F.col("p")).collect()}
    assert out == {1: ("a", 0.5), 2: ("b", 0.9)}


def test_claims_as_a_plain_replay(spark):
    rng = random.Random(1)
    events = [(rng.randint(0, 3), rng.randint(0, 2), rng.choice("ab"), ms * 10, ms) for ms in range(400)]
    df = spark.createDataFrame(events, "job int, item int, owner string, ms long, seq long")
    held, want = {}, set()
    for job, item, owner, ms, seq in events:
        who, until, n = held.get((job, item), (None, 0, 0))
        granted = who is None or who == owner or until <= ms
        if granted:
            held[job, item] = (owner, ms + 150, n + 1)
        _, until, n = held[job, item]
        want.add((job, item, seq, granted, n, until))
    got = {(r["job"], r["item"], r["seq"], r["granted"], r["attempt"], r["expires"]) for r in jobs.claims(df, "job", "item", "owner", "ms", "seq", 150).collect()}
    assert got == want


def test_paced_starts_as_a_plain_replay(spark):
    at, want, last = [0, 1, 2, 50, 51, 200], [], None
    for t in at:
        last = t if last is None else max(t, last + 10)
        want.append(last)
    out = jobs.paced(spark.createDataFrame([(1, t) for t in at], "k int, t long"), ["k"], "t", 10, "start")
    assert [r["start"] for r in out.orderBy("t").collect()] == want


def test_upper_median_of_even_counts(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (2, None), (3, None)], "k int, x double")
    assert {tuple(r) for r in layout.upper_median(df, ["k"], "x").collect()} == {(1, 2.0), (2, 3.0)}


def test_gutter_is_found_in_spite_of_outliers(spark):
    rows = [(1, float(y), 100 + 0.05 * y) for y in range(0, 200, 10)] + [(1, 5.0, 400.0)]
    r = layout.gutter(spark.createDataFrame(rows, "page int, y double, x double"), ["page"], "y", "x", 60.0, 20.0).first()
    assert r["slope"] == pytest.approx(0.05) and r["intercept"] == pytest.approx(100)


def test_recognised_words(spark, tmp_path):
    from carafe import sources

    rows = ["level\tpage_num\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext", "5\t1\t1\t1\t1\t2\t60\t10\t30\t9\t90.5\tNoir", "5\t1\t1\t1\t1\t1\t10\t10\t40\t9\t91\tPinot", "5\t1\t1\t1\t1\t3\t99\t12\t9\t9\t3\t~", "5\t1\t1\t1\t1\t4\t120\t12\t9\t9\t3\t$45", "4\t1\t1\t1\t1\t0\t0\t0\t9\t9\t-1\t"]
    (tmp_path / "a.tsv").write_text("\n".join(rows))
    out = layout.lines(layout.usable_words(sources.recognised_words(spark, str(tmp_path)))).collect()
    assert [(r["text"], r["left"], r["top"], r["bottom"]) for r in out] == [("Pinot Noir $45", 10, 10, 21)]


def test_budget_and_unpriced_rows(spark):
    df = spark.createDataFrame([("$5",), ("$50",), (None,), ("x",)], "price string")
    assert in_budget(df, 10.0, True).count() == 3 and in_budget(df, 10.0, False).count() == 1 and in_budget(df, None, False).count() == 2


def test_a_terminal_status_stays_in_the_stream(spark, tmp_path):
    first = [("j", 1, "queued"), ("j", 2, "completed"), ("k", 1, "processing")]
    second = [("j", 3, "failed"), ("k", 2, "failed"), ("k", 3, "completed")]
    schema = "job_id string, seq long, status string"
    query = job_status(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))) if (tmp_path / "in").mkdir() is None else None
    run = query.writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        for batch in (first, second):
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            run.processAllAvailable()
    finally:
        run.stop()
    rows = spark.sql("SELECT job_id, status, n_events FROM states").collect()
    last = {}
    for r in rows:
        if r["n_events"] >= last.get(r["job_id"], (None, 0))[1]:
            last[r["job_id"]] = (r["status"], r["n_events"])
    assert last == {"j": ("completed", 3), "k": ("failed", 3)}


def test_lines_and_scores_of_parts_are_dealt_over_all_partitions(spark, sf):
    """A file of parts is one task, though each row costs much."""
    from carafe.plans import QUERIES

    for name in ("line_words", "match_scores"):
        assert QUERIES[name](spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
