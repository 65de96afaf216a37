"""Recognised texts, reading order, evidence and ordered progress on worked and odd cases."""

import datetime as dt

from pyspark.sql import functions as F

from carafe.operators import evidence, layout, recognition


def test_the_best_variant_and_the_others(spark):
    menu = "RED\nRidge 'Lytton Springs' 2018 $72\nChateau Musar 2015 95"
    rows = [
        (1, 0, "xkr bdf tlmn\n" + menu), (1, 1, menu), (1, 2, "RED\nRidge"), (1, 1, "zzz later copy of variant one"),  # noise costs, a lost item costs more
        (2, 5, menu), (2, 3, menu),  # a tie: the first variant
        (3, 0, None), (3, 1, "  \n "), (4, 2, None), (4, 0, "x"),
    ]
    got = {r.page_id: r for r in recognition.best_variants(spark.createDataFrame(rows, "page_id long, variant int, text string")).collect()}
    assert (got[1].variant, got[1].text) == (1, menu) and got[1].alternates == [rows[0][2], "RED\nRidge"]
    assert got[2].variant == 3 and got[2].alternates == [menu]
    assert got[3].variant == 0 and got[3].score == float("-inf") and got[4].variant == 0 and got[4].score <= 0
    assert recognition.best_variants(spark.createDataFrame([], "page_id long, variant int, text string")).count() == 0


def test_a_line_on_a_bucket_border_stays_whole(spark):
    # 0.495 is a border of buckets of 0.015 * 33; a tilted line of four words spans 0.03
    words = [("p", "b", 0.4949, 0.2), ("p", "a", 0.4951, 0.1), ("p", "top", 0.9, 0.5), ("p", "d", 0.475, 0.4), ("p", "c", 0.485, 0.3), ("p", "below", 0.45, 0.0), ("q", "only", 0.1, 0.1), ("p", "nowhere", None, None), ("p", "lost", None, 0.3)]
    got = sorted((r.page, r.place, r.line, r.text) for r in layout.reading_lines(spark.createDataFrame(words, "page string, text string, y double, x double"), ["page"], "y", "x", 0.015, "text").collect())
    assert got == [("p", 0, 0, "top"), ("p", 1, 1, "a"), ("p", 2, 1, "b"), ("p", 3, 1, "c"), ("p", 4, 1, "d"), ("p", 5, 2, "below"), ("p", 6, 3, "nowhere"), ("p", 7, 3, "lost"), ("q", 0, 0, "only")]


T = dt.datetime(2025, 1, 1)
SHAPES = {"asked": "job_id string, message_id string", "jobs": "job_id string, status string, worker_count long, message_id string, updated_at timestamp", "workers": "job_id string, status string, message_id string", "work": "job_id string, status string, attempts int, owner string", "results": "job_id string", "letters": "message_id string, job_id string"}


def reasons(spark, **rows):
    found = evidence.stopped_evidence(**{n: spark.createDataFrame(rows.get(n, []), s) for n, s in SHAPES.items()})
    return {r.job_id: r.reason for r in evidence.recovery(found).collect()}


def test_reasons_go_in_their_order(spark):
    ids = "a b c d e f g h i j k l".split()
    jobs = [(i, "queued", 1, f"m{i}", T) for i in ids if i != "a"] + [("b", "completed", 1, "mb", T + dt.timedelta(1)), (None, "queued", 0, None, T)]
    workers = [(i, "queued", f"w{i}") for i in ids if i != "f"] + [("g", "processing", "x")]
    jobs = [(i, s, 2 if i == "g" else n, m, t) for i, s, n, m, t in jobs]
    got = reasons(
        spark, asked=[(i, f"m{i}") for i in ids if i != "i"] + [("i", "unknown")], jobs=jobs, workers=workers,
        work=[("d", "queued", 0, "w1"), ("e", "failed", 0, None), ("h", "queued", 2, None), ("l", "queued", 0, None), (None, "failed", 1, "x")], results=[("c",), ("c",)],
        letters=[("mk", "other"), ("ml", "l"), ("ml", "other"), ("unknown", "i"), (None, "a")],
    )
    assert got == {"a": "no record", "b": "already ended", "c": "has results", "d": "leased", "e": "has progress", "f": "workers missing", "g": "worker started", "h": "work started", "i": "other message", "j": "may still be delivered", "k": "letter of another job", "l": None}
    assert reasons(spark) == {}


def test_letters_are_not_gathered_by_message(spark):
    """A message may have as many letters and claims as there are runs; each meets its own letter only."""
    n = 2000
    frames = {m: spark.createDataFrame([], s) for m, s in SHAPES.items()}
    every = spark.range(n).selectExpr("cast(id as string) as job_id", "'other' as message_id")
    frames |= {"asked": every, "letters": every.where("job_id % 2 = 0").unionByName(every.where("job_id % 4 = 0"))}
    found = evidence.stopped_evidence(**frames)
    assert "collect_set(cast(job_id" not in found._jdf.queryExecution().optimizedPlan().toString().lower() and "collect_set(job_id" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert [(r.lettered, r.letter_fits, r["count"]) for r in found.groupBy("lettered", "letter_fits").count().orderBy("letter_fits").collect()] == [(True, False, n // 2), (True, True, n // 2)]


def test_stale_runs_pause(spark):
    rows = [("processing", T), ("completed", T), ("queued", T + dt.timedelta(hours=1)), ("queued", None), (None, T)]
    df = spark.createDataFrame(rows, "status string, at timestamp")
    assert [r[0] for r in df.select(evidence.polling_paused(F.col("status"), F.col("at"), F.lit(T + dt.timedelta(hours=1)), 600)).collect()] == [True, False, False, False, True]


def test_what_is_given_out_is_a_prefix(spark):
    rows = [("a", 0, 5), ("a", 1, 2), ("a", 2, 9), ("a", 1, 1), ("a", 4, 3), ("b", 1, 1), (None, 0, 1), ("c", 0, None), ("d", -1, 1), ("d", 0, 1)]
    got = {(r.job, r.place): (r.arrival, r.done, r.released) for r in evidence.released_in_order(spark.createDataFrame(rows, "job string, place long, arrival long"), "job", "place", "arrival").collect()}
    assert got == {("a", 0): (5, 3, 5), ("a", 1): (1, 1, 5), ("a", 2): (9, 4, 9), ("a", 4): (3, 2, None), ("b", 1): (1, 1, None), ("d", 0): (1, 1, 1)}
    assert evidence.released_in_order(spark.createDataFrame([], "job string, place long, arrival long"), "job", "place", "arrival").count() == 0
