"""Grapes, regions, searches, bonuses, job replay: worked cases."""

import pytest
from pyspark.sql import functions as F

from carafe.functions import identity, profile, rows
from carafe.operators import jobs


def values(spark, cases, schema, expr):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, " + schema)
    return [r.v for r in df.select("i", expr.alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "label, varietal, producer, raw, hit, want",
    [
        ("Les Pierres", "Chardonnay", "Sonoma Hill", "Sonoma Hill Les Pierres Chardonnay", "Les Pierres Chardonnay", "compatible"),
        ("Les Pierres", "Chardonnay", "Sonoma Hill", "Sonoma Hill Les Pierres Chardonnay", "Les Pierres Merlot", "conflict"),
        ("Estate", None, "Old Mill", "Old Mill Estate", "Estate Merlot", "unconstrained"),
        ("Estate", "Merlot", "Old Mill", "Old Mill Estate Merlot", "Estate", "unknown"),
        ("Cabernet", None, "Old Mill", "Old Mill Cabernet 2018", "Cabernet Franc", "unknown"),
        ("House Blend", "Syrah", "Old Mill", "Old Mill House Blend Syrah", "Syrah Grenache", "unknown"),
        ("Rouge", "Syrah", "Hook & Ladder", "Hook & Ladder, Rouge, Syrah", "Rouge Merlot", "conflict"),
        ("Rouge", "Syrah", "Old Mill", "Old Mill Rouge, Syrah/Counoise", "Rouge Merlot", "unknown"),
        ("Blanc", None, "Syrah + Grenache", "Syrah + Grenache, Old Mill", "Rouge Grenache", "compatible"),
        ("Rouge", "Syrah", "Old Mill", "Old Mill Rouge, 60% Syrah and 40% Grenache", "Rouge Grenache", "compatible"),
        ("Rouge", "Shiraz", "Old Mill", "Old Mill Shiraz", "Syrah", "compatible"),
    ],
)
def test_grapes(spark, label, varietal, producer, raw, hit, want):
    c = F.col
    assert values(spark, [(label, varietal, producer, raw, hit)], "l string, v string, p string, r string, h string", identity.compare_grapes(c("l"), c("v"), c("p"), c("r"), c("h"))) == [want]


def test_inline_regions(spark):
    cases = {
        "Old Mill, Les Pierres, Sonoma, California 2018 / 14": "Sonoma, California",
        "Old Mill 'Les Pierres' Chardonnay Rheinhessen, Germany": "Rheinhessen, Germany",
        "Old Mill ‘Les Pierres’ Sta. Rita, U.S.": None,
        "Old Mill, Côtes du Rhône, France": "Côtes du Rhône, France",
        "Old Mill Words, Italy": None,
        "Old Mill, Pierres, Nowhere, Atlantis": None,
        "Old Mill, 12 Acres, California": None,
        "Old Mill, Pierres, Italy, Italy": None,
        "Old Mill, the old well, Italy": None,
        "": None,
    }
    assert values(spark, [(t,) for t in cases] + [(None,)], "t string", rows.inline_region(F.col("t"))) == [*cases.values(), None]


def test_searches_go_from_the_most_specific_on(spark):
    c = F.col
    plan = identity.search_plan({"raw_text": c("r"), "producer": c("p"), "label": c("l"), "region": c("g")})
    got = values(spark, [("Domaine Tempier 'La Migoua' Bandol rouge", "Domaine Tempier", "La Migoua Bandol rouge", "Bandol"), ("Riesling", None, "Riesling", None), ("Ridge Zinfandel", "Ridge", "Zinfandel", None)], "r string, p string, l string, g string", plan)
    assert got == [[["tempier", "migoua"], ["tempier"]], [], [["ridge"], ["ridge", "zinfandel"]]]


def test_a_named_cuvee_earns_a_bonus(spark):
    bonus = values(spark, [("Bocelli Alcide", "Bocelli", "Alcide"), ("Bocelli Alcide", "Bocelli", "Sangiovese Riserva Speciale Tenuta Alta Quercia"), ("Bocelli", "Bocelli", "Bocelli")], "r string, w string, n string", identity.specificity(F.col("r"), F.col("w"), F.col("n")))
    assert bonus == pytest.approx([0.025, -0.01, 0.0])


EVENTS = "job string, n_items int, seq long, ms long, kind string, owner string, item int"


def test_jobs_are_replayed_in_order(spark):
    a = [
        (1, 0, "claim", "w1", None, (0, True, 0, "processing")),
        (2, 5, "claim", "w1", None, (0, True, 0, "processing")),  # what is held already comes first
        (3, 10, "claim", "w2", None, (1, True, 0, "processing")),
        (4, 20, "complete", "w2", 0, (0, False, 0, "processing")),  # not the owner
        (5, 75_006, "claim", "w3", None, (0, True, 0, "processing")),  # expired, before the queue
        (6, 75_007, "complete", "w1", 0, (0, False, 0, "processing")),
        (7, 75_008, "requeue", "w3", 0, (0, True, 0, "processing")),
        (8, 75_009, "complete", "w2", 1, (1, True, 1, "processing")),
        (9, 75_010, "claim", "w1", None, (2, True, 1, "processing")),
        (10, 75_011, "complete", "w1", 2, (2, True, 2, "processing")),
        (11, 75_012, "claim", "w1", None, (0, True, 2, "processing")),  # from the tail
        (12, 75_013, "complete", "w1", 0, (0, True, 3, "completed")),
        (13, 75_014, "claim", "w1", None, (None, False, 3, "completed")),
        (14, 75_015, "fail", "w1", 0, (0, False, 3, "completed")),
    ]
    b = [(1, 0, "claim", "w1", None, (0, True, 0, "processing")), (2, 1, "fail", "w1", 0, (0, True, 0, "failed")), (3, 2, "claim", "w1", None, (None, False, 0, "failed"))]
    c = [(1, 0, "cancel", None, None, (None, True, 0, "canceled")), (2, 1, "complete", "w1", 0, (0, False, 0, "canceled"))]
    rows_ = [(job, 3, *e[:5]) for job, events in (("a", a), ("b", b), ("c", c)) for e in events]
    got = {(r.job, r.seq): (r.item, r.updated, r.done, r.status) for r in jobs.transitions(spark.createDataFrame(rows_, EVENTS)).collect()}
    assert got == {(job, e[0]): e[5] for job, events in (("a", a), ("b", b), ("c", c)) for e in events}
    assert jobs.transitions(spark.createDataFrame([], EVENTS)).count() == 0


def test_work_items_and_swaps(spark):
    df = spark.createDataFrame([("j", ["x", "y"])], "job string, items array<string>")
    assert [tuple(r) for r in jobs.work_items(df, "job", "items").orderBy("place").collect()] == [("j", 0, "x", "queued", 0), ("j", 1, "y", "queued", 0)]
    assert values(spark, [("a", "a"), ("a", "b"), (None, None)], "c string, e string", jobs.swapped_if(F.col("c"), F.col("e"), F.lit("new"))) == ["new", "a", "new"]


def test_filled_candidates_keep_what_they_have(spark):
    got = profile.filled(spark.createDataFrame([(1, "x")], "candidate_id int, label string"))
    assert got.first().asDict() == {"candidate_id": 1, "label": "x"} | {k: None for k in profile.CANDIDATE_FIELDS if k != "label"}


def test_qualities_at_half_a_hundredth_are_those_of_the_sql(spark):
    """Sums that end at half a hundredth depend on the order of their terms; that of the SQL holds."""
    import duckdb

    from carafe.functions import quality
    from carafe.plans import lines

    texts = ["hello, a12345", "hello, abe 1234", "large, o12345", "new ring, new ring", "Cabernet Sauvignon, red, Italy, red xkr bdf tlmn Tradición Rhône hot widget Rosé de new éclat new anvil 2024 Oregon & old"]
    source = "l AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}')" for t in texts) + ") AS v(line))"
    want = sorted(duckdb.connect().execute(lines._quality_sql(source, "line")).fetchall())
    got = spark.createDataFrame([(t,) for t in texts], "line string").select("line", quality.qualities(F.col("line")).alias("q")).select("line", "q.quality", "q.notes_quality").collect()
    assert sorted(tuple(r) for r in got) == want
