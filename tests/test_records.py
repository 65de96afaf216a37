from datetime import datetime

from pyspark.sql import functions as F

from carafe.functions import identity, records
from carafe.operators import keyed, matching, ranking


def test_sidecars_that_are_missing_or_broken_are_structs_of_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, "{oops"), (3, "{}"), (4, '{"sourceUrl":"u","x":[1]}')], "id int, t string")
    got = {r.id: (r.s.mime_type, r.s.source_url) for r in rows.select("id", records.sidecar(F.col("t")).alias("s")).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: (None, None), 4: (None, "u")}


def test_old_tastes_shrink_and_rows_without_a_profile_stay(spark):
    text = '[{"candidateId":"a","profile":{"name":"n","taste":{"body":10,"acidity":4,"sourceMode":"direct"}}},{"candidateId":"b","profile":null}]'
    got = spark.createDataFrame([(text,)], "t string").select(records.decoded_recommendations(F.col("t")).alias("r")).first().r
    assert (got[0].profile.taste.body, got[0].profile.taste.acidity, got[0].profile.taste.tannin, got[0].profile.taste.source_mode) == (5, 4, None, "direct")
    assert got[1].candidate_id == "b" and got[1].profile is None


def test_a_region_goes_whatever_stands_between_its_words(spark):
    rows = [(1, "Château X, Côtes-du  Rhône 2019", "Cotes du Rhône"), (2, "Napavalley Napa Valley", "Napa Valley"), (3, "Plain", None), (4, None, "Napa"), (5, "A (b) c", "(B)")]
    df = spark.createDataFrame(rows, "id int, t string, r string")
    got = {r.id: r.x for r in df.select("id", identity.without_region(F.col("t"), F.col("r")).alias("x")).collect()}
    assert got == {1: "chateau x,   2019", 2: "napavalley  ", 3: "plain", 4: "", 5: "a ( ) c"}


def test_a_region_that_names_a_grape_is_no_grape_evidence(spark):
    df = spark.createDataFrame([("Estate Merlot, Pinot Hills", "Pinot Hills", "Merlot"), ("Estate Merlot, Pinot Hills", None, "Merlot")], "raw string, region string, hit string")
    none = F.lit(None).cast("string")
    got = [r.g for r in df.select(identity.compare_grapes(F.lit("Merlot"), none, none, F.col("raw"), F.col("hit"), F.col("region")).alias("g")).collect()]
    assert got == ["compatible", "unknown"]


def test_misses_are_not_remembered_and_hits_expire(spark):
    at = lambda d: datetime(2024, 1, d)
    seen = spark.createDataFrame([("a", True, at(1)), ("a", True, at(3)), ("b", False, at(2)), ("c", None, at(2)), ("d", True, at(1))], "key string, ok boolean, at timestamp")
    kept = keyed.memories(seen, "key", F.col("ok"), F.col("at"))
    assert {r.key: r.held_until for r in kept.collect()} == {"a": datetime(2024, 2, 2), "d": datetime(2024, 1, 31)}
    assert [r.key for r in keyed.held(kept, F.col("held_until"), F.lit(datetime(2024, 1, 31))).collect()] == ["a"]


def test_a_section_without_rows_shows_all(spark):
    recs = spark.createDataFrame([(1, "t", "s"), (2, "t", None), (3, None, None)], "id int, menu_tab string, menu_section string")
    ids = lambda chosen: sorted(r.id for r in ranking.in_section(recs, chosen).collect())
    assert ids("t:::s") == [1] and ids(":::") == [3] and ids("x:::y") == [1, 2, 3] and ids(None) == [1, 2, 3]
    assert ranking.in_section(recs.limit(0), "t:::s").count() == 0


def test_producers_with_every_word_of_the_cuvee(spark):
    hits = spark.createDataFrame([(1, ["giallo", "arles"], "Dom A", "Giallo d'Arles"), (1, ["giallo", "arles"], "dom a ", "Giallo Arles 2019"), (1, ["giallo", "arles"], "Dom B", "Giallo"), (2, ["amoureuses"], "C", "Les Amoureuses"), (2, ["amoureuses"], "D", "Amoureuses"), (3, ["x1"], "E", None)], "k int, cuvee array<string>, winery string, name string")
    assert {r.k: r.n_producers for r in matching.producers_with_cuvee(hits, ["k"], "cuvee").collect()} == {1: 1, 2: 2, 3: 0}
