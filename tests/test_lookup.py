"""The catalogue lookup on worked cases: vintages, cuvées of several makers, guesses, early end, and odd tables."""

import pytest

from carafe.operators import matching

MENU = "candidate_id long, raw_text string, producer string, label string, menu_section string, varietal string, vintage int"
WINES = "wine_id long, winery string, name string, region string, year int, retail_price double"


@pytest.fixture(scope="module")
def found(spark):
    menu = [
        (1, "Bocelli Alcide 2015", "Bocelli", "Alcide", "Red", None, 2015),
        (2, "Nothing here", "Nothing", "here", "Red", None, None),
        (3, "Amoureuses Chambolle", None, "Amoureuses Chambolle", None, None, None),  # two makers have it
        (4, "Giallo Arles", None, "Giallo Arles", None, None, None),  # one has
        (5, "Roumier", "Roumier", None, None, None, None),  # several appellations of one maker
        (6, "Bocelli Alcide bianco", "Bocelli", "Alcide bianco", None, None, None),  # the entry is red
        (7, "Ridge 'Lytton Springs' 2018", "Ridge", "Lytton Springs", None, None, 2018),
        (8, "Nobody", "Nobody", "Nothing", None, None, None),
        (None, None, None, None, None, None, None),
    ]
    wines = [
        (10, "Bocelli", "Alcide Rosso 2014", "Toscana", 2014, 20.0), (10, "Bocelli", "Alcide Rosso 2015", "Toscana", 2015, 21.0), (10, "Bocelli", "Alcide Rosso 2015", "Toscana", 2015, 21.0), (11, "Bocelli", "Sangiovese 2015", "Toscana", 2015, 9.0),
        (20, "Groffier", "Amoureuses Chambolle", "Burgundy", 2018, 90.0), (21, "Vogüé", "Amoureuses Chambolle", "Burgundy", 2018, 95.0), (22, "Quintodecimo", "Giallo Arles", "Campania", 2019, 30.0),
        (30, "Roumier", "Bonnes Mares", "Bonnes Mares", 2017, 99.0), (31, "Roumier", "Clos Denis", "Clos Denis", 2017, 98.0), (40, None, None, None, None, None),
        (50, "Ridge", "Lytton Springs", "Dry Creek Valley", 2018, 40.0), (51, "Ridge", "Geyserville", None, None, None), (12, "Other", "Alcide", "Toscana", 2015, 5.0),
    ]
    menu, wines = spark.createDataFrame(menu, MENU), spark.createDataFrame(wines, WINES)
    best = {r.candidate_id: r for r in matching.best_hits(menu, wines).collect()}
    return best, {r.candidate_id: r for r in matching.lookup(menu, wines, limit=2).collect()}


def test_the_asked_vintage_is_kept_and_shown(found):
    best, profiles = found
    assert best[1].wine_id == 10 and best[1].vintage == "exact" and best[1].status != "unmatched"
    assert (profiles[1].display_name, profiles[1].vintage, profiles[1].retail_price, profiles[1].label) == ("Bocelli Alcide Rosso 2015", 2015, 21.0, "Alcide Rosso 2015")


def test_a_cuvee_of_two_makers_is_no_match(found):
    best, profiles = found
    assert best[3].wine_id is None and 3 not in profiles
    assert profiles[4].wine_id == 22 and profiles[4].producer == "Quintodecimo" and profiles[4].vintage is None


def test_a_guess_among_siblings_is_capped(found):
    best, profiles = found
    assert best[5].wine_id in (30, 31) and best[5].identity == pytest.approx(0.58) and 5 not in profiles


def test_colours_rows_without_hits_and_nulls(found):
    best, profiles = found
    assert best[6].wine_id is None and best[2].wine_id is None and best[2].status == "unmatched" and set(best) == {*range(1, 9), None}
    assert (best[7].wine_id, best[7].status) == (50, "matched") and (best[8].wine_id, best[8].status) == (None, "unmatched")
    assert set(profiles) == {1, 4, 7}


def test_later_searches_count_only_without_a_sure_hit(spark):
    """Hits of a second search are left out once the first one has found a decisive hit."""
    judged = "struct<score:double,without_producer:boolean,cuvee:array<string>,appellation_guess:boolean>"
    hit = "struct<winery:string,name:string,region:string,year:int>"
    row = lambda c, plan, wine, rank, score, alone=False, year=2000: (c, plan, wine, ("w", f"n{plan}", "r", year), rank, (score, alone, [], False))
    rows = [row(1, 0, 7, 1, 0.9), row(1, 1, 8, 3, 0.95), row(2, 0, 7, 1, 0.7), row(2, 1, 8, 3, 0.8), row(3, 0, 7, 1, 0.76, True), row(3, 1, 8, 3, 0.99), row(4, 0, 7, 0, 0.8), row(4, 0, 7, 3, 0.7, year=2001), row(4, 2, 7, 2, 0.84)]
    scored = spark.createDataFrame(rows, f"candidate_id long, plan int, wine_id long, hit {hit}, rank int, judged {judged}")
    got = sorted((r.candidate_id, r.wine_id, r.hit.name, r.hit.year, r.judged.score) for r in matching._kept(scored).collect())
    # the exact vintage replaces the better score's entry and keeps that score; what comes later at a lower rank is nothing new
    assert got == [(1, 7, "n0", 2000, 0.9), (2, 7, "n0", 2000, 0.7), (2, 8, "n1", 2000, 0.8), (3, 7, "n0", 2000, 0.76), (4, 7, "n0", 2001, 0.8)]


def test_empty_tables(spark):
    menu, wines = spark.createDataFrame([], MENU), spark.createDataFrame([], WINES)
    assert matching.lookup(menu, wines).count() == 0
    one = spark.createDataFrame([(1, "Bocelli Alcide", "Bocelli", "Alcide", None, None, None)], MENU)
    assert [r.wine_id for r in matching.best_hits(one, wines).collect()] == [None]


def test_alike_rows_are_searched_once_and_only_open_rows_go_on(spark, monkeypatch):
    asked, plain = [], matching.contained
    monkeypatch.setattr(matching, "contained", lambda searches, sets, limit: (asked.append(sorted((r.search[0], r.search[1]) for r in searches.collect())), plain(searches, sets, limit))[1])
    menu = [(i, "Ridge 'Lytton Springs' 2018", "Ridge", "Lytton Springs", "Red", None, 2018) for i in (3, 1, 2)] + [(4, "Roumier Nuits Ancien", "Roumier", "Nuits Ancien", None, None, None)]
    wines = [(50, "Ridge", "Lytton Springs", "Dry Creek Valley", 2018, 40.0), (51, "Ridge", "Geyserville", None, None, None), (30, "Roumier", "Bonnes Mares", "Bonnes Mares", 2017, 99.0)]
    best = {r.candidate_id: r.wine_id for r in matching.best_hits(spark.createDataFrame(menu, MENU), spark.createDataFrame(wines, WINES)).collect()}
    assert best == {1: 50, 2: 50, 3: 50, 4: 30}
    assert asked[:2] == [[(1, 0), (4, 0)], [(4, 0), (4, 1)]]


def test_entries_that_differ_in_words_that_no_row_says_are_one_kind(spark, monkeypatch):
    """Searches meet kinds, not entries; wines that can't come first are counted, not gone through, and the least id of the others stays."""
    sets, opened, contained, worth = [], [], matching.contained, matching._worth
    monkeypatch.setattr(matching, "contained", lambda searches, all_sets, limit: (sets.append(all_sets.count()), contained(searches, all_sets, limit))[1])
    monkeypatch.setattr(matching, "_worth", lambda groups: (opened.append({(r.row, r.open): r.n for r in worth(groups).selectExpr("row", "_open as open", "_n as n").groupBy("row", "open").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}), worth(groups))[1])
    menu = [(1, "Ridge Lytton Springs 2018", "Ridge", "Lytton Springs", "Red", None, 2018), (2, "Ridge Lytton Springs 2017", "Ridge", "Lytton Springs", "Red", None, 2017), (3, "Ridge", "Ridge", None, None, None, None), (4, "Lytton mark7x", None, "Lytton mark7x", None, None, None)]
    wines = [(9, "Ridge", "Lytton Springs", "Dry Creek", 2018, 40.0), (9, "Ridge", "Lytton Springs", "Dry Creek", 2017, 41.0)]
    wines += [(10 + i, "Ridge", f"Lytton mark{i}x", "Dry Creek", 2018, 1.0) for i in range(100)] + [(200 + i, "Ridge", f"Dry Creek mark{i}y", "Dry Creek", 2018, 1.0) for i in range(100)]
    best = {r.candidate_id: (r.wine_id, r.hit.year) for r in matching.best_matches(spark.createDataFrame(menu, MENU), spark.createDataFrame(wines, WINES)).collect()}
    assert {k: v for k, v in best.items() if k != 3} == {1: (9, 2018), 2: (9, 2017), 4: (17, 2018)} and best[3][0] == 200
    assert sets[0] == 4  # Lytton Springs, Lytton mark7x, Lytton and any word, Dry Creek and any word
    assert opened[0][(1, True)] == 1 and opened[0].get((1, False), 0) == 0 and (2, True) not in opened[0] and (opened[0][(3, True)], opened[0][(3, False)]) == (100, 101)


def test_heard_words_are_those_of_all_pairs(spark):
    """The near words by their keys are the near words by brute force: slips at every place, beginnings, and short words."""
    base = ["margauxville", "geysers", "lyttonia", "abcdef", "ridge"]
    changed = [w[:i] + x + w[i + k:] for w in base for i in range(len(w) + 1) for x, k in (("z", 1), ("z", 0), ("", 1))] + [w + "xyz" for w in base] + [w[:6] for w in base] + ["merlot", "merlots"]
    words, spoken = (spark.createDataFrame([(w,) for w in sorted(set(x))], "word string") for x in (changed, base + ["merlot"]))
    pairs = words.crossJoin(spoken.withColumnRenamed("word", "said")).where(matching.same_word(matching.F.col("said"), matching.F.col("word")))
    want = sorted({r.word for r in pairs.collect()})
    assert sorted(r.word for r in matching.heard(words, spoken).collect()) == want and len(want) > 60
