"""The containment join against brute force, with words in a third of all sets."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from carafe.operators.containment import contained, dealt

WORDS, SETS = "search long, words array<string>", "set long, words array<string>"


def tables(n, seed):
    r = random.Random(seed)
    names = ["third"] + [f"w{i}" for i in range(60)]
    weight = [0] + [1 / (i + 1) for i in range(60)]
    sets = [(i, [x for x in ["third"] if r.random() < 0.34] + r.choices(names, weight, k=r.randint(0, 6))) for i in range(n)]
    searches = [(i, r.choices(names, [0.5, *weight[1:]], k=r.randint(1, 4))) for i in range(n // 4)]
    odd = [(9001, []), (9002, ["third"]), (9003, ["third"]), (9004, ["no such word"]), (9005, ["third", "no such word"]), (9006, ["w0", "w1"]), (9007, ["w0", "w1", "w2"]), (9008, ["w1", None])]
    return searches + odd, sets + [(5001, []), (5002, ["third", "third", "w0", "w1", "w2", "w3"]), (5003, ["w1", None])]


@pytest.mark.parametrize("limit", [3, 40, 10_000])
def test_hits_equal_brute_force(spark, limit):
    searches, sets = tables(400, limit)
    got = Counter((r.search, r.set) for r in contained(spark.createDataFrame(searches, WORDS), spark.createDataFrame(sets, SETS), limit).collect())
    want = Counter((s, k) for s, a in searches for k, b in sets if a and None not in a and set(a) <= set(b))
    assert got == want and len(want) > 2000


def test_no_block_is_longer_than_its_share(spark):
    searches, sets = tables(3000, 1)
    asked, lists = dealt(spark.createDataFrame(searches, WORDS), spark.createDataFrame(sets, SETS), 100)
    sizes = [r["n"] for r in lists.groupBy("_key", "_block").agg(F.count(F.lit(1)).alias("n")).collect()]
    keys = [r._key for r in lists.select("_key").distinct().collect()]
    # a third of the sets hold one word, whose list of a thousand is dealt into ten blocks; some lists are of two words
    assert max(sizes) <= 150 and any(len(k) == 2 for k in keys) and ["third"] in keys
    assert "Cartesian" not in asked.join(lists, ["_key", "_block"])._jdf.queryExecution().toString()


def test_empty_tables_and_repeats(spark):
    none = spark.createDataFrame([], WORDS), spark.createDataFrame([], SETS)
    some = spark.createDataFrame([(1, ["a"]), (1, ["a"])], WORDS), spark.createDataFrame([(7, ["a"]), (7, ["a", "b"])], SETS)
    assert contained(none[0], some[1]).count() == contained(some[0], none[1]).count() == 0
    assert sorted(map(tuple, contained(*some).collect())) == [(1, 7)] * 4
