"""Set containment join: which sets of words hold all words of which searches.

Every set is posted under its words, and a search is looked up in one posting list only, that of its rarest word (its prefix, with words in the order of
how many sets hold them). Where even the rarest word is common (in more than ``limit`` sets), sets are also posted under each two of their common
words, of those pairs that searches ask for, and the search is looked up under its rarest pair. Whatever list is long all the same (a search of
one common word, or a common pair) is dealt into blocks of about ``limit`` sets by a hash of the set, and the search visits every block. Equal searches are
looked up once.

Scale. No list is a join key as a whole if it is longer than ``limit``: blocks are part of the key, and the joins that tell rows how long their
list is are spread over ``SPREAD`` salts. Words and pairs are counted with partial aggregation. What a search gives is what it must: sets that hold it.

Defined results: a search without words finds nothing, and so does one with a word that no set holds. Repeated words count once. Repeated searches
or sets give repeated rows. Null words never match. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 4096
SPREAD = 16


def _pairs(words: Column) -> Column:
    """Each two of sorted words."""
    rest = lambda i: F.slice(words, i + 2, F.greatest(F.size(words), F.lit(1)))
    return F.flatten(F.transform(words, lambda a, i: F.transform(rest(i), lambda b: F.array(a, b))))


def _spread(rows: DataFrame, facts: DataFrame, key: str, by: str) -> DataFrame:
    """An inner join by ``key`` where a key may have very many rows: those are salted by a hash of ``by``, and the facts repeated for each salt."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SPREAD)).cast("int"))
    every = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return salted.join(every, [key, "_salt"]).drop("_salt")


def contained(searches: DataFrame, sets: DataFrame, limit: int = LIMIT) -> DataFrame:
    """search, set: from searches(search, words) and sets(set, words), both words arrays of strings; ``search`` and ``set`` may have any type."""
    return _search(searches, sets, limit).select("search", "set")


def dealt(searches: DataFrame, sets: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """The two sides of the last join, by _key and _block: (_asked, _key, _block) and (_key, _block, set, _has)."""
    clean = lambda words: F.array_sort(F.array_distinct(F.filter(words, lambda w: w.isNotNull())))
    unique = searches.where(~F.exists("words", lambda w: w.isNull()) & (F.size("words") > 0)).select(F.array_sort(F.array_distinct("words")).alias("_asked")).distinct()
    posted = sets.select("set", clean(F.col("words")).alias("_has")).select("set", "_has", F.explode("_has").alias("_word"))
    counts = posted.groupBy("_word").agg(F.count(F.lit(1)).alias("_n"))

    # searches with their words, the rarest first; a word that no set holds leaves a search without an end
    each = unique.select("_asked", F.explode("_asked").alias("_word")).join(counts, "_word")
    ordered = each.groupBy("_asked").agg(F.min(F.struct("_n", "_word")).alias("_rarest"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") == F.size("_asked"))
    single = (F.col("_rarest._n") <= limit) | (F.col("_k") == 1)
    by_word = ordered.where(single).select("_asked", F.array("_rarest._word").alias("_key"), F.col("_rarest._n").alias("_n"))

    asked_pairs = ordered.where(~single).select("_asked", F.explode(_pairs(F.col("_asked"))).alias("_key"))
    common = counts.where(F.col("_n") > limit).select("_word")
    of_set = _spread(posted, common, "_word", "set").groupBy("set", "_has").agg(F.array_sort(F.collect_set("_word")).alias("_common"))
    posted_pairs = of_set.select("set", "_has", F.explode(_pairs(F.col("_common"))).alias("_key")).join(asked_pairs.select("_key").distinct(), "_key", "left_semi")
    pair_counts = posted_pairs.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    best = asked_pairs.join(pair_counts, "_key").groupBy("_asked").agg(F.min(F.struct("_n", "_key")).alias("_b"), F.count(F.lit(1)).alias("_k"))
    by_pair = best.where(F.col("_k") == F.size("_asked") * (F.size("_asked") - 1) / 2).select("_asked", "_b._key", "_b._n")

    keyed = by_word.unionByName(by_pair).withColumn("_blocks", F.ceil(F.col("_n") / F.lit(limit)).cast("int"))
    lists = posted.select(F.array("_word").alias("_key"), "set", "_has").unionByName(posted_pairs.select("_key", "set", "_has"))
    lists = _spread(lists, keyed.select("_key", "_blocks").distinct(), "_key", "set")
    lists = lists.select("_key", F.pmod(F.xxhash64("set", F.lit(1)), F.col("_blocks")).cast("int").alias("_block"), "set", "_has")
    return keyed.select("_asked", "_key", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_block")), lists


def _search(searches: DataFrame, sets: DataFrame, limit: int) -> DataFrame:
    asked, lists = dealt(searches, sets, limit)
    found = asked.join(lists, ["_key", "_block"]).where(F.size(F.array_except("_asked", "_has")) == 0).select("_asked", "set")
    return searches.select("search", F.array_sort(F.array_distinct("words")).alias("_asked")).join(found, "_asked")
