"""Menu candidates against a catalogue.

Retrieval is that of searches that need every word: a catalogue entry is a hit if it has all words of one of a candidate's searches
(``identity.search_plan``, at most three, the most specific first), found by a containment join. Later searches count only while the earlier ones have found
no decisive hit and no confident one by its cuvée alone. An entry may be listed with several vintages; which of them is kept is an ordered choice by
vintage and identity. The best hit stays.

Scale. Candidates that say the same are looked up once, and so are rows whose words differ in no more than the year. The first search, which asks for
most words, is done alone, and later ones only for rows that it leaves open. Entries are searched and scored by kind: a word that no row says nor nearly
says stands for any other such word, so entries that differ in those alone are one kind, however many they are. Wines listed under the same kinds are
one group; of a row's groups only those go on to their vintages that can come first, or that can end the search, by bounds of what a score may
become there. The rest are counted by winery and looked at again where a cuvée alone decides. The ordered choice gathers one candidate's
vintages of one entry, and a wine's kinds are gathered. Nothing else is.

Defined results: candidates without search words or hits come out with nulls. Ties go to the smallest catalogue id. Repeated catalogue rows change nothing.
Empty tables give an empty result, or candidates without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import CLASSES, GIVEN_NAMES, GRAPE_PARTS, GRAPES, PLACES, PRODUCER_KINDS, ROSE, bonus_of_words, compare_evidence, compare_named_grapes, grapes, has_word, hit_words, identity_words, menu_identity_text, row_grapes, row_words, same_word, score_of_words, search_plan, vintage_evidence, within
from ..functions.profile import name_for
from ..functions.style import RED_STYLES, WHITE_STYLES
from ..functions.taste import match_scale, status_of
from ..functions.text import identity_text
from .containment import LIMIT, contained
from .cut import cut
from .styles import dictionary, styles_of

# The least identity that counts, the one that is sure, and the one that ends the search.
LEAST, CONFIDENT, DECISIVE = 0.6, 0.75, 0.85
MOST_SEARCHES = 3
GUESS_CAP = 0.58
_RANKS = {"exact": 3, "unconstrained": 2, "unknown": 1, "conflict": 0}
EXACT_BONUS = 0.02
_TELLING = [*CLASSES, *GIVEN_NAMES, *GRAPE_PARTS, *GRAPES, *PLACES, *PRODUCER_KINDS, *ROSE]


def _entry_words(catalogue: DataFrame) -> DataFrame:
    """set(winery, name), words: each entry once, whatever its vintages."""
    entry = F.struct(F.coalesce("winery", F.lit("")).alias("winery"), F.coalesce("name", F.lit("")).alias("name"))
    return catalogue.select(entry.alias("set")).distinct().select("set", F.array_distinct(identity_words(F.concat_ws(" ", "set.winery", "set.name"), False)).alias("words"))


def _plan(candidates: DataFrame) -> Column:
    return search_plan({f: F.col(f) for f in ("raw_text", "producer", "label")} | {"region": F.col("region") if "region" in candidates.columns else F.lit(None).cast("string")})


def retrieve(candidates: DataFrame, catalogue: DataFrame, limit: int = LIMIT, searches: int = MOST_SEARCHES) -> DataFrame:
    """candidate_id, plan, winery, name: entries that have all words of one of the candidate's searches, and the first search that finds them."""
    found = _found(candidates.select("candidate_id", _plan(candidates).alias("_plan")), _entry_words(catalogue), limit, searches)
    return found.select("candidate_id", "plan", "set.winery", "set.name")


def _found(rows: DataFrame, words: DataFrame, limit: int, searches: int) -> DataFrame:
    """candidate_id, set, plan: from rows(candidate_id, _plan) and words(set, words)."""
    asked = rows.select("candidate_id", F.posexplode(F.slice("_plan", 1, searches)).alias("_place", "words")).select(F.struct("candidate_id", F.col("_place").alias("plan")).alias("search"), "words")
    found = contained(asked, words, limit)
    return found.groupBy("search.candidate_id", "set").agg(F.min("search.plan").alias("plan"))


def producers_with_cuvee(hits: DataFrame, keys: list[str], cuvee: str, winery: str = "winery", name: str = "name") -> DataFrame:
    """keys, n_producers: how many producers among each key's hits have a name with every word of the array ``cuvee``; one is safe to match."""
    pool = identity_words(F.col(name), False)
    whole = F.forall(F.col(cuvee), lambda t: has_word(pool, t))
    producer = F.when(whole, F.trim(identity_text(F.col(winery))))
    return hits.groupBy(*keys).agg(F.count_distinct(producer).alias("n_producers"))


def with_colours(candidates: DataFrame, catalogue: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with ``_colour``: red or white by the style of the row's text or the entry's name, null if neither is said."""
    texts = candidates.select(F.col("raw_text").alias("text")).unionByName(catalogue.select(F.col("name").alias("text")))
    key = F.col("key")
    known = cut(styles_of(texts, entries).select("text", F.when(key.isin(RED_STYLES), "red").when(key.isin(WHITE_STYLES), "white").alias("_colour")))
    of = lambda df, name: df.join(known, F.col(name) == F.col("text"), "left").drop("text")
    return of(candidates, "raw_text"), of(catalogue, "name")


def winery_key(winery: Column) -> Column:
    return F.trim(F.regexp_replace(identity_text(winery), "[^a-z0-9]+", " "))


def _alike(candidates: DataFrame) -> DataFrame:
    """candidate_id, _as: the least id of those whose rows say the same."""
    said = F.array_sort(F.collect_set(F.struct(*[c for c in candidates.columns if c != "candidate_id"])))
    by_id = candidates.where(F.col("candidate_id").isNotNull()).groupBy("candidate_id").agg(said.alias("_said"))
    return by_id.groupBy("_said").agg(F.min("candidate_id").alias("_as"), F.collect_list("candidate_id").alias("_ids")).select(F.explode("_ids").alias("candidate_id"), "_as")


def _same_words(people: DataFrame) -> DataFrame:
    """With ``row``, the least id of those candidates that say the same words, and ``_nth``, which of a candidate's rows this is."""
    said = people.groupBy("candidate_id").agg(F.array_sort(F.collect_set("_said")).alias("_all"))
    first = said.groupBy("_all").agg(F.min("candidate_id").alias("row"))
    return cut(people.join(said.join(first, "_all"), "candidate_id").select("candidate_id", "row", F.array_position("_all", F.col("_said")).alias("_nth"), "vintage", "_said"))


def _spread(df: DataFrame) -> DataFrame:
    """The rows dealt over the session's shuffle partitions: few bytes, but much to compute a row."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _read(candidates: DataFrame, listed: DataFrame, entries: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Candidates with what they say, and each text of the catalogue (_text, winery, name, region) with what it says."""
    rows, texts = with_colours(candidates, listed.select("winery", "name", "region").distinct(), dictionary(candidates.sparkSession) if entries is None else entries)
    row = {f: F.col(f) for f in ("raw_text", "producer", "label", "menu_section", "varietal")}
    region = F.col("region") if "region" in candidates.columns else F.lit(None).cast("string")
    year = vintage_evidence(F.col("vintage"), menu_identity_text(row["label"], row["raw_text"], region))
    said = F.struct(_plan(candidates).alias("_plan"), row_words(row).alias("_words"), row_grapes(row["label"], row["varietal"], row["producer"], row["raw_text"], region).alias("_grapes"), F.col("_colour"), year.alias("_year"))
    texts = _spread(texts).withColumn("_words", hit_words({f: F.col(f) for f in ("winery", "name", "region")})).withColumn("_grapes", grapes(F.col("name"))).withColumn("_has", F.array_distinct(identity_words(F.concat_ws(" ", "winery", "name"), False)))
    return cut(_spread(rows).select("candidate_id", "vintage", said.alias("_said"))), cut(texts.withColumn("_text", F.monotonically_increasing_id()))


def heard(words: DataFrame, spoken: DataFrame) -> DataFrame:
    """Those of words(word) that one of spoken(word) is the same as, by ``same_word``.

    Words that begin alike, or have one slip, share the first four letters, or the first two and all behind the slip: those are looked up, not all pairs.
    """
    head, tail = lambda w: F.concat(F.lit("<"), F.substring(w, 1, 4)), lambda w, at: F.concat(F.lit(">"), F.substring(w, 1, 2), F.substring(w, at, 1000))
    long = F.length("word") >= 6
    mine = words.where(long).select("word", F.explode(F.array(head(F.col("word")), tail(F.col("word"), 5))).alias("_key"))
    theirs = spoken.where(long).select(F.col("word").alias("_said"), F.explode(F.array_distinct(F.array(head(F.col("word")), *[tail(F.col("word"), at) for at in (4, 5, 6)]))).alias("_key"))
    near = mine.join(theirs, "_key").where(same_word(F.col("_said"), F.col("word"))).select("word")
    return words.join(spoken, "word", "left_semi").unionByName(near).distinct()


def _kinds(texts: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """kind, _words, _has, _colour, _grapes: what texts say in the words of the rows, each once; and the kind of each text."""
    spoken = rows.select(F.explode(F.array_distinct(F.concat(*[f"_words.{f}" for f in ("row", "context", "quoted", "raw")], F.flatten("_plan")))).alias("word")).distinct()
    every = F.concat("_words.winery", "_words.all_name", "_words.region")
    each = texts.select("_text", F.explode(F.array_distinct(F.concat(every, "_has"))).alias("word"))
    words = each.select("word").distinct()
    known = heard(words, spoken).unionByName(words.where(within(F.col("word"), *_TELLING))).distinct()
    told = texts.join(each.join(known, "word", "left_semi").groupBy("_text").agg(F.collect_set("word").alias("_told")), "_text", "left").withColumn("_told", F.coalesce("_told", F.array().cast("array<string>")))
    # a word that is not told keeps only its first place, so that equal ones stay equal
    plain = lambda a: F.transform(a, lambda t: F.when(F.array_contains("_told", t), t).otherwise(F.concat(F.lit("~"), F.array_position(every, t).cast("string"))))
    kind = F.struct(F.struct(*[plain(F.col(f"_words.{f}")).alias(f) for f in ("winery", "all_name", "region")]).alias("_words"), F.array_sort(F.array_intersect("_has", "_told")).alias("_has"), "_colour", "_grapes")
    of = cut(told.select("_text", "winery", "name", "region", kind.alias("_kind")))
    kinds = cut(of.groupBy("_kind").agg(F.min("_text").alias("kind")))
    return kinds.select("kind", "_kind.*"), of.join(kinds, "_kind").select("winery", "name", "region", "kind")


def _wines(listed: DataFrame, kind_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each listed vintage with its kind; and wine_id, _entry, _many, group: wines listed under the same kinds of one winery are a group. A wine of
    several entries (_many) is one by itself."""
    l, k = listed.alias("l"), kind_of.alias("k")
    same = (F.col("l.winery") == F.col("k.winery")) & (F.col("l.name") == F.col("k.name")) & F.col("l.region").eqNullSafe(F.col("k.region"))
    listed = cut(l.join(k, same).select("l.*", "k.kind").withColumn("_year", vintage_evidence(F.col("year"), F.col("name"))))
    entry = F.struct("winery", "name")
    wines = listed.groupBy("wine_id").agg(F.min(entry).alias("_entry"), (F.min(entry) != F.max(entry)).alias("_many"), F.array_sort(F.collect_set("kind")).alias("_kinds")).withColumn("_winery", winery_key(F.col("_entry.winery")))
    whole = wines.withColumn("_group", F.struct("_winery", "_kinds", "_many", F.when(F.col("_many"), F.col("wine_id")).alias("_own")))
    groups = whole.groupBy("_group").agg(F.min("wine_id").alias("group"), F.count(F.lit(1)).alias("_n"))
    return listed, cut(whole.join(groups, "_group").select("wine_id", "_entry", "_many", "_kinds", "_winery", "group", "_n"))


_ENOUGH = "judged.score >= {0} or (judged.without_producer and judged.score >= {1})".format(DECISIVE, CONFIDENT)


def _pair() -> tuple[Column, Column, Column]:
    """Whether a row ``c`` and a kind ``w`` contradict in neither grapes nor colour, the bonus and the score. Built once, since building takes seconds."""
    fits = (compare_named_grapes(F.col("c._grapes"), F.col("w._grapes")) != "conflict") & F.coalesce(F.col("c._colour") == F.col("w._colour"), F.lit(True))
    return fits, bonus_of_words(F.col("c._words.raw"), F.col("w._words.winery"), F.col("w._words.all_name")), score_of_words(F.col("c._words"), F.col("w._words"))


def _judged(rows: DataFrame, kinds: DataFrame, limit: int, searches: int, pair: tuple[Column, Column, Column]) -> DataFrame:
    """row, _nth, plan, kind, bonus, judged: every kind found that contradicts neither grapes nor colour."""
    found = _found(rows, kinds.select(F.col("kind").alias("set"), F.col("_has").alias("words")), limit, searches)
    c, w, p = rows.alias("c"), kinds.alias("w"), found.alias("p")
    fits, bonus, score = pair
    pairs = p.join(c, F.col("p.candidate_id") == F.col("c.candidate_id")).join(w, F.col("p.set") == F.col("w.kind")).where(fits)
    return pairs.select(F.col("c.candidate_id").alias("row"), "c._nth", (F.col("c._year") != "unknown").alias("_dated"), "p.plan", "w.kind", bonus.alias("bonus"), score.alias("judged"))


def _in_groups(judged: DataFrame, groups: DataFrame) -> DataFrame:
    """row, group, plan, what a wine of the group may come to there: _enough if it surely ends the search, _may if it might."""
    enough = F.expr(_ENOUGH)
    return judged.join(groups, "kind").groupBy("row", "group").agg(
        F.min("plan").alias("plan"), F.max("_dated").alias("_dated"), F.max("_many").alias("_many"), F.max("_winery").alias("_winery"), F.max("_n").alias("_n"), F.min("bonus").alias("_less"), F.max("bonus").alias("_more"),
        F.min("judged.score").alias("_low"), F.max("judged.score").alias("_high"), F.max("judged.appellation_guess").alias("_guess"), F.min(enough).alias("_enough"), F.max(enough).alias("_may"),
    )


def _worth(groups: DataFrame) -> DataFrame:
    """``_in_groups`` up to the search that surely ends a row's, with ``_until``, that search, and ``_open``: whether the group's wines may come first or end it earlier.

    A wine's score is one of its kinds', and without a year to ask for the highest. So it can't come first if even that, with all that may be added,
    is below what another one has in any case when it is found.
    """
    high = F.col("_high") + F.when(F.col("_dated"), EXACT_BONUS).otherwise(0.0) + F.col("_more")
    sure = F.when(F.col("_dated"), F.col("_low")).otherwise(F.col("_high"))
    low = F.when(~F.col("_many"), F.when(F.col("_guess"), F.least(sure, F.lit(GUESS_CAP))).otherwise(sure) + 0.0 + F.col("_less"))
    best = groups.groupBy("row").agg(F.min(F.when(F.col("_enough"), F.col("plan"))).alias("_end"), *[F.max(F.when(F.col("plan") <= i, low)).alias(f"_low{i}") for i in range(MOST_SEARCHES)])
    least = F.coalesce(*[F.when(F.col("plan") == i, F.col(f"_low{i}")) for i in range(MOST_SEARCHES)])
    until = F.coalesce("_end", F.lit(MOST_SEARCHES - 1))
    ends = F.col("_may") & ~F.col("_enough") & (F.col("plan") < until)
    return groups.join(best, "row").where(F.col("plan") <= until).select("row", "group", "plan", "_winery", "_n", until.alias("_until"), (F.col("_many") | F.coalesce(high >= least, F.lit(True)) | ends).alias("_open"))


def _searched(people: DataFrame, rows: DataFrame, listed: DataFrame, kinds: DataFrame, wines: DataFrame, more: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """``_kept`` of the wines that may come first, with ``row``; and ``_worth`` of all. A row for which the first search finds enough has no use for what the others find."""
    groups = wines.select("group", "_many", "_winery", "_n", F.explode("_kinds").alias("kind")).distinct()
    pair = _pair()
    first = cut(_judged(rows, kinds, limit, 1, pair))
    done = cut(_in_groups(first, groups).where("_enough").select("row").distinct())
    rest = cut(rows.join(done, F.col("candidate_id") == F.col("row"), "left_anti"))
    judged = cut(first.join(done, "row", "left_semi").unionByName(_judged(rest, kinds, limit, MOST_SEARCHES, pair)))
    worth = cut(_worth(_in_groups(judged, groups)))
    # from groups to their wines, from those to their vintages, and from rows to candidates
    chosen = worth.where("_open").select("row", "group", "_until").join(wines.select("group", "wine_id"), "group").alias("g")
    pairs = chosen.join(listed.alias("w"), F.col("g.wine_id").eqNullSafe(F.col("w.wine_id"))).join(judged.alias("j"), (F.col("g.row") == F.col("j.row")) & (F.col("w.kind") == F.col("j.kind"))).where("j.plan <= g._until").join(people.alias("c"), (F.col("j.row") == F.col("c.row")) & (F.col("j._nth") == F.col("c._nth")))
    vintage = compare_evidence(F.col("c._year"), F.col("w._year"), F.col("c.vintage"), F.col("w.year"))
    hit = F.struct(F.col("w.winery"), F.col("w.name"), F.col("w.region"), F.col("w.year"), *[F.col(f"w.{f}") for f in more], F.col("j.bonus"), vintage.alias("vintage"))
    ranks = F.create_map(*[F.lit(x) for pair in _RANKS.items() for x in pair])
    scored = pairs.select("c.candidate_id", "j.plan", "w.wine_id", hit.alias("hit"), ranks[vintage].alias("rank"), "j.judged", F.col("g._until").alias("until"))
    return cut(_kept(scored).join(people.select("candidate_id", "row").distinct(), "candidate_id")), worth


def _kept(scored: DataFrame, searches: int = MOST_SEARCHES) -> DataFrame:
    """candidate_id, wine_id, hit, judged after the last search that counts, ``upto``: a later vintage replaces the kept one if it fits better, or as well with a
    higher score; the better score of both stays with what it says of the producer. ``until`` is the last search that can count, if the rows say so."""
    until = F.col("until") if "until" in scored.columns else F.lit(searches - 1)
    steps = scored.withColumn("_until", until).withColumn("upto", F.explode(F.sequence(F.col("plan"), F.col("_until"))))
    item = F.struct("plan", F.col("hit.year").alias("year"), F.col("hit.name").alias("name"), "rank", "hit", "judged")
    rows = steps.groupBy("candidate_id", "upto", "wine_id").agg(F.array_sort(F.collect_list(item)).alias("_rows"), F.max("_until").alias("_until"))

    def step(kept: Column, x: Column) -> Column:
        better = (x["rank"] > kept["rank"]) | ((x["rank"] == kept["rank"]) & (x["judged"]["score"] > kept["judged"]["score"]))
        judged = F.when(kept["judged"]["score"] > x["judged"]["score"], kept["judged"]).otherwise(x["judged"])
        return F.when(better, F.struct(x["plan"].alias("plan"), x["year"].alias("year"), x["name"].alias("name"), x["rank"].alias("rank"), x["hit"].alias("hit"), judged.alias("judged"))).otherwise(kept)

    folded = F.aggregate(F.slice("_rows", 2, F.greatest(F.size("_rows"), F.lit(1))), F.get("_rows", F.lit(0)), step)
    states = rows.select("candidate_id", "upto", "wine_id", "_until", folded.alias("_k")).select("candidate_id", "upto", "wine_id", "_until", "_k.hit", "_k.judged")
    last = states.groupBy("candidate_id").agg(F.coalesce(F.min(F.when(F.expr(_ENOUGH), F.col("upto"))), F.max("_until")).alias("upto"))
    return states.join(last, ["candidate_id", "upto"]).drop("_until")


def best_matches(candidates: DataFrame, catalogue: DataFrame, limit: int = LIMIT, entries: DataFrame | None = None) -> DataFrame:
    """candidate_id, wine_id, identity, hit: each candidate's best hit, with no regard to whether it is good enough.

    ``candidates`` has candidate_id, raw_text, producer, label, menu_section, varietal, vintage, and region if it is known; ``catalogue`` wine_id,
    winery, name, region, year and whatever shall come along in ``hit``; ``entries`` is a style dictionary (``styles.dictionary``) for the colours. Ranked by identity, with small bonuses for the exact vintage and a
    named cuvée. An appellation guess among several of a winery's entries is capped. A match on the cuvée alone needs that the
    catalogue has no second producer of it.
    """
    alike = cut(_alike(candidates))
    firsts = cut(candidates.join(alike.where("candidate_id = _as").select("candidate_id"), "candidate_id", "left_semi"))
    listed = cut(catalogue.withColumns({f: F.coalesce(f, F.lit("")) for f in ("winery", "name")}).distinct())
    people, texts = _read(firsts, listed, entries)
    people = _same_words(people)
    rows = people.where("candidate_id = row").select("candidate_id", "_nth", "_said.*").distinct()
    kinds, kind_of = _kinds(texts, rows)
    listed, wines = _wines(listed, kind_of)
    more = [f for f in catalogue.columns if f not in ("wine_id", "winery", "name", "region", "year")]
    kept, worth = _searched(people.select("candidate_id", "row", "_nth", "vintage", "_said._year"), rows, listed, kinds, wines, more, limit)
    kept = kept.withColumn("_winery", winery_key(F.col("hit.winery")))
    # a guess among several: those that were looked at, and those that could not come first
    aside = worth.where("not _open")
    guessed = kept.where("judged.appellation_guess").select("candidate_id", "row", "_winery", "upto").distinct()
    beside = guessed.join(aside.groupBy("row", "_winery", "plan").agg(F.sum("_n").alias("_n")), ["row", "_winery"]).where("plan <= upto").select("candidate_id", "_winery", "_n")
    around = kept.groupBy("candidate_id", "_winery").agg(F.count(F.lit(1)).alias("_n")).unionByName(beside).groupBy("candidate_id", "_winery").agg(F.sum("_n").alias("_n"))
    capped = F.when(F.col("judged.appellation_guess") & (F.col("_n") > 1), F.least(F.col("judged.score"), F.lit(GUESS_CAP))).otherwise(F.col("judged.score"))
    known = kept.join(around, ["candidate_id", "_winery"]).withColumn("identity", capped)
    order = F.struct(F.col("identity") + F.when(F.col("hit.vintage") == "exact", EXACT_BONUS).otherwise(0.0) + F.col("hit.bonus"), -F.col("wine_id"))
    best = cut(known.groupBy("candidate_id").agg(F.max_by(F.struct("wine_id", "identity", "hit", "judged", "row", "upto"), order).alias("_b")).select("candidate_id", "_b.*"))
    doubtful = best.where(F.col("judged.without_producer") & (F.col("identity") >= LEAST)).select("candidate_id", "row", "upto", F.col("judged.cuvee").alias("cuvee"))
    # the words of a cuvée are said by a row, so kinds have them
    by_cuvee = contained(doubtful.select(F.struct("candidate_id", "cuvee").alias("search"), F.col("cuvee").alias("words")), kinds.select(F.col("kind").alias("set"), F.col("_has").alias("words")), limit)
    by_cuvee = by_cuvee.join(kind_of, F.col("set") == F.col("kind")).select("search.candidate_id", "search.cuvee", "winery", "name")
    looked_at = doubtful.join(kept.select("candidate_id", "hit.winery", "hit.name"), "candidate_id").select("candidate_id", "cuvee", "winery", "name")
    not_looked_at = doubtful.join(aside, "row").where("plan <= upto").join(wines.select("group", "_entry"), "group").select("candidate_id", "cuvee", "_entry.winery", "_entry.name")
    makers = by_cuvee.unionByName(looked_at).unionByName(not_looked_at).distinct()
    shared = producers_with_cuvee(makers, ["candidate_id", "cuvee"], "cuvee").where("n_producers > 1")
    sure = best.join(shared.select("candidate_id"), "candidate_id", "left_anti").select(F.col("candidate_id").alias("_as"), "wine_id", "identity", "hit")
    return alike.join(sure, "_as").select("candidate_id", "wine_id", "identity", "hit")


def best_hits(candidates: DataFrame, catalogue: DataFrame, limit: int = LIMIT, entries: DataFrame | None = None) -> DataFrame:
    """One row per candidate: candidate_id, wine_id, identity, vintage, match_confidence, status."""
    best = best_matches(candidates, catalogue, limit, entries).select("candidate_id", "wine_id", "identity", "hit.vintage")
    out = candidates.select("candidate_id").join(best, "candidate_id", "left")
    matched = F.when(F.col("identity").isNotNull(), match_scale(F.col("identity"))).otherwise(0.0)
    return out.withColumn("match_confidence", matched).withColumn("status", status_of(F.col("match_confidence")))


def lookup(candidates: DataFrame, catalogue: DataFrame, limit: int = LIMIT, entries: DataFrame | None = None) -> DataFrame:
    """The profile of each candidate that has a match good enough: candidate_id, wine_id, match_score, display_name, producer, label, vintage, region, and
    the other columns of the catalogue. The year is that of the hit only if the menu asks for it; else the label goes without it."""
    best = best_matches(candidates, catalogue, limit, entries).where(F.col("identity") >= LEAST)
    mine = candidates.select("candidate_id", F.col("producer").alias("_producer"), F.col("label").alias("_label"), F.col("vintage").alias("_vintage"), (F.col("region") if "region" in candidates.columns else F.lit(None).cast("string")).alias("_region"))
    same, said = F.col("hit.vintage") == "exact", lambda c: F.when(c != "", c)
    named = best.join(mine, "candidate_id").withColumn("_shown", name_for(F.col("hit.name"), same))
    rest = [F.col(f"hit.{f}") for f in catalogue.columns if f not in ("wine_id", "winery", "name", "region", "year")]
    return named.select(
        "candidate_id", "wine_id", match_scale(F.col("identity")).alias("match_score"), F.concat_ws(" ", said(F.col("hit.winery")), said(F.col("_shown"))).alias("display_name"), F.coalesce(said(F.col("hit.winery")), "_producer").alias("producer"),
        F.coalesce(said(F.col("_shown")), "_label").alias("label"), F.when(same, F.col("hit.year")).otherwise(F.col("_vintage")).alias("vintage"), F.coalesce(said(F.col("hit.region")), "_region").alias("region"), *rest,
    )
