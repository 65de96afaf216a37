"""Styles of texts from a dictionary of any size: aliases of one or more words, the longest first, none over another.

The dictionary is a table, kept as a trie of two levels: a node for each first word, with the aliases that begin so and what they go on with. Each
place of a text is looked up by its word in one equi-join, and an alias is met if the words that follow are its own. Of what is met, longer aliases
are taken first, then those earlier in the dictionary, then earlier places, and what overlaps a taken one falls away. Colour words count only where
no alias lies. No alias is a pattern, so a dictionary of thousands costs no more a text than a small one.

Scale. Equal texts are read once. A text's aliases are cut into runs that overlap, so what is folded in one row is a run and not a text; all else
is aggregation by text. Long texts carry a few words a place. A word that very many texts have is a hot key only if the dictionary is too large
to be broadcast, and then adaptive execution can split it.

Defined results: null texts, and those without an alias or a colour word, have no style (they are not in the result). Of an alias that the
dictionary has twice, the first entry counts. Aliases are folded as texts are; those without a letter or digit are left out. An empty
dictionary leaves the colour words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.style import ENTRIES, RED_STYLES, RED_WORDS, ROSE_WORDS, SPARKLING, WHITE_WORDS, Entry, is_other_drink
from ..functions.text import normal_field, style_text

#: Colour words as entries after all others: they never take a place, and say only that they are there.
_COLOUR_TIER = 9
_COLOURS = {**{w: "rose" for w in ROSE_WORDS}, **{w: "red" for w in RED_WORDS}, **{w: "white" for w in WHITE_WORDS}, "reds": "reds", "whites": "whites", "bianca": "bianca"}  # the last is white beside a style only


def dictionary(spark: SparkSession, entries: list[Entry] | tuple[Entry, ...] = tuple(ENTRIES)) -> DataFrame:
    """alias, key, tier, white, red, place of entries in their order."""
    rows = [(a, k, t, w, r, i) for i, (a, k, t, w, r) in enumerate(entries)]
    return spark.createDataFrame(rows, "alias string, key string, tier int, white string, red string, place long")


def trie(entries: DataFrame) -> DataFrame:
    """word, aliases: one node for each first word; ``entries`` as of ``dictionary``."""
    folded = entries.select(F.trim(style_text(F.col("alias"))).alias("alias"), "key", F.when((F.col("tier") == 2) & F.col("key").isin(SPARKLING), 0).otherwise(F.col("tier")).cast("int").alias("tier"), "white", "red", F.col("place").cast("long").alias("place"))
    once = folded.where("alias <> ''").groupBy("alias").agg(F.min_by(F.struct("tier", "key", "white", "red", "place"), "place").alias("e"))
    colours = entries.sparkSession.createDataFrame(list(_COLOURS.items()), "alias string, key string")
    colours = colours.select("alias", F.lit(_COLOUR_TIER).alias("tier"), "key", F.lit(None).cast("string").alias("white"), F.lit(None).cast("string").alias("red"), F.lit(0).cast("long").alias("place"))
    every = once.select("alias", "e.tier", "e.key", "e.white", "e.red", "e.place").unionByName(colours)
    words = F.split("alias", " ")
    node = F.struct(words.alias("words"), F.length("alias").alias("size"), "tier", "key", "white", "red", "place")
    return every.select(F.get(words, F.lit(0)).alias("word"), node.alias("node")).groupBy("word").agg(F.collect_list("node").alias("aliases"))


def met(texts: DataFrame, nodes: DataFrame, most_words: int = 8) -> DataFrame:
    """text, start, end, tier, key, white, red: what is taken of each text; places in words. ``most_words`` is the most that an alias has."""
    words = texts.select("text", F.split(F.trim(style_text(F.col("text"))), " ").alias("_w"))
    places = words.select("text", F.posexplode(F.transform("_w", lambda w, i: F.slice(F.col("_w"), i + 1, most_words))).alias("start", "_ahead")).withColumn("word", F.get("_ahead", F.lit(0)))
    begun = places.join(nodes, "word").select("text", "start", F.explode(F.filter("aliases", lambda a: F.slice(F.col("_ahead"), 1, F.size(a["words"])) == a["words"])).alias("a"))
    hits = begun.select("text", "start", (F.col("start") + F.size("a.words")).alias("end"), "a.size", "a.tier", "a.key", "a.white", "a.red", "a.place").repartition("text")
    before = Window.partitionBy("text").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.partitionBy("text").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    runs = hits.withColumn("_new", (F.coalesce(F.max("end").over(before), F.lit(-1)) <= F.col("start")).cast("int")).withColumn("_run", F.sum("_new").over(running))
    item = F.struct((F.col("tier") == _COLOUR_TIER).alias("colour"), (-F.col("size")).alias("shorter"), "place", "start", "end", "tier", "key", "white", "red")
    kept = runs.groupBy("text", "_run").agg(F.array_sort(F.collect_list(item)).alias("_hits"))

    def take(taken: Column, x: Column) -> Column:
        free = ~F.exists(taken, lambda t: ~t["colour"] & (t["start"] < x["end"]) & (t["end"] > x["start"]))
        return F.when(free, F.concat(taken, F.array(x))).otherwise(taken)
    first = F.slice("_hits", 1, 1)
    rest = F.slice("_hits", 2, F.greatest(F.size("_hits"), F.lit(1)))
    taken = kept.select("text", F.explode(F.aggregate(rest, first, take)).alias("t"))
    return taken.select("text", "t.start", "t.end", "t.tier", "t.key", "t.white", "t.red")


def styles_of(texts: DataFrame, entries: DataFrame, most_words: int = 8) -> DataFrame:
    """text, key: the style of each distinct ``text`` that has one.

    The lowest tier wins, then the first place. A colour word beside it changes red to white or rosé, and white to red where the entry says
    how; sparkling styles win over rosé, sake over sparkling.
    """
    found = met(texts.select("text").where("text is not null").distinct(), trie(entries), most_words)
    colour = lambda *kinds: F.max((F.col("tier") == _COLOUR_TIER) & F.col("key").isin(*kinds))
    named = F.col("tier") != _COLOUR_TIER
    by_text = found.groupBy("text").agg(
        F.min(F.when(named, F.struct("tier", "start", "key", "white", "red"))).alias("best"), F.max(named & F.col("key").startswith("sake")).alias("sake"),
        F.min(F.when((F.col("tier") == 0) & F.col("key").isin(SPARKLING), F.struct("start", "key"))).alias("sparkling"),
        colour("rose").alias("rose"), colour("red").alias("red"), colour("white", "bianca").alias("white"), colour("red", "reds").alias("plain_red"), colour("white", "whites").alias("plain_white"),
    )
    best, red = F.col("best"), F.col("best.key").isin(RED_STYLES)
    coloured = F.when(F.col("rose") & red, "rose_dry").when(F.col("white") & red, F.coalesce(best["white"], F.lit("default_white"))).when(F.col("red") & ~red & best["red"].isNotNull(), best["red"]).otherwise(best["key"])
    own = F.when((best["key"] == "default_sparkling") & F.col("sake"), "sake_sparkling").when((best["key"] == "rose_dry") & F.col("sparkling").isNotNull(), F.col("sparkling.key")).otherwise(coloured)
    plain = F.when(F.col("rose"), "rose_dry").when(F.col("plain_red"), "default_red").when(F.col("plain_white"), "default_white")
    return by_text.select("text", F.when(best.isNotNull(), own).otherwise(plain).alias("key")).where("key is not null")


def with_style(df: DataFrame, key: str, entries: DataFrame, own: Column, varietal: Column, notes: Column, section: Column, color: Column, most_words: int = 8) -> DataFrame:
    """The rows with ``style``, a struct(key, specific): from the item's own text, its varietal or notes; else, not specific, from its section or colour.

    Rows that share a ``key`` must share their texts.
    """
    texts = F.array(own, varietal, notes, section)
    long = df.select(F.col(key).alias("_key"), F.posexplode(texts).alias("_kind", "text")).where("text is not null")
    known = long.join(styles_of(long, entries, most_words), "text").groupBy("_key").agg(*[F.min(F.when(F.col("_kind") == k, F.col("key"))).alias(f"_s{k}") for k in range(4)])
    c = normal_field(color)
    by_color = F.when(c.contains("champagne"), "champagne").when(c.contains("rose"), "rose_dry").when(c.contains("sparkling"), "default_sparkling").when(c.contains("orange"), "orange_wine").when(c.contains("red"), "default_red").when(c.contains("white"), "default_white").otherwise("default_unknown")
    other = is_other_drink(own) & F.col("_s0").isNull()
    sure = F.coalesce("_s0", "_s1", "_s2")
    style = F.struct(F.when(other, "default_unknown").otherwise(F.coalesce(sure, "_s3", by_color)).alias("key"), (~other & sure.isNotNull()).alias("specific"))
    return df.join(known, F.col(key) == F.col("_key"), "left").withColumn("style", style).drop("_key", *[f"_s{k}" for k in range(4)])
