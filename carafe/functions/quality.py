"""Quality and confidence scores of texts, from 0 to 0.99 in hundredths. A null text scores 0."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import COLOURS, REGIONS, VARIETALS
from .prices import YEAR
from .text import QUOTES, let, quality_text, to_fixed

ACCEPTED = 0.55


def unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), to_fixed(x)))


def _base(plain: Column) -> Column:
    """What a text's words are worth; ``plain`` is its ``quality_text``. Only words with a letter count.

    All are counted on the whole string by compiled functions: arrays of words, and functions over them, are interpreted. What nearly every word
    would match is counted by what few do (words without letters, short words), as each match costs.
    """
    def of(q: Column) -> Column:
        count = lambda pattern: F.size(F.regexp_extract_all(q, F.lit(pattern), F.lit(0)))
        return F.struct(
            F.length(q).alias("all"), F.length(F.replace(q, F.lit(" "), F.lit(""))).alias("size"), count("(?:^| )[^a-z ]+(?= |$)").alias("mute"), count("(?:^| )(?:[a-z][^ ]?|[^a-z ][a-z])(?= |$)").alias("short"), count(r"(?:^| )([a-z])\1+(?= |$)").alias("same"),
            q.rlike("(?:^| )(?=[^ ]*[a-z])[^ ]{5}").alias("long"), q.rlike("[aeiouy]").alias("voiced"), q.rlike("[aeiouy][^ ]* (?:[^ ]+ )*?[^ ]*[aeiouy]").alias("twice"),
            (~q.rlike("[aeiouy]") & q.rlike("(?:^| )(?=[^ ]{1,3}(?: |$))[^ ]*[a-z]")).alias("bare"), F.length(F.translate(q, "abcdefghijklmnopqrstuvwxyz", "")).alias("other"),
        )

    def told(x: Column) -> Column:
        n = F.when(x["all"] == 0, 0).otherwise(x["all"] - x["size"] + 1 - x["mute"])
        return F.struct(n.alias("n"), (n - x["short"]).alias("strong"), (x["all"] - x["other"]).alias("letters"), *[x[f].alias(f) for f in ("short", "same", "long", "voiced", "twice", "bare", "size")])

    def summed(x: Column) -> Column:
        # in the SQL's order of terms, as sums that end at half a hundredth depend on it
        gain = F.lit(0.35) * x["letters"] / F.greatest(F.lit(1), x["size"]) + F.when(x["strong"] >= 2, 0.25).when(x["strong"] == 1, 0.12).otherwise(0.0)
        gain = gain + F.when(x["long"], 0.08).otherwise(0.0) + F.when(F.when(x["n"] >= 2, x["twice"]).otherwise(x["voiced"] | (x["n"] == 0)), 0.12).otherwise(0.0)
        cost = lambda f: F.least(F.lit(0.14), F.try_divide(F.lit(0.14) * x[f], x["n"]))
        return F.when(x["n"] > 0, F.struct(gain.alias("gain"), cost("short").alias("short"), cost("same").alias("same"), F.when(x["bare"], 0.18).otherwise(0.0).alias("bare")))
    return let(let(let(F.lower(plain), of), told), summed)


def _of_base(base: Column, text: Column) -> Column:
    any_of = lambda *marks: reduce(or_, (text.contains(m) for m in marks))
    quotes, commas = F.when(any_of(*QUOTES), 0.08).otherwise(0.0), F.when(any_of(",", " - ", ":"), 0.05).otherwise(0.0)
    return let(base, lambda b: F.when(b.isNotNull(), unit(b["gain"] + quotes + commas - b["short"] - b["same"] - b["bare"])).otherwise(F.lit(0.0)))


def _notes(base: Column, low: Column) -> Column:
    add = lambda test, x: F.when(test, x).otherwise(0.0)
    any_of = lambda t, hints: reduce(or_, (t.contains(h) for h in hints))

    def of(t: Column) -> Column:
        score = _of_base(base, t) * 0.8 + add(t.contains(","), 0.05) + add(any_of(t, VARIETALS), 0.08) + add(any_of(t, REGIONS), 0.08)
        return F.when(t != "", unit(score + add(any_of(t, COLOURS), 0.05) + add((t.contains("19") | t.contains("20")) & t.rlike(YEAR), 0.04))).otherwise(F.lit(0.0))
    return let(low, of)


def text_quality(text: Column) -> Column:
    return _of_base(_base(quality_text(text)), F.coalesce(text, F.lit("")))


def notes_quality(text: Column) -> Column:
    return qualities(text)["notes_quality"]


def qualities(text: Column) -> Column:
    """struct(quality, notes_quality) of a text, which is folded and counted once for both."""
    scored = lambda x: F.struct(_of_base(x["base"], F.coalesce(text, F.lit(""))).alias("quality"), _notes(x["base"], F.lower(x["plain"])).alias("notes_quality"))
    return let(let(quality_text(text), lambda q: F.struct(q.alias("plain"), _base(q).alias("base"))), scored)


def confidence(title_q: Column, label_q: Column, region_q: Column, notes_q: Column, price: Column, varietal: Column, color: Column, year: Column) -> Column:
    """struct(confidence, rejected) of a candidate from its texts' qualities and which fields it has."""
    has = lambda c: F.coalesce(c.cast("string") != "", F.lit(False))
    signals = sum((x.cast("int") for x in (label_q >= 0.4, region_q >= 0.4, has(price), has(varietal), has(color), has(year), notes_q >= 0.45)), F.lit(0))
    score = title_q * 0.42 + label_q * 0.12 + region_q * 0.1 + notes_q * 0.18 + F.least(signals, F.lit(4)) * 0.05
    for field, worth in ((price, 0.08), (varietal, 0.06), (year, 0.05), (color, 0.03)):
        score = score + F.when(has(field), worth).otherwise(0.0)
    score = unit(score - F.when((title_q < 0.32) & (notes_q < 0.28) & (signals < 2), 0.25).otherwise(0.0))
    poor = (title_q < 0.28) & (notes_q < 0.3) & (signals < 2)
    return F.struct(score.alias("confidence"), (poor | (score < ACCEPTED)).alias("rejected"))
