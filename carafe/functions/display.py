"""What a user is shown: titles, details, flavour groups, amounts and marks on scales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_accents, let, squeeze

# Labels of flavour groups that aren't their names.
GROUP_LABELS = {"non_oak": "Ageing", "microbio": "Yeasty", "earth": "Earthy", "oak": "Oaky", "citrus_fruit": "Citrus"}


def shown(text: Column) -> Column:
    return squeeze(F.coalesce(text, F.lit("")))


def compared(text: Column) -> Column:
    """Letters and digits only, folded."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(text)), r"[^\p{L}\p{N}]+", " "))


def title(producer: Column, label: Column, raw: Column, profile: Column) -> Column:
    """Producer and label, with the longest end of the one that begins the other said once; else the raw text or the profile's name."""
    def of(x: Column) -> Column:
        left, right = F.split(x["p"], " "), F.split(x["l"], " ")
        some = F.least(F.size(left), F.size(right))
        same = F.filter(F.sequence(F.lit(1), some), lambda n: compared(F.array_join(F.slice(left, -n, n), " ")) == compared(F.array_join(F.slice(right, 1, n), " ")))
        both = let(F.coalesce(F.array_max(same), F.lit(0)), lambda n: F.array_join(F.concat(left, F.slice(right, n + 1, F.size(right))), " "))
        none = lambda c: F.when(c != "", c)
        return F.coalesce(F.when((x["p"] != "") & (x["l"] != ""), both), none(x["p"]), none(x["l"]), none(shown(raw)), none(shown(profile)), F.lit("Unmatched"))
    return let(F.struct(shown(producer).alias("p"), shown(label).alias("l")), of)


def details(heading: Column, *parts: Column) -> Column:
    """The parts that the title doesn't say, once each, between dots."""
    texts = F.filter(F.array(*[shown(p.cast("string")) for p in parts]), lambda p: p != "")
    new = F.filter(texts, lambda p, i: (i == F.array_position(F.transform(texts, compared), compared(p)) - 1) & ~F.concat(F.lit(" "), compared(heading), F.lit(" ")).contains(F.concat(F.lit(" "), compared(p), F.lit(" "))))
    return F.array_join(new, " · ")


def group_key(name: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(name, F.lit("other"))))
    for pattern, by in ((r"[_\s]+", "-"), ("[^a-z0-9-]", ""), ("-+", "-"), ("^-|-$", "")):
        key = F.regexp_replace(key, pattern, by)
    return F.when(key == "", "other").otherwise(key)


def group_label(name: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    plain = F.initcap(F.trim(F.regexp_replace(raw, "[_-]+", " ")))
    known = F.create_map(*[F.lit(x) for pair in GROUP_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, raw), F.when(plain != "", plain), F.lit("Other"))


def image_url(url: Column) -> Column:
    plain = F.trim(url)
    return F.when(plain.startswith("//"), F.concat(F.lit("https:"), plain)).when(plain != "", plain)


def flavour_groups(groups: Column, most: int = 3) -> Column:
    """The best groups: array of struct(key, label, score, note_count, keywords, images, color), by score, count and label.

    ``groups`` is array<struct<group, color, score, keywords array<struct<name, image>>>>. Keywords are distinct in any case, the first spelling and the first image
    stay; groups without keywords go.
    """
    def one(g: Column) -> Column:
        named = F.filter(F.transform(g["keywords"], lambda k: F.struct(F.trim(k["name"]).alias("name"), image_url(k["image"]).alias("image"))), lambda k: k["name"] != "")

        def of(ks: Column) -> Column:
            lower = F.transform(ks, lambda k: F.lower(k["name"]))
            first = F.filter(ks, lambda k, i: F.array_position(lower, F.lower(k["name"])) == i + 1)
            image = lambda k: F.get(F.transform(F.filter(ks, lambda o: (F.lower(o["name"]) == F.lower(k["name"])) & o["image"].isNotNull()), lambda o: o["image"]), F.lit(0))
            score = F.when((g["score"] >= 0) & ~F.isnan(g["score"]), g["score"])
            return F.struct(group_key(g["group"]).alias("key"), group_label(g["group"]).alias("label"), score.alias("score"), F.size(first).alias("note_count"), F.transform(first, lambda k: k["name"]).alias("keywords"), F.transform(first, image).alias("images"), F.when(F.trim(g["color"]).rlike("(?i)^#[0-9a-f]{6}$"), F.trim(g["color"])).alias("color"))
        return let(named, of)

    kept = F.filter(F.transform(groups, one), lambda g: g["note_count"] > 0)
    keyed = F.transform(kept, lambda g: F.struct((-F.coalesce(g["score"], F.lit(0.0))).alias("a"), (-g["note_count"]).alias("b"), F.lower(fold_accents(g["label"])).alias("c"), g["label"].alias("d"), g["key"].alias("e"), g.alias("g")))
    best = F.slice(F.transform(F.array_sort(keyed), lambda k: k["g"]), 1, most)
    return F.when(F.size(best) > 0, best)


def flat_notes(groups: Column) -> Column:
    """All keywords of ``flavour_groups`` between commas."""
    return F.array_join(F.flatten(F.transform(groups, lambda g: g["keywords"])), ", ")


def money(amount: Column) -> Column:
    whole = amount == F.floor(amount)
    return F.concat(F.lit("$"), F.when(whole, F.format_number(amount, 0)).otherwise(F.format_number(amount, 2)))


def indicator_ratio(value: Column) -> Column:
    return (F.greatest(F.lit(1), F.least(F.lit(5), value)) - 1) / 4


def star_fill(rating: Column, star: int) -> Column:
    """How full the n-th star (from 1) is, 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), rating - (star - 1)))
