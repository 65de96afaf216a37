"""Token sets and how well they match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, normal_field

# Words that carry no identity of their own.
VARIETAL_TOKENS = ["cabernet", "chardonnay", "grenache", "grigio", "gruner", "malbec", "merlot", "mourvedre", "noir", "pinot", "riesling", "sangiovese", "sauvignon", "shiraz", "syrah", "tempranillo", "veltliner", "viognier", "zinfandel"]
STOPWORDS = ["a", "an", "and", "contact", "czech", "da", "de", "del", "della", "di", "do", "dos", "du", "la", "le", "nat", "of", "pet", "regional", "republic", "skin", "terre", "the", "valley", "verde", "vin", "vino", "vinho", "wine", "wines"]
COUNTRIES = ["argentina", "australia", "france", "germany", "italy", "japan", "portugal", "spain", "states", "united"]
CONCEPTS = {"bianco": "white", "blanc": "white", "blanco": "white", "branco": "white", "frizzante": "sparkling", "red": "red", "reserve": "reserve", "reserva": "reserve", "ros": "rose", "rose": "rose", "rosado": "rose", "rosato": "rose", "rosso": "red", "rouge": "red", "sparkling": "sparkling", "spumante": "sparkling", "superior": "superior", "tinto": "red", "white": "white"}
EXACT_CONCEPTS = ["bianco", "blanc", "blanco", "branco", "frizzante", "reserve", "reserva", "ros", "rose", "rosado", "rosato", "rosso", "rouge", "spumante", "superior", "tinto"]
CONCEPT_PENALTY = {"red": 0.12, "reserve": 0.14, "rose": 0.2, "sparkling": 0.16, "superior": 0.12, "white": 0.16}


def tokens(text: Column) -> Column:
    return F.filter(F.split(normal_field(text), " "), lambda t: t != "")


def identity_tokens(text: Column) -> Column:
    """Tokens without stop words, countries, concepts, varietals, years and volumes; repeats stay."""
    out = [*STOPWORDS, *COUNTRIES, *CONCEPTS, *VARIETAL_TOKENS]
    return F.filter(tokens(text), lambda t: (F.length(t) > 1) & ~t.isin(out) & ~t.rlike(r"^(19|20)\d{2}$") & ~t.rlike(r"^\d+(?:l|ml)$"))


def pooled(*texts: Column) -> Column:
    return pool(*[identity_tokens(t) for t in texts])


def pool(*token_sets: Column) -> Column:
    """``pooled`` of texts whose identity tokens are known."""
    return F.array_distinct(F.flatten(F.array(*token_sets)))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def field_score(left: Column, right: Column) -> Column:
    """1 for equal fields, 0.8 if one holds the other, else the share of common tokens."""
    def of(x: Column) -> Column:
        a, b = x["a"], x["b"]
        share = jaccard(F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " ")))
        return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.8).otherwise(share)
    return let(F.struct(normal_field(left).alias("a"), normal_field(right).alias("b")), of)


def fuzzy_weight(token: Column, pool: Column) -> Column:
    """1 if the pool has the token, 0.8 if it has one an edit away (both of four letters or more), else 0."""
    near = F.exists(pool, lambda p: (F.length(p) >= 4) & (F.levenshtein(token, p, 1) >= 0))
    return F.when(F.array_contains(pool, token), 1.0).when((F.length(token) >= 4) & near, 0.8).otherwise(0.0)


def fuzzy_overlap(mine: Column, pool: Column) -> Column:
    """The mean weight of my tokens in the pool; repeats count."""
    total = F.aggregate(mine, F.lit(0.0), lambda s, t: s + fuzzy_weight(t, pool))
    return F.when((F.size(mine) > 0) & (F.size(pool) > 0), total / F.size(mine)).otherwise(0.0)


def exact_overlap(mine: Column, pool: Column) -> Column:
    return F.when((F.size(mine) > 0) & (F.size(pool) > 0), F.size(F.filter(mine, lambda t: F.array_contains(pool, t))) / F.size(mine)).otherwise(0.0)


def pooled_f1(mine: Column, theirs: Column) -> Column:
    """The harmonic mean of both sides' fuzzy coverage."""
    def of(x: Column) -> Column:
        return F.when(x["p"] + x["r"] > 0, 2 * x["p"] * x["r"] / (x["p"] + x["r"])).otherwise(0.0)
    return let(F.struct(fuzzy_overlap(mine, theirs).alias("p"), fuzzy_overlap(theirs, mine).alias("r")), of)


def recovery(mine: Column, matched: Column, elsewhere: Column) -> Column:
    """Of my tokens that ``matched`` lacks, the share found elsewhere."""
    return let(F.filter(mine, lambda t: ~F.array_contains(matched, t)), lambda rest: exact_overlap(rest, elsewhere))


def concepts(*texts: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONCEPTS.items() for x in pair])
    every = F.flatten(F.array(*[tokens(t) for t in texts]))
    return F.array_distinct(F.filter(F.transform(every, lambda t: F.try_element_at(table, t)), lambda c: c.isNotNull()))


def match_score(c: dict[str, Column], p: dict[str, Column]) -> Column:
    """0 to 1: a candidate (producer, label, varietal, region, raw_text, color, vintage) against a profile (the first four and vintage)."""
    ids = F.struct(*[identity_tokens(c[f]).alias(f"c_{f}") for f in ("producer", "label", "varietal", "region", "raw_text")], *[identity_tokens(p[f]).alias(f"p_{f}") for f in ("producer", "label", "varietal", "region")])

    def of(x: Column) -> Column:
        mine = lambda *fs: F.array_distinct(F.flatten(F.array(*[x[f"c_{f}"] for f in fs])))
        theirs = lambda *fs: F.array_distinct(F.flatten(F.array(*[x[f"p_{f}"] for f in fs])))
        coverage = lambda a, b: fuzzy_overlap(x[f"c_{a}"], theirs(*b))
        score = pooled_f1(mine("producer", "label", "varietal", "region", "raw_text"), theirs("producer", "label", "varietal", "region")) * 0.5
        producer = field_score(c["producer"], p["producer"])
        label = coverage("label", ["label"]) * F.when(F.size(x["c_label"]) == 1, 0.6).otherwise(1.0)
        score = score + producer * 0.18 + label * 0.18
        score = score + recovery(x["c_label"], theirs("label"), theirs("producer")) * 0.03 + recovery(x["c_label"], theirs("label", "producer"), theirs("region")) * 0.03
        score = score + coverage("varietal", ["varietal"]) * 0.06 + exact_overlap(F.filter(x["c_region"], lambda t: ~F.array_contains(x["c_label"], t)), theirs("region")) * 0.03
        score = score + F.when(c["vintage"] == p["vintage"], 0.1).otherwise(0.0) + coverage("raw_text", ["producer", "label", "region"]) * 0.02
        exact = lambda d: F.filter(F.flatten(F.array(*[tokens(d[f]) for f in ("label", "varietal", "region")])), lambda t: t.isin(EXACT_CONCEPTS))
        score = score + F.when(F.arrays_overlap(exact(c), exact(p)), 0.03).otherwise(0.0)
        own = concepts(c["label"], c["varietal"], c["region"], c["raw_text"], c["color"])
        worth = F.create_map(*[F.lit(v) for pair in CONCEPT_PENALTY.items() for v in pair])
        missing = F.aggregate(F.array_except(concepts(p["label"], p["varietal"], p["region"]), own), F.lit(0.0), lambda s, k: s + F.coalesce(F.try_element_at(worth, k), F.lit(0.0)))
        pool = mine("producer", "label", "region", "raw_text")
        other = (producer >= 0.5) & (F.size(x["p_label"]) > 0) & (F.size(pool) > 0) & ~F.exists(x["p_label"], lambda t: fuzzy_weight(t, pool) > 0)
        score = score - F.least(F.lit(0.3), missing) - F.when(other, 0.3).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return let(ids, of)
