"""Style of a drink from free text, and the taste that the style suggests.

The dictionary is a parameter: rows of (alias, style, tier, style if white, style if red). ``ENTRIES`` is a small one of
style words and common grapes; appellations and more grapes are given by the caller. Longer aliases are taken first and
don't overlap; then the lowest tier and the earliest place win.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .taste import clamped
from .text import let, normal_field, style_text

# Body, acidity, tannin and sweetness of each style.
VECTORS = {
    "sauvignon_blanc": (2, 5, 1, 1), "crisp_white": (2, 5, 1, 1), "light_white": (2, 4, 1, 1), "riesling_dry": (2, 4, 1, 1), "riesling_sweet": (2, 4, 1, 4), "chardonnay": (3, 3, 1, 1), "chardonnay_unoaked": (2, 4, 1, 1), "chenin_blanc": (3, 4, 1, 2), "pinot_grigio": (2, 3, 1, 1), "aromatic_white": (3, 3, 1, 2), "full_white": (4, 2, 1, 1), "medium_white": (3, 3, 1, 1),
    "light_red": (2, 4, 2, 1), "pinot_noir": (3, 4, 2, 1), "medium_red": (3, 4, 3, 1), "cabernet_sauvignon": (4, 3, 4, 1), "merlot": (4, 3, 3, 1), "syrah": (4, 3, 4, 1), "grenache": (4, 3, 3, 1), "tempranillo": (4, 3, 3, 1), "malbec": (4, 3, 4, 1), "nebbiolo": (4, 5, 5, 1), "sangiovese": (3, 4, 4, 1), "barbera": (3, 5, 2, 1), "zinfandel": (5, 3, 3, 1), "big_tannic_red": (5, 3, 5, 1), "amarone": (5, 3, 3, 2),
    "rose_dry": (2, 4, 1, 1), "champagne": (3, 5, 1, 1), "prosecco": (2, 4, 1, 2), "default_sparkling": (2, 4, 1, 1), "sparkling_red": (3, 4, 2, 2), "sweet_sparkling": (1, 3, 1, 4), "orange_wine": (3, 4, 2, 1),
    "dessert_white": (4, 4, 1, 5), "port_ruby": (5, 3, 3, 5), "port_tawny": (4, 3, 1, 5), "madeira": (4, 4, 1, 4), "sherry_fino": (2, 3, 1, 1), "sherry_amontillado": (3, 3, 1, 1), "sherry_oloroso": (4, 2, 1, 1), "sherry_sweet": (5, 2, 1, 5), "sake": (2, 2, 1, 2), "sake_nigori": (3, 2, 1, 4), "sake_sparkling": (2, 3, 1, 3), "umeshu": (3, 3, 1, 5), "default_white": (2, 4, 1, 1), "default_red": (4, 3, 3, 1),
}
# Style words (tier 0) and common grapes (tier 1).
STYLES = {
    "sake_nigori": ["nigori", "nigorizake"], "sake_sparkling": ["sparkling sake", "awa sake"], "sake": ["junmai", "ginjo", "daiginjo", "honjozo", "sake", "nihonshu", "kimoto", "yamahai", "namazake"], "umeshu": ["umeshu", "plum wine"],
    "orange_wine": ["orange wine", "skin contact", "skin fermented", "amber wine", "ramato", "macerated white"],
    "default_sparkling": ["pet nat", "petillant naturel", "pet nat rose", "col fondo", "ancestral", "sparkling", "spumante", "espumante", "sekt", "mousseux", "metodo classico", "methode traditionnelle", "traditional method", "brut", "extra brut", "brut nature", "zero dosage", "frizzante"],
    "dessert_white": ["late harvest", "noble rot", "botrytis", "vendange tardive", "dessert wine", "sweet wine", "vin doux naturel"], "rose_dry": ["rose", "rosado", "rosato", "rosat", "clairet", "blush"],
}
GRAPES = {
    "sauvignon_blanc": ["sauvignon blanc", "fume blanc", "sauvignon"], "cabernet_sauvignon": ["cabernet sauvignon", "cabernet"], "medium_red": ["cabernet franc", "cab franc", "dolcetto", "mencia"], "merlot": ["merlot", "carmenere", "montepulciano"], "pinot_noir": ["pinot noir", "spatburgunder", "pinot nero", "meunier"], "pinot_grigio": ["pinot grigio", "pinot gris"], "light_white": ["pinot blanc", "vermentino", "trebbiano"],
    "chardonnay": ["chardonnay"], "riesling_dry": ["riesling"], "chenin_blanc": ["chenin blanc", "chenin"], "syrah": ["syrah", "shiraz"], "big_tannic_red": ["petite sirah", "mourvedre", "monastrell", "tannat", "aglianico"], "grenache": ["grenache", "garnacha"], "full_white": ["grenache blanc", "marsanne", "roussanne"], "tempranillo": ["tempranillo"], "malbec": ["malbec", "cot"], "nebbiolo": ["nebbiolo"], "sangiovese": ["sangiovese", "brunello"],
    "barbera": ["barbera"], "zinfandel": ["zinfandel", "primitivo"], "light_red": ["gamay", "cinsault"], "sparkling_red": ["lambrusco"], "crisp_white": ["gruner veltliner", "albarino", "assyrtiko", "muscadet", "verdejo"], "aromatic_white": ["viognier", "gewurztraminer", "muscat", "moscato", "torrontes"], "medium_white": ["fiano", "godello", "semillon"],
}
# Colour words, styles that are red, and drinks of another kind.
RED_WORDS = ["red", "rouge", "rosso", "tinto", "tinta", "rot", "rotwein", "vermelho", "rojo", "negre"]
WHITE_WORDS = ["white", "blanc", "bianco", "blanco", "branco", "weiss", "weisswein", "blanca", "bianca"]
ROSE_WORDS = ["rose", "rosado", "rosato", "rosat"]
RED_STYLES = ["light_red", "pinot_noir", "medium_red", "cabernet_sauvignon", "merlot", "syrah", "grenache", "tempranillo", "malbec", "nebbiolo", "sangiovese", "barbera", "zinfandel", "big_tannic_red", "amarone", "default_red"]
WHITE_STYLES = ["sauvignon_blanc", "crisp_white", "light_white", "riesling_dry", "chardonnay", "chardonnay_unoaked", "chenin_blanc", "pinot_grigio", "aromatic_white", "full_white", "medium_white", "default_white"]
SPARKLING = ["champagne", "prosecco", "default_sparkling"]
OTHER_DRINKS = ["tequila", "mezcal", "whisky", "whiskey", "bourbon", "scotch", "single malt", "vodka", "gin", "rum", "rhum", "cognac", "armagnac", "calvados", "brandy", "grappa", "eau de vie", "pisco", "soju", "shochu", "baijiu", "liqueur", "amaro", "aperitivo", "bitters", "beer", "lager", "ale", "pale ale", "ipa", "stout", "pilsner", "porter", "cider", "sidra", "kombucha", "cocktail", "mocktail", "soda", "tonic", "juice", "tea", "coffee", "espresso", "water", "lemonade"]

Entry = tuple[str, str, int, str | None, str | None]
ENTRIES: list[Entry] = [(a, k, tier, None, None) for tier, names in ((0, STYLES), (1, GRAPES)) for k, aliases in names.items() for a in aliases]


def says(text: Column, words: list[str]) -> Column:
    """A padded text has one of the words."""
    return text.rlike(" (?:" + "|".join(words) + ") ")


def is_other_drink(text: Column) -> Column:
    return says(style_text(text), OTHER_DRINKS)


def _table(entries: Iterable[Entry]) -> Column:
    rows = sorted(((a, k, 0 if t == 2 and k in SPARKLING else t, w, r) for a, k, t, w, r in entries), key=lambda e: -len(e[0]))
    return F.array(*[F.struct(F.lit(f" {a} ").alias("needle"), F.lit(t).alias("tier"), F.lit(k).alias("key"), F.lit(w).cast("string").alias("white"), F.lit(r).cast("string").alias("red")) for a, k, t, w, r in rows])


def style_key(text: Column, entries: Iterable[Entry] = tuple(ENTRIES)) -> Column:
    """The style of a text, null without evidence."""
    match = "array<struct<tier:int,start:int,key:string,white:string,red:string>>"
    table = _table(entries)

    def of(padded: Column) -> Column:
        here = F.filter(table, lambda e: padded.contains(e["needle"]))

        def step(s: Column, e: Column) -> Column:
            # taken words become marks, so that a shorter alias can't have them
            start = F.instr(s["text"], e["needle"])
            masked = F.replace(s["text"], e["needle"], F.concat(F.lit(" "), F.repeat(F.lit("#"), F.length(e["needle"]) - 2), F.lit(" ")))
            row = F.struct(e["tier"].alias("tier"), start.cast("int").alias("start"), e["key"].alias("key"), e["white"].alias("white"), e["red"].alias("red"))
            return F.when(start > 0, F.struct(masked.alias("text"), F.concat(s["found"], F.array(row)).alias("found"))).otherwise(s)

        def decide(s: Column) -> Column:
            best, rest = F.array_min(s["found"]), s["text"]
            red = best["key"].isin(RED_STYLES)
            sparkling = F.array_min(F.filter(s["found"], lambda m: (m["tier"] == 0) & m["key"].isin(SPARKLING)))
            coloured = F.when(says(rest, ROSE_WORDS) & red, "rose_dry").when(says(rest, WHITE_WORDS) & red, F.coalesce(best["white"], F.lit("default_white"))).when(says(rest, RED_WORDS) & ~red & best["red"].isNotNull(), best["red"]).otherwise(best["key"])
            found = F.when((best["key"] == "default_sparkling") & F.exists(s["found"], lambda m: m["key"].startswith("sake")), "sake_sparkling").when((best["key"] == "rose_dry") & sparkling.isNotNull(), sparkling["key"]).otherwise(coloured)
            plain = F.when(says(rest, ROSE_WORDS), "rose_dry").when(says(rest, RED_WORDS + ["reds"]), "default_red").when(says(rest, WHITE_WORDS[:-1] + ["whites"]), "default_white")
            return F.when(F.size(s["found"]) > 0, found).otherwise(plain)

        start = F.struct(padded.alias("text"), F.array().cast(match).alias("found"))
        return let(F.aggregate(here, start, step), decide)

    return let(style_text(text), of)


def choose_style(raw: Column, label: Column, region: Column, varietal: Column, notes: Column, section: Column, color: Column, entries: Iterable[Entry] = tuple(ENTRIES)) -> Column:
    """struct(key, specific): from the item's own text, its varietal or notes; else, not specific, from its section or colour."""
    entries = tuple(entries)
    own = F.concat_ws(" ", raw, label, region)
    c = normal_field(color)
    by_color = F.when(c.contains("champagne"), "champagne").when(c.contains("rose"), "rose_dry").when(c.contains("sparkling"), "default_sparkling").when(c.contains("orange"), "orange_wine").when(c.contains("red"), "default_red").when(c.contains("white"), "default_white").otherwise("default_unknown")

    def of(first: Column) -> Column:
        sure = F.coalesce(first, style_key(varietal, entries), style_key(notes, entries))
        other = is_other_drink(own) & first.isNull()
        pick = lambda sure: F.struct(F.when(other, "default_unknown").otherwise(F.coalesce(sure, style_key(section, entries), by_color)).alias("key"), (~other & sure.isNotNull()).alias("specific"))
        return let(sure, pick)
    return let(style_key(own, entries), of)


def inferred_taste(style: Column, notes: Column) -> Column:
    """A taste struct from ``choose_style``, adjusted by words of the notes."""
    table = F.create_map(*[x for k, v in VECTORS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    has = lambda n, *ws: n.rlike("|".join(ws)).cast("int")

    def of(x: Column) -> Column:
        n, v = x["n"], x["v"]
        berry, chilled = has(n, "blackberry"), has(n, "chilled")
        tannin = F.when(chilled == 1, F.greatest(F.lit(1), v[2] - 1)).otherwise(v[2]) + berry
        sour = has(n, "sour cherry", "cranberry", "tangerine", "hibiscus", "quinine", "sea kelp")
        sweet = F.when(has(n, "dry", "quinine", "sea kelp") == 1, 1).otherwise(v[3])
        confidence = F.when(style["key"] == "default_unknown", 0.0).when(style["specific"], 0.45).otherwise(0.35)
        return F.struct(clamped(v[0] - chilled + berry).alias("body"), clamped(v[1] + sour).alias("acidity"), clamped(tannin).alias("tannin"), clamped(sweet).alias("sweetness"), F.lit("inferred").alias("source_mode"), confidence.alias("confidence"), F.array().cast("array<string>").alias("observed"))
    return let(F.struct(normal_field(notes).alias("n"), F.coalesce(F.try_element_at(table, style["key"]), F.array(*[F.lit(3)] * 4)).alias("v")), of)
