"""Tests of single menu lines, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import COLOURS, DESCRIPTORS, GEOGRAPHY, MORE_REGIONS, NOT_AN_ITEM, REGIONS, SERVING, VARIETALS
from .prices import SHORT_YEAR, YEAR, inline_price, likely_price, menu_price
from .text import alpha_tokens, corrected, first_hint, fold_accents, let, quality_text, squeeze, without_markers, without_repeats, word, words

QUOTED = "[‘'“\"][^’'\"”]+[’'\"”]"
# Fixed value: a style, a mark and a region.
_STYLE_REGION = r"(?i)^(chilled\s+red|red|white|orange|sparkling|rose|rosé)\s*[-—:]\s*(.+)$"
_NV = r"(?i)^(?:NV|N\.V\.)"


def any_of(hints: list[str], end: str = "") -> str:
    return "(?i)" + word("|".join(map(re.escape, hints))) + end


def tidy(line: Column) -> Column:
    return squeeze(F.regexp_replace(corrected(without_markers(line)), ">+", " "))


def clean_region(text: Column) -> Column:
    """A region without marks and repeats, cut after its last known geographic word's first place."""
    known = r"(?i)^(.*?(?<![A-Za-z0-9_])(?:" + "|".join(GEOGRAPHY) + r"))(?:(?![A-Za-z0-9_]).*)?$"

    def of(plain: Column) -> Column:
        tail = F.regexp_extract(plain, known, 1)
        return F.trim(F.regexp_replace(F.when(tail != "", F.trim(tail)).otherwise(plain), r"[,:;/-]+$", ""))
    return let(squeeze(without_repeats(without_markers(corrected(text)))), of)


def style_region(line: Column) -> Column:
    """struct(style, color, region) of a line that names only a style and a region; else null."""
    def of(x: Column) -> Column:
        color = first_hint(x["style"], ["red", "white", "orange", "sparkling", "rose", "rosé"])
        return F.when((x["style"] != "") & x["region"].rlike("[A-Za-z]"), F.struct(x["style"].alias("style"), color.alias("color"), x["region"].alias("region")))

    split = lambda plain: F.struct(F.lower(F.trim(F.regexp_extract(plain, _STYLE_REGION, 1))).alias("style"), clean_region(F.regexp_extract(plain, _STYLE_REGION, 2)).alias("region"))
    return F.when(line.rlike("(?i)^\\W*(?:chilled|red|white|orange|sparkling|ros)"), let(let(tidy(line), split), of))


def is_serving_line(line: Column) -> Column:
    def of(tokens: Column) -> Column:
        other = F.filter(tokens, lambda t: ~t.isin(SERVING) & ~t.rlike(r"^\d{1,3}(?:\.\d{2})?$"))
        return F.exists(tokens, lambda t: t.isin(SERVING)) & (F.size(other) <= 1)
    blocked = line.rlike("[‘'“\"]") | line.rlike(YEAR) | line.rlike(r"\s+-\s+")
    return ~blocked & let(words(F.lower(quality_text(line))), of) & style_region(line).isNull()


def is_no_item(line: Column) -> Column:
    """Column heads, serving sizes, empty lines, prose of over 200 characters, and lines about other things."""
    plain = squeeze(F.regexp_replace(F.lower(line), r"[^a-z0-9\s]", " "))
    rest = lambda p: (p == "") | p.rlike(word("ipa")) | (F.length(p) > 200) | first_hint(p, NOT_AN_ITEM).isNotNull()
    return F.trim(line).rlike(r"^[A-Za-z]\s*/\s*[A-Za-z]$") | is_serving_line(line) | let(plain, rest)


def capitalised(line: Column, least: str = "+") -> Column:
    bare = F.transform(words(line), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}'’.-]+$", ""))
    return F.size(F.filter(bare, lambda w: w.rlike(rf"^\p{{Lu}}[\p{{L}}'’.-]{least}$")))


def continuation(line: Column) -> Column:
    """struct(vintage, region) of a line that only goes on with a year or a region; else null."""
    lead = r"^(?:19|20)\d{2}(?![A-Za-z0-9_])"

    def parts(plain: Column) -> Column:
        year = F.when(plain.rlike(lead), F.substring(plain, 1, 4).cast("int"))
        rest = F.when(plain.rlike(lead), F.regexp_replace(F.trim(F.regexp_replace(plain, lead, "")), r"^[-,:]\s*", "")).otherwise(plain)
        return F.struct(plain.alias("plain"), year.alias("year"), rest.alias("rest"))

    def more(x: Column) -> Column:
        low = F.lower(quality_text(x["rest"]))
        return F.struct(x["plain"].alias("plain"), x["year"].alias("year"), x["rest"].alias("rest"), low.alias("low"), F.size(alpha_tokens(x["rest"])).alias("n"), capitalised(x["plain"]).alias("caps"))

    def of(x: Column) -> Column:
        plain, year, low, n = x["plain"], x["year"], x["low"], x["n"]
        tail = low.rlike(any_of(GEOGRAPHY))
        descriptors = sum((low.contains(d).cast("int") for d in DESCRIPTORS), F.lit(0))
        wanted = tail | (year.isNotNull() & low.rlike(any_of(REGIONS)) & (n <= 4))
        blocked = plain.rlike(QUOTED) | plain.rlike(r"\s+-\s+") | plain.rlike(r"/\s*\$?\d+(?:\.\d{2})?(?![A-Za-z0-9_])")
        blocked = blocked | low.rlike(any_of([v for v in VARIETALS if v != "champagne"])) | low.rlike("(?i)" + word("domaine|chateau|château|winery|vineyards?|estate"))
        titled = year.isNull() & (n >= 4) & (x["caps"] >= 3) & ~plain.contains(",")
        keep = (plain != "") & n.between(2, 10) & wanted & ~blocked & ~titled & ~((descriptors >= 2) & ~tail) & style_region(plain).isNull() & ~is_serving_line(plain)
        named = lambda region: F.when((region != "") | year.isNotNull(), F.struct(year.alias("vintage"), F.when(region != "", region).alias("region")))
        return F.when(keep, let(clean_region(x["rest"]), named))
    return let(let(let(tidy(line), parts), more), of)


# What a place may lie in, and grape words that stand before it.
_PARENTS = ["france", "italy", "spain", "germany", "austria", "portugal", "greece", "hungary", "slovenia", "croatia", "switzerland", "georgia", "lebanon", "israel", "england", "japan", "australia", "new zealand", "argentina", "chile", "uruguay", "south africa", "canada", "mexico", "usa", "us", "united states", "california", "oregon", "washington", "new york", "virginia"]
_GRAPE_WORDS = ["chardonnay", "pinot", "noir", "gris", "grigio", "blanc", "sauvignon", "cabernet", "franc", "merlot", "malbec", "syrah", "shiraz", "grenache", "garnacha", "tempranillo", "riesling", "nebbiolo", "sangiovese", "barbera", "dolcetto", "zinfandel", "gamay", "chenin", "viognier", "gewurztraminer", "gruner", "veltliner", "albarino", "carignan", "mourvedre", "cinsault", "trousseau", "poulsard", "savagnin", "aligote", "melon", "muscadet", "rose", "orange"]
_PLACE_WORD = r"^(?:[A-ZÀ-Ý][\p{L}.'-]*|(?i:de|del|di|du|la|le|des|en|am|an|der))$"


def inline_region(text: Column) -> Column:
    """"place, parent" where a row ends with a place and a known country or state: after a closing quote, or as the last of three fields; else null."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), word(r"(?:19|20)\d{2}"), " ")
    bare = F.regexp_replace(squeeze(F.regexp_replace(bare, r"\s*/\s*\$?\d+(?:\.\d{2})?\s*$", " ")), r"[,\s]+$", "")
    after = r"^.*[‘’“”'\"`]\s*([^‘’“”'\"`]*)$"

    def fields(x: Column) -> Column:
        said = F.filter(F.transform(F.split(F.when(x["quoted"], F.regexp_extract(x["bare"], after, 1)).otherwise(x["bare"]), ","), lambda p: F.trim(p)), lambda p: p != "")
        return F.struct(said.alias("said"), x["quoted"].alias("quoted"))

    def parted(x: Column) -> Column:
        plain = lambda w: F.regexp_replace(F.lower(fold_accents(w)), "[^a-z]", "")
        place = F.array_join(F.filter(words(F.coalesce(F.get(x["said"], F.size(x["said"]) - 2), F.lit(""))), lambda w: ~plain(w).isin(_GRAPE_WORDS)), " ")
        return F.struct(place.alias("place"), F.get(x["said"], F.size(x["said"]) - 1).alias("parent"), (F.size(x["said"]) >= F.when(x["quoted"], 2).otherwise(3)).alias("enough"))

    def decided(x: Column) -> Column:
        folded = lambda t: F.lower(fold_accents(t))
        parent = F.regexp_replace(folded(x["parent"]), r"\.$", "")
        placed = x["place"].rlike(r"^[^\d‘’“”'\"`]{1,40}$") & F.forall(F.split(x["place"], r"\s+"), lambda w: w.rlike(_PLACE_WORD))
        return F.when(x["enough"] & parent.isin(_PARENTS) & placed & (folded(x["place"]) != parent), F.concat(x["place"], F.lit(", "), x["parent"]))
    quoted = lambda b: F.struct(b.alias("bare"), F.regexp_extract(b, after, 1).contains(",").alias("quoted"))
    return let(let(let(let(bare, quoted), fields), parted), decided)


def is_region_only(line: Column) -> Column:
    parts = F.split(F.lower(line), r"\s*,\s*")
    return (F.size(parts) >= 2) & F.forall(parts, lambda p: p.isin(REGIONS + GEOGRAPHY + MORE_REGIONS)) & F.element_at(parts, -1).isin(GEOGRAPHY)


def ends_in_state(line: Column) -> Column:
    return line.rlike(r",\s*[A-Z]{2}$")


def is_varietal_fragment(line: Column) -> Column:
    one = F.trim(line)
    return one.rlike(r"^[A-Z][A-Za-zÀ-ÿ]+(/[A-Z][A-Za-zÀ-ÿ]+)+$") | (one.rlike("^[A-Za-zÀ-ÿ]+$") & first_hint(one, VARIETALS).isNotNull())


def names_varietal(line: Column) -> Column:
    """A known varietal ends the line and words stand before it."""
    def one(hint: str) -> Column:
        pattern = rf"(?i)^(.*?)(?<![A-Za-z0-9_]){hint}$"
        return line.rlike(pattern) & (F.size(alpha_tokens(F.regexp_extract(line, pattern, 1))) > 0)
    test = one(VARIETALS[0])
    for hint in VARIETALS[1:]:
        test = test | one(hint)
    return test


def has_price(line: Column) -> Column:
    return inline_price(line)["price"].isNotNull() | menu_price(line).isNotNull()


def describes_varietal(line: Column) -> Column:
    """Prose about a varietal; of a line without a price."""
    said = r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(VARIETALS) + r")(?![A-Za-z0-9_])(?:\s+(?:with|showing|offering)(?![A-Za-z0-9_])|.*(?<![A-Za-z0-9_])(?:notes?|aromas?|flavou?rs?) of(?![A-Za-z0-9_]))"
    return line.rlike(said) & ~line.rlike(YEAR) & ~line.rlike(QUOTED)


def has_identity(line: Column) -> Column:
    return line.rlike(YEAR) | line.rlike(_NV + r"\s") | line.rlike(QUOTED) | first_hint(line, VARIETALS).isNotNull() | has_price(line)


def facts(line: Column) -> Column:
    """What several tests below need to know of a line: struct(go, serving, priced, described, named)."""
    one = lambda priced: F.struct(continuation(line).alias("go"), is_serving_line(line).alias("serving"), priced.alias("priced"), (~priced & describes_varietal(line)).alias("described"), names_varietal(line).alias("named"))
    return let(has_price(line), one)


def continues_title(line: Column, known: Column) -> Column:
    """struct(kind, rest, varietal): "no" never; "named" unless the title has an identity; "perhaps" if ``rest``
    holds and not both the line and the title name a varietal."""
    never = known["described"] | known["priced"] | style_region(line).isNotNull() | known["go"].isNotNull() | line.rlike(YEAR) | line.rlike(_NV + "(?![A-Za-z0-9_])")
    never = never | line.rlike(QUOTED) | line.rlike(r"\s+-\s+") | line.rlike(r"\s+-$") | is_varietal_fragment(line)

    def short(every: Column) -> Column:
        alpha = F.size(F.filter(every, lambda w: w.rlike("[A-Za-z]")))
        return F.size(every).between(1, 6) & (alpha > 0) & ((F.try_divide(capitalised(line, "*"), alpha) >= 0.6) | first_hint(line, COLOURS + VARIETALS).isNotNull())

    kind = F.when(never, "no").when(known["named"], "named").otherwise("perhaps")
    rest = ends_in_state(line) | (~line.contains(",") & let(words(line), short))
    return F.struct(kind.alias("kind"), F.coalesce(rest, F.lit(False)).alias("rest"), first_hint(line, VARIETALS).isNotNull().alias("varietal"))


def goes_on(how: Column, title: Column) -> Column:
    """Whether a line with ``continues_title`` goes on with the title."""
    return F.when(how["kind"] == "no", False).otherwise(let(title, lambda t: F.when(how["kind"] == "named", ~has_identity(t)).otherwise(how["rest"] & ~(how["varietal"] & first_hint(t, VARIETALS).isNotNull()))))


def starts_title(line: Column, known: Column) -> Column:
    bare = r"^(.*\S)\s+(\$?\d{1,3}(?:\.\d{2})?)\s*$"
    priced = likely_price(F.regexp_extract(line, bare, 2)) & (F.size(F.filter(alpha_tokens(F.regexp_extract(line, bare, 1)), lambda t: F.length(t) >= 2)) >= 2)
    marks = line.rlike(YEAR) | line.rlike(SHORT_YEAR) | line.rlike(_NV + "(?![A-Za-z0-9_])") | line.rlike(QUOTED) | line.rlike(r"\s+-\s+") | line.rlike(r"\s+-$")
    slashed = line.rlike(r"/\s*\$?\d+(?:\.\d{2})?(?![A-Za-z0-9_])")
    titled = (capitalised(line) >= 3) & (slashed | (~line.contains(",") & (F.size(words(line)) >= 4)))
    return ~(known["described"] | known["serving"] | known["go"].isNotNull()) & (known["named"] | priced | marks | titled)


def row_evidence(line: Column, known: Column) -> Column:
    """Enough to take a line for an item above the first heading."""
    short = ~line.contains(",") & (F.size(words(line)) <= 12) & known["named"]
    return line.rlike(YEAR) | line.rlike(_NV + r"\s") | line.rlike(QUOTED) | known["priced"] | short


def producer_and_label(title: Column, year: Column) -> Column:
    """struct(producer, label): by a quoted label, else a varietal at the end, else a separator, else after two words."""
    quoted = r"^(?:(.*?)\s+)?(?:\"([^\"]+)\"|“([^”]+)”|[‘']((?:[^’']|[’'](?=\p{L}))+)[’'])\s*(.*)$"
    none = lambda c: F.when(c != "", c)
    pair = lambda p, q: F.struct(none(p).alias("producer"), none(q).alias("label"))
    rest = lambda a, n: F.trim(F.array_join(F.slice(a, n + 1, F.greatest(F.size(a), F.lit(1))), " "))

    def of(plain: Column) -> Column:
        part = lambda g: F.regexp_extract(plain, quoted, g)
        said = F.trim(F.concat(part(2), part(3), part(4)))
        label = let(F.regexp_replace(F.trim(part(5)), r"^[-,]\s*", ""), lambda tail: F.when(tail.rlike(",") | tail.rlike(YEAR) | (tail == ""), said).otherwise(F.concat_ws(" ", said, tail)))
        out = F.when(plain.rlike(quoted), pair(F.regexp_replace(F.trim(part(1)), r"\s+-\s*$", ""), label))
        for hint in sorted(VARIETALS, key=len, reverse=True):
            pattern = r"(?i)^(.*\S)\s+(" + hint.replace(" ", r"\s+") + ")$"
            out = out.when(plain.rlike(pattern), pair(F.trim(F.regexp_extract(plain, pattern, 1)), F.regexp_extract(plain, pattern, 2)))
        two = F.filter(F.split(plain, " "), lambda w: w != "")
        other = lambda parts: F.when(F.size(parts) >= 2, pair(F.get(parts, F.lit(0)), rest(parts, 1))).otherwise(let(two, lambda every: pair(F.array_join(F.slice(every, 1, 2), " "), rest(every, 2))))
        return out.otherwise(let(F.filter(F.split(plain, r"\s{2,}| - |, "), lambda p: p != ""), other))

    bare = F.when(year.isNotNull(), F.regexp_replace(title, F.concat(F.lit("^(.*?)"), year.cast("string")), F.lit("$1"))).otherwise(title)
    return let(F.regexp_replace(F.trim(bare), r"(?i)^(?:NV|N\.V\.)\s+", ""), of)


def display_fold(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def plain_key(text: Column) -> Column:
    return squeeze(F.lower(text))


