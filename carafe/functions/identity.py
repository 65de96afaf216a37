"""Whether a menu row and a catalogue entry are the same item: a score from 0 to 1 over weighted words. Vintages are compared apart."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_accents, identity_text, let, word

# Words by what they tell, other spellings, and how grapes are written.
STOP = ["a", "al", "and", "da", "dal", "dalla", "das", "de", "dei", "del", "della", "der", "des", "di", "do", "dos", "du", "e", "el", "en", "et", "il", "la", "las", "le", "les", "lo", "los", "of", "the", "und", "vom", "von", "y", "zu", "by", "from", "with", "cuvee", "vino", "vin", "vinho", "wein"]
PRODUCER_KINDS = ["azienda", "agricola", "bodega", "bodegas", "cantina", "cantine", "castello", "cave", "caves", "cellar", "cellars", "chateau", "company", "domaine", "domaines", "estate", "estates", "famiglia", "famille", "family", "fattoria", "maison", "podere", "quinta", "tenuta", "tenute", "vigneti", "vignobles", "vina", "vinedos", "vineyard", "vineyards", "weingut", "winery", "wines", "wine", "co", "sons", "fils", "freres", "herederos", "casa", "clos", "and"]
CLASSES = ["aoc", "aop", "ava", "doc", "docg", "doca", "dop", "igp", "igt", "vdp", "qualitatswein", "pradikatswein", "brut", "extra", "nature", "zero", "dosage", "sec", "demi", "dry", "trocken", "feinherb", "halbtrocken", "dolce", "reserve", "reserva", "riserva", "gran", "grand", "grande", "cru", "premier", "1er", "classico", "superiore", "crianza", "joven", "roble", "selection", "selezione", "vieilles", "vignes", "old", "vine", "vines", "red", "white", "rose", "rosado", "rosato", "rosso", "bianco", "blanc", "blanco", "blanca", "rouge", "tinto", "tinta", "branco", "orange", "sparkling", "spumante", "cremant", "cava", "frizzante", "sweet", "dessert", "blend", "estate", "single", "vineyard", "lieu", "dit", "nv", "mv", "blancs", "noirs", "millesime", "vintage"]
ROSE = ["rose", "rosado", "rosato", "rosat"]
GIVEN_NAMES = ["jean", "marc", "pierre", "paul", "louis", "jacques", "michel", "philippe", "francois", "claude", "henri", "andre", "bernard", "alain", "daniel", "patrick", "christophe", "olivier", "nicolas", "marie", "anne", "luc", "yves", "rene", "joseph", "georges", "charles", "maurice", "lucien", "jo", "jm", "jl", "jp", "giuseppe", "giovanni", "francesco", "antonio", "luigi", "mario", "paolo", "jose", "juan", "john", "james", "david", "peter", "michael", "robert"]
PLACES = ["france", "italy", "italia", "spain", "espana", "portugal", "germany", "deutschland", "austria", "osterreich", "usa", "us", "california", "ca", "oregon", "washington", "new", "zealand", "nz", "australia", "sa", "vic", "nsw", "wa", "argentina", "chile", "south", "africa", "greece", "hungary", "mexico", "uruguay", "lebanon", "england", "uk", "valley", "county", "coast", "hills", "mountains", "mountain", "region", "napa", "sonoma", "carneros", "willamette", "paso", "robles", "santa", "barbara", "cruz", "lucia", "monterey", "mendocino", "lodi", "edna", "russian", "river", "dundee", "columbia", "texas", "barossa", "eden", "mclaren", "vale", "clare", "adelaide", "yarra", "margaret", "hunter", "heathcote", "marlborough", "hawkes", "otago", "central", "mendoza", "uco", "colchagua", "maipo", "casablanca", "toscana", "tuscany", "piedmont", "piemonte", "veneto", "sicilia", "sicily", "puglia", "campania", "umbria", "lombardia", "friuli", "langhe", "alto", "adige", "bordeaux", "burgundy", "bourgogne", "rhone", "loire", "alsace", "champagne", "provence", "languedoc", "roussillon", "beaujolais", "rioja", "ribera", "duero", "priorat", "rias", "baixas", "jerez", "douro", "mosel", "rheingau", "pfalz", "wachau", "kamptal", "burgenland", "stellenbosch", "swartland", "zone", "northern", "southern", "cote", "cotes", "or", "nuits", "beaune"]
GRAPES = ["cabernet", "sauvignon", "merlot", "pinot", "noir", "gris", "grigio", "blanc", "chardonnay", "syrah", "shiraz", "grenache", "garnacha", "tempranillo", "sangiovese", "nebbiolo", "barbera", "dolcetto", "malbec", "zinfandel", "primitivo", "riesling", "gewurztraminer", "viognier", "chenin", "semillon", "muscat", "moscato", "malvasia", "vermentino", "verdejo", "albarino", "godello", "gruner", "veltliner", "carmenere", "mourvedre", "monastrell", "petite", "sirah", "franc", "gamay", "aglianico", "nero", "avola", "montepulciano", "corvina", "trebbiano", "fiano", "greco", "falanghina", "refosco", "teroldego", "lagrein", "glera", "touriga", "nacional", "carignan", "cinsault", "marsanne", "roussanne", "torrontes", "tannat", "pinotage", "furmint", "assyrtiko", "xinomavro", "palomino", "pedro", "ximenez", "mencia", "bobal", "graciano", "macabeo", "xarello", "arneis", "cortese", "rebula", "ribolla", "loureira", "viura", "tibouren", "rolle", "nerello", "mascalese", "friulano", "sagrantino", "cannonau"]
GRAPE_PARTS = ["blanc", "noir", "gris", "grigio", "franc", "petite", "sirah", "nero", "avola", "nacional", "pedro", "ximenez", "sauvignon", "veltliner"]
TASTING = ["cherry", "cherries", "plum", "plums", "compote", "chocolate", "vanilla", "bean", "pineapple", "lemon", "verbena", "silky", "curd", "nutmeg", "rich", "lime", "peel", "almond", "flinty", "cassis", "currant", "currants", "toast", "tart", "mint", "sour", "dried", "herb", "herbs", "toasty", "spice", "spicy", "balsamic", "ripe", "fruit", "fruits", "crushed", "rind", "tar", "walnut", "shell", "apricot", "kiwi", "herbaceous", "milk", "berry", "berries", "blackberry", "raspberry", "strawberry", "citrus", "grapefruit", "peach", "pear", "apple", "honey", "floral", "violet", "leather", "tobacco", "earthy", "mineral", "minerality", "oak", "oaky", "smoky", "pepper", "jammy", "crisp", "bright", "fresh", "juicy", "bold", "smooth", "elegant", "velvety", "licorice", "cedar", "mocha", "coffee", "cocoa", "caramel", "butter", "buttery", "creamy", "zesty", "tropical", "melon", "saline", "notes", "hints", "aromas", "palate", "finish", "tannins", "acidity", "structured", "lush", "savory", "savoury", "zest", "blossom", "brioche", "baked", "stone", "fig", "figs", "olive", "graphite", "clove", "cinnamon", "ginger", "jasmine"]
NOISE = ["ml", "cl", "l", "magnum", "half", "bottle", "glass", "btl", "gls", "carafe", "price"]
SYNONYMS = {"shiraz": "syrah", "garnacha": "grenache", "cannonau": "grenache", "grigio": "gris", "monastrell": "mourvedre", "mataro": "mourvedre", "primitivo": "zinfandel", "tribidrag": "zinfandel", "spatburgunder": "pinot", "blauburgunder": "pinot"}
GRAPE_PATTERNS = {"chardonnay": "chardonnay", "riesling": "riesling", "syrah": "syrah|shiraz", "pinot-gris": r"pinot\s+(?:gris|grigio)", "pinot-noir": r"pinot\s+noir", "pinot-blanc": r"pinot\s+blanc", "cabernet-sauvignon": r"cab(?:ernet)?\s+sauv(?:ignon)?", "cabernet-franc": r"cab(?:ernet)?\s+franc", "sauvignon-blanc": r"sauvignon\s+blanc", "chenin-blanc": r"chenin\s+blanc", "merlot": "merlot", "grenache": "grenache|garnacha", "mourvedre": "mourvedre|monastrell", "viognier": "viognier", "malbec": "malbec", "sangiovese": "sangiovese", "tempranillo": "tempranillo", "zinfandel": "zinfandel|primitivo"}
_QUOTED = "[‘“«„]\\s*([^’”»“]{2,48}?)\\s*[’”»“]|\"([^\"]{2,48})\"|(?:^|[\\s,(])'([^']{2,48})'(?=[\\s,).]|$)"


@cache
def _literals(words: tuple[str, ...]) -> list[Column]:
    return [F.lit(w) for w in words]


def within(token: Column, *words: str) -> Column:
    """One of the words. Their literals are made once, since each takes calls to the JVM."""
    return token.isin(_literals(words))


def identity_words(text: Column, synonyms: bool = True) -> Column:
    raw = F.regexp_extract_all(identity_text(text), F.lit("([a-z0-9]+)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    same = F.transform(raw, lambda t: F.coalesce(F.try_element_at(table, t), t)) if synonyms else raw
    return F.filter(same, lambda t: (F.length(t) > 1) & ~within(t, *STOP, *NOISE, *TASTING) & ~t.rlike(r"^\d+(?:ml|cl|l|oz)?$"))


def same_word(a: Column, b: Column) -> Column:
    """Equal; or, of words that are no grapes, one slip in seven letters or more, or one of six or more begins the other."""
    slip = (F.length(a) >= 7) & (F.length(b) >= 7) & (F.substring(a, 1, 2) == F.substring(b, 1, 2)) & (F.levenshtein(a, b, 1) >= 0)
    begins = (F.length(a) >= 6) & (F.length(b) >= 6) & (a.startswith(b) | b.startswith(a))
    return (a == b) | ((slip | begins) & ~within(a, *GRAPES) & ~within(b, *GRAPES))


def has_word(pool: Column, token: Column) -> Column:
    return F.exists(pool, lambda p: same_word(p, token))


def weight(token: Column, role: str) -> Column:
    out = F.when(within(token, *PRODUCER_KINDS, *PLACES), 0.15) if role == "producer" else F.when(within(token, *PRODUCER_KINDS), 0.2)
    out = out.when(within(token, *CLASSES), 0.45)
    return (out.when(within(token, *PLACES), 0.1) if role == "candidate" else out).otherwise(1.0)


def coverage(mine: Column, pool: Column, role: str) -> Column:
    """The weighted share of distinct words that the pool has; 0 if they weigh nothing."""
    start = F.struct(F.lit(0.0).alias("t"), F.lit(0.0).alias("f"))

    def step(s: Column, token: Column) -> Column:
        return let(weight(token, role), lambda w: F.struct((s["t"] + w).alias("t"), (s["f"] + F.when(has_word(pool, token), w).otherwise(0.0)).alias("f")))
    return F.aggregate(F.array_distinct(mine), start, step, lambda s: F.when(s["t"] > 0, s["f"] / s["t"]).otherwise(0.0))


def quoted_words(raw: Column) -> Column:
    """The distinctive words in quotes."""
    said = F.array_join(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda g: F.array_join(F.regexp_extract_all(F.coalesce(raw, F.lit("")), F.lit(_QUOTED), g), " ")), " ")
    return F.filter(identity_words(said), lambda t: ~within(t, *GRAPES, *PLACES, *CLASSES, *PRODUCER_KINDS))


def row_words(row: dict[str, Column]) -> Column:
    """What ``score_of_words`` and ``bonus_of_words`` ask of a row (raw_text, producer, label, menu_section, varietal); made once a row, not once a pair."""
    text = F.when(F.coalesce(row["raw_text"], F.lit("")) != "", row["raw_text"]).otherwise(F.concat_ws(" ", row["producer"], row["label"]))
    context = F.filter(identity_words(F.concat_ws(" ", row["menu_section"], row["varietal"])), lambda t: within(t, *GRAPES))
    return F.struct(identity_words(text).alias("row"), context.alias("context"), quoted_words(row["raw_text"]).alias("quoted"), identity_words(row["raw_text"]).alias("raw"))


def hit_words(hit: dict[str, Column]) -> Column:
    """The same of a hit (winery, name, region)."""
    return F.struct(identity_words(hit["winery"]).alias("winery"), identity_words(hit["name"]).alias("all_name"), identity_words(hit["region"]).alias("region"))


def identity_score(row: dict[str, Column], hit: dict[str, Column]) -> Column:
    """struct(score, without_producer, cuvee, appellation_guess) of a row (raw_text, producer, label, menu_section, varietal) and a hit (winery, name, region)."""
    return score_of_words(row_words(row), hit_words(hit))


def score_of_words(row: Column, hit: Column) -> Column:
    """``identity_score`` from ``row_words`` and ``hit_words``."""
    base = F.struct(*[row[n].alias(n) for n in ("row", "context", "quoted")], *[hit[n].alias(n) for n in ("winery", "all_name", "region")])

    def named(x: Column) -> Column:
        name = F.filter(x["all_name"], lambda t: ~F.array_contains(x["winery"], t))
        judged = F.transform(F.array_distinct(name), lambda t: F.struct(t.alias("t"), F.when(F.array_contains(x["region"], t) | within(t, *PLACES), 0.1).otherwise(weight(t, "name")).alias("w"), has_word(F.concat(x["row"], x["context"]), t).alias("found"), has_word(x["row"], t).alias("in_row")))
        own = F.filter(x["winery"], lambda t: (weight(t, "producer") == 1) & ~within(t, *GIVEN_NAMES))
        hit_words = F.concat(x["winery"], name)
        main = lambda a: F.filter(a, lambda t: within(t, *GRAPES) & ~within(t, *GRAPE_PARTS))
        return F.struct(
            x["row"].alias("row"), judged.alias("name"), coverage(x["winery"], x["row"], "producer").alias("producer"), coverage(x["row"], F.concat(hit_words, x["region"]), "candidate").alias("coverage"),
            (F.exists(x["row"], lambda t: within(t, *GRAPES)) | (F.size(x["context"]) > 0)).alias("grape"), ((F.size(own) == 0) | F.exists(own, lambda t: has_word(x["row"], t))).alias("seen"),
            ((F.size(main(hit_words)) > 0) & F.exists(main(x["row"]), lambda t: ~F.array_contains(main(hit_words), t))).alias("grape_gone"),
            ((F.size(x["quoted"]) > 0) & ~F.exists(x["quoted"], lambda t: has_word(hit_words, t))).alias("quote_gone"),
            F.exists(hit_words, lambda t: within(t, *ROSE)).alias("hit_rose"), F.exists(x["row"], lambda t: within(t, *ROSE)).alias("row_rose"),
        )

    def summed(x: Column) -> Column:
        of = lambda t: F.when(within(t["t"], *GRAPES) & ~x["grape"], 0.3).otherwise(t["w"])
        total = lambda test: F.aggregate(F.filter(x["name"], test), F.lit(0.0), lambda s, t: s + of(t))
        count = lambda test: F.size(F.filter(x["name"], test))
        cuvee = lambda t: (of(t) >= 0.3) & ~within(t["t"], *CLASSES)
        everywhere = F.forall(x["name"], lambda t: t["w"] <= 0.1)
        whole = total(lambda t: F.lit(True))
        matched = F.transform(F.filter(x["name"], lambda t: (t["w"] == 1) & ~within(t["t"], *GRAPES) & t["in_row"]), lambda t: t["t"])
        return F.struct(
            x.alias("x"), F.when((whole > 0) & ~everywhere, total(lambda t: t["found"]) / whole).otherwise(1.0).alias("name"), count(lambda t: ~t["found"] & (of(t) == 1) & ~within(t["t"], *GRAPES)).alias("missing"),
            count(cuvee).alias("cuvees"), count(lambda t: cuvee(t) & t["found"]).alias("cuvees_found"), matched.alias("matched"), (everywhere & (F.size(x["name"]) > 0) & ~F.exists(x["name"], lambda t: t["in_row"])).alias("guess"),
        )

    def decided(s: Column) -> Column:
        x = s["x"]
        alone = ~x["seen"] & (x["coverage"] >= 0.85) & (s["missing"] == 0) & (F.size(s["matched"]) >= 1) & ((s["cuvees_found"] == s["cuvees"]) | (F.size(s["matched"]) >= 2))
        plain = 0.4 * x["producer"] + 0.35 * s["name"] + 0.25 * x["coverage"]
        score = F.when(alone, F.least(F.lit(0.8), 0.5 * s["name"] + 0.5 * x["coverage"])).when(~x["seen"], plain * 0.45).otherwise(plain)
        cap = lambda test, most: F.when(test, most).otherwise(1.0)
        caps = [F.when(s["missing"] >= 2, 0.55).when((s["missing"] == 1) & (s["name"] < 0.5), 0.62).otherwise(1.0), cap((s["cuvees"] > 0) & (s["cuvees_found"] == 0), 0.58), cap(x["grape_gone"], 0.58), cap(x["quote_gone"], 0.55)]
        caps.append(F.when(~alone & (x["producer"] < 0.6), 0.58).when(~alone & (x["producer"] < 0.75), 0.7).otherwise(1.0))
        rose = F.when(x["hit_rose"] & ~x["row_rose"], 0.6).when(x["row_rose"] & ~x["hit_rose"], 0.75).otherwise(1.0)
        final = F.when(F.size(x["row"]) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(score, *caps) * rose))
        return F.struct(final.alias("score"), (alone & (F.size(x["row"]) > 0)).alias("without_producer"), F.when(alone, s["matched"]).otherwise(F.array().cast("array<string>")).alias("cuvee"), s["guess"].alias("appellation_guess"))

    return let(let(let(base, named), summed), decided)


def vintage_evidence(year: Column, text: Column) -> Column:
    marker = r"(?i)(?:^|[\s,(\[;])(?:n\.?\s*(?:/\s*)?v\.?|non[\s-]?vintage)(?=$|[\s,).\];])"
    return F.when(year.isNotNull(), "year").when(F.coalesce(text, F.lit("")).rlike(marker), "non-vintage").otherwise("unknown")


def compare_vintages(year: Column, text: Column, hit_year: Column, hit_text: Column) -> Column:
    """exact, conflict, unknown (the hit doesn't say) or unconstrained (the row doesn't)."""
    return compare_evidence(vintage_evidence(year, text), vintage_evidence(hit_year, hit_text), year, hit_year)


def compare_evidence(mine: Column, theirs: Column, year: Column, hit_year: Column) -> Column:
    """``compare_vintages`` from what each side says."""
    return F.when(mine == "unknown", "unconstrained").when(theirs == "unknown", "unknown").when((mine != theirs) | ((mine == "year") & (year != hit_year)), "conflict").otherwise("exact")


def without_region(text: Column, region: Column) -> Column:
    """Plain lower-case text without the words of the region, whatever stands between these."""
    plain = F.lower(fold_accents(F.coalesce(text, F.lit(""))))
    parts = F.regexp_extract_all(F.lower(fold_accents(F.coalesce(region, F.lit("")))), F.lit("([a-z0-9]+)"), F.lit(1))
    pattern = F.concat(F.lit("(?<![a-z0-9_])"), F.array_join(parts, "[^a-z0-9]+"), F.lit("(?![a-z0-9_])"))
    return F.when(F.size(parts) == 0, plain).otherwise(F.regexp_replace(plain, pattern, F.lit(" ")))


def menu_identity_text(label: Column, raw: Column, region: Column, raw_only: bool = False) -> Column:
    """What a menu row says of its item: label and text (``raw_only``: the text, the label if there is none), without the region."""
    said = lambda c: F.when(c != "", c)
    whole = F.coalesce(said(raw), said(label), F.lit("")) if raw_only else F.concat_ws(" ", said(label), said(raw))
    return without_region(whole, region)


def grapes(text: Column) -> Column:
    """Names of the grapes that a text names."""
    low = identity_text(text)
    return let(low, lambda t: F.filter(F.array(*[F.when(t.rlike(word(p)), F.lit(n)) for n, p in GRAPE_PATTERNS.items()]), lambda g: g.isNotNull()))


_ANY_GRAPE = "(?:" + "|".join(GRAPE_PATTERNS.values()) + ")"
# Words of a grape or a blend that leave open which one.
_OPEN_GRAPE = word("cabernet|cab|sauvignon|sauv|pinot|blends?")


def _beside_grapes(plain: Column, also: str) -> Column:
    """What a folded text says besides grapes, conjunctions and shares."""
    rest = F.regexp_replace(F.regexp_replace(plain, word(_ANY_GRAPE), " "), word("and|with"), "")
    return F.regexp_replace(F.regexp_replace(rest, r"\d+(?:\.\d+)?%?", ""), also, "")


def _has_open_list(plain: Column) -> Column:
    """A list of grapes, between slashes, plus signs or ampersands, of which not all are known."""
    def part_is(part: Column) -> Column:
        touches = part.rlike(word(_ANY_GRAPE) + r"\s*[/+&]") | part.rlike(r"[/+&]\s*" + word(_ANY_GRAPE))
        listed = F.regexp_extract(part, rf"((?:{word(_ANY_GRAPE)}|(?<![a-z])[a-z]+\s*[/+&]).*)$", 1)
        return touches & (_beside_grapes(listed, "[^a-z]") != "")
    return F.exists(F.split(plain, "[,|]"), part_is)


def row_grapes(label: Column, varietal: Column, producer: Column, raw: Column, region: Column | None = None) -> Column:
    """struct(named, unknown): the grapes that a row names, and whether it leaves open which."""
    fold = lambda t: F.lower(fold_accents(F.coalesce(t, F.lit(""))))
    text = menu_identity_text(label, raw, F.lit(None).cast("string") if region is None else region, raw_only=True)
    parts = F.concat(F.array(F.coalesce(producer, F.lit(""))), F.split(F.coalesce(raw, F.lit("")), "[,|]"))
    pure = F.filter(parts, lambda t: _beside_grapes(fold(t), r"[\s/+&()\[\]-]") == "")  # a part that only lists grapes counts, wherever it stands
    told = F.array_union(grapes(F.concat_ws(" ", label, varietal)), F.array_distinct(F.flatten(F.transform(pure, grapes))))
    unknown = let(text, lambda t: _beside_grapes(t, "$^").rlike(_OPEN_GRAPE) | _has_open_list(t))
    return F.struct(told.alias("named"), unknown.alias("unknown"))


def compare_named_grapes(row: Column, hit: Column) -> Column:
    """``compare_grapes`` from ``row_grapes`` and the grapes of the hit's name."""
    return F.when(row["unknown"], "unknown").when(F.size(row["named"]) == 0, "unconstrained").when(F.size(hit) == 0, "unknown").when(F.size(F.array_except(hit, row["named"])) > 0, "conflict").otherwise("compatible")


def compare_grapes(label: Column, varietal: Column, producer: Column, raw: Column, hit_name: Column, region: Column | None = None) -> Column:
    """compatible, conflict (the hit has a grape the row doesn't name), unconstrained (the row names none) or unknown (lists that aren't whole)."""
    return let(F.struct(row_grapes(label, varietal, producer, raw, region).alias("row"), grapes(hit_name).alias("hit")), lambda x: compare_named_grapes(x["row"], x["hit"]))


def specificity(row_text: Column, winery: Column, name: Column) -> Column:
    """A small bonus of a hit: 0.025 if the row names its cuvée, less 0.002 (0.01 at most) for each word that the row lacks."""
    return bonus_of_words(identity_words(row_text), identity_words(winery), identity_words(name))


def bonus_of_words(row: Column, winery: Column, name: Column) -> Column:
    """``specificity`` from the words of the three."""
    base = F.struct(row.alias("row"), winery.alias("winery"), name.alias("name"))

    def of(x: Column) -> Column:
        names = F.array_distinct(F.filter(x["name"], lambda t: ~F.array_contains(x["winery"], t)))
        own = F.filter(x["row"], lambda t: (weight(t, "candidate") == 1) & ~within(t, *GRAPES) & ~has_word(x["winery"], t))
        named = F.exists(own, lambda t: has_word(names, t))
        extra = F.size(F.filter(names, lambda t: ~has_word(x["row"], t)))
        return F.when(named, 0.025).otherwise(0.0) - F.least(F.lit(0.01), extra * 0.002)
    return let(base, of)


def search_words(text: Column) -> Column:
    """Words worth looking up: names, no places, classes or kinds of producer."""
    return F.array_distinct(F.filter(identity_words(text, False), lambda t: ~within(t, *PLACES, *CLASSES, *PRODUCER_KINDS, *GRAPES, "years")))


def search_plan(row: dict[str, Column]) -> Column:
    """Up to three lists of words to look a row (raw_text, producer, label, region) up by, the most specific first."""
    worth = lambda t: F.filter(identity_words(t, False), lambda w: ~within(w, *PLACES, *CLASSES, *PRODUCER_KINDS, "years"))
    base = F.struct(worth(row["producer"]).alias("producer"), worth(row["label"]).alias("label"), worth(row["raw_text"]).alias("raw"), identity_words(row["region"]).alias("region"), quoted_words(row["raw_text"]).alias("quoted"))

    def named(x: Column) -> Column:
        outside = lambda a: F.filter(a, lambda w: ~F.array_contains(x["region"], w))
        spoken = outside(F.concat(x["producer"], x["label"]))
        said = F.when(F.size(spoken) > 0, spoken).otherwise(outside(x["raw"]))
        return F.struct(F.array_distinct(said).alias("said"), F.filter(outside(x["producer"]), lambda w: ~within(w, *GRAPES)).alias("producer"), x["quoted"].alias("quoted"))

    def planned(x: Column) -> Column:
        names, grape = F.filter(x["said"], lambda w: ~within(w, *GRAPES)), F.filter(x["said"], lambda w: within(w, *GRAPES))
        first = lambda a, n: F.slice(F.array_distinct(a), 1, n)
        maker = F.slice(F.filter(x["producer"], lambda w: ~F.array_contains(x["quoted"], w)), 1, 2)
        plans = F.array(first(names, 4), F.when((F.size(x["quoted"]) > 0) & (F.size(maker) > 0), first(F.concat(maker, x["quoted"]), 4)), first(names, 2), F.when((F.size(names) <= 2) & (F.size(grape) > 0), first(F.concat(names, F.slice(grape, 1, 1)), 3)), first(x["producer"], 3))
        kept = F.slice(F.array_distinct(F.filter(plans, lambda p: p.isNotNull() & (F.size(p) > 0))), 1, 3)
        return F.when(F.size(names) > 0, kept).otherwise(F.array().cast("array<array<string>>"))
    return let(let(base, named), planned)
