"""Profiles of items: their fields and where these come from, what the evidence says, preferences and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .display import image_url
from .prices import benchmark_tier
from .taste import DIMENSIONS, clamped, rescaled
from .text import let, rounded, words

# Columns of a candidate that older records lack.
CANDIDATE_FIELDS = {"price": "string", "menu_tab": "string", "menu_section": "string", "producer": "string", "label": "string", "vintage": "int", "color": "string", "varietal": "string", "region": "string", "notes": "string"}
# Labels that only name a style.
STYLE_LABELS = ["chilled red", "red", "white", "orange", "rose", "rosé", "sparkling"]
# What a rule-based profile asks of the extraction confidence, without and with a specific style.
RULE_CONFIDENCE, RULE_CONFIDENCE_STYLED = 0.68, 0.55
# Names of families by what a group's key holds, in the order in which they are tried.
FAMILY_RULES = [(("fruit",), "tree-fruit"), (("yeast", "microbio"), "yeasty"), (("flower",), "floral"), (("earth", "herb", "vegetal", "green"), "earth"), (("oak", "spice"), "spices")]
FAMILIES = ["red-fruit", "black-fruit", "yeasty", "microbio", "citrus-fruit", "tree-fruit", "tropical-fruit", "floral", "earth", "oak", "spices"]
# Fixed value: a year or a mark of none at the end of a catalogue name.
_NAME_YEAR = r"(?i)\s+(?:(?:19|20)\d{2}|N\.?V\.?)\s*$"
# Marks of a page that bars access.
CHALLENGE_TITLE = r"(?i)\b(?:access\s+denied|captcha|security\s+check|verify\s+(?:that\s+)?you\s+are\s+human)\b"
CHALLENGE_MARKS = r"(?i)\bwindow\.gokuProps\s*=|\bAwsWafCaptcha\.renderCaptcha\b"
CHALLENGE_SCRIPT = r"(?i)<script\b[^>]*\bsrc\s*=\s*[\"'](?![^\"']*\.edge\.sdk\.awswaf\.com/)[^\"']*\b(?:challenge|captcha)\.js(?:[?\"']|$)[^>]*>"


def filled(candidates: DataFrame) -> DataFrame:
    """``candidates`` with every column of a candidate; those that older records lack are null."""
    missing = {name: F.lit(None).cast(kind) for name, kind in CANDIDATE_FIELDS.items() if name not in candidates.columns}
    return candidates.withColumns(missing) if missing else candidates


def is_style_listing(producer: Column, region: Column, label: Column) -> Column:
    """No producer, a region, and a label that only names a style."""
    has = lambda c: F.coalesce(c != "", F.lit(False))
    return ~has(producer) & has(region) & F.coalesce(F.lower(F.trim(label)).isin(STYLE_LABELS), F.lit(False))


def admits_rules(confidence: Column, specific: Column, listing: Column) -> Column:
    """Whether a candidate without an external profile gets one by rule."""
    enough = (confidence >= RULE_CONFIDENCE) | ((confidence >= RULE_CONFIDENCE_STYLED) & specific)
    return ~listing & F.coalesce(enough, F.lit(False))


def profile_fields(external: dict[str, Column], candidate: dict[str, Column], mode: Column) -> Column:
    """struct(name, producer, label, vintage, region, varietal, image, provenance): the external field where there is one, else the candidate's."""
    both = lambda f: F.coalesce(external[f], candidate[f])
    spoken = F.concat_ws(" ", *[F.when(both(f) != "", both(f)) for f in ("producer", "label")])
    name = F.coalesce(external["name"], candidate["raw_text"], spoken)
    fields = [both(f).alias(f) for f in ("producer", "label", "vintage", "region", "varietal")]
    return F.struct(name.alias("name"), *fields, image_url(external["image"]).alias("image"), F.initcap(mode).alias("provenance"))


def first_piece(*pieces: Column) -> Column:
    """The first of several sources' structs that isn't null, so that fields of different sources don't mix."""
    return F.coalesce(*pieces)


def name_for(name: Column, exact_vintage: Column) -> Column:
    """A catalogue name without the year it ends in, unless the vintage is the one that was asked for."""
    return F.when(exact_vintage, name).otherwise(F.trim(F.regexp_replace(name, _NAME_YEAR, "")))


def stored_preference(row: dict[str, Column]) -> Column:
    """struct(body, acidity, tannin, sweetness, weights, migrated) of stored numbers: dimensions of an older scale are halved, weights are in thousandths."""
    value = {d: rescaled(row[d]) for d in DIMENSIONS}
    moved = F.lit(False)
    for d in DIMENSIONS:
        moved = moved | (value[d] != row[d])
    weights = F.struct(*[(row[f"weight_{d}"] / 1000).alias(d) for d in DIMENSIONS])
    return F.struct(*[value[d].alias(d) for d in DIMENSIONS], weights.alias("weights"), moved.alias("migrated"))


def same_preference(left: Column, right: Column) -> Column:
    """Equal in all dimensions and weights; unset ones are equal to each other."""
    test = F.lit(True)
    for d in DIMENSIONS:
        test = test & left[d].eqNullSafe(right[d]) & left["weights"][d].eqNullSafe(right["weights"][d])
    return test


def merged_preference(current: dict[str, Column], stored: dict[str, Column]) -> Column:
    return F.struct(*[F.coalesce(current[d], stored[d]).alias(d) for d in DIMENSIONS])


def usable_dimension(taste: Column, dimension: str) -> Column:
    seen = F.coalesce(F.array_contains(taste["observed"], dimension), F.lit(False))
    return F.coalesce((taste["confidence"] > 0) & ((taste["source_mode"] == "inferred") | seen), F.lit(False))


def evidence(taste: Column, status: Column) -> Column:
    """struct(fit, identity, taste): what a reader is told about each."""
    inferred = F.coalesce(taste["source_mode"] == "inferred", F.lit(False))
    known = F.concat(F.size(F.array_distinct(taste["observed"])).cast("string"), F.lit("/4 taste dimensions available"))
    identity = F.when(inferred, "Estimated style; bottle identity unverified").when(status == "matched", "Bottle match").when(status == "low-confidence", "Possible bottle match; verify label and vintage").otherwise("No reliable bottle match")
    told = F.when(inferred & (taste["confidence"] > 0), "Estimated from menu details").when(inferred, "Insufficient style information").when(taste["observed"].isNotNull(), known).otherwise("Taste-data completeness not recorded")
    return F.struct(F.when(inferred, "Estimated fit").otherwise("Taste fit").alias("fit"), identity.alias("identity"), told.alias("taste"))


def progress(status: Column, n_done: Column, n_items: Column) -> Column:
    """struct(title, processed, total, fraction) of a run; null once it is complete."""
    waiting = status.isin("uploaded", "queued")
    total = F.when(waiting, 0).otherwise(n_items)
    done = F.least(n_done, total)
    of = F.concat(done.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" wines"))
    title = F.when(waiting, "Queued for processing").when((status == "processing") & (total == 0), "Running OCR").when(status == "processing", F.concat(F.lit("Analyzing "), of))
    title = title.when(status == "failed", "Analysis failed").when((status == "canceled") & (total > 0), F.concat(F.lit("Analysis stopped at "), of)).when(status == "canceled", "Analysis stopped")
    return F.when(title.isNotNull(), F.struct(title.alias("title"), done.alias("processed"), total.alias("total"), F.try_divide(done, total).alias("fraction")))


def with_scheme(url: Column) -> Column:
    plain = F.trim(url)
    return F.when((plain == "") | plain.rlike(r"(?i)^https?://"), plain).otherwise(F.concat(F.lit("https://"), plain))


def image_candidates(attribute: Column) -> Column:
    """The addresses of a list of image sources, the last (largest) first."""
    return F.reverse(F.filter(F.transform(F.split(attribute, ","), lambda c: F.get(F.split(F.trim(c), r"\s+"), F.lit(0))), lambda c: c != ""))


def first_image(*urls: Column, placeholder: str) -> Column:
    """The first address that is one and doesn't match the pattern of placeholders."""
    return F.coalesce(*[let(image_url(u), lambda x: F.when((x != "") & ~x.rlike(placeholder), x)) for u in urls])


def suspicious_empty(n_links: Column, n_hits: Column, says_none: Column) -> Column:
    """An answer without links or hits that doesn't say it found nothing."""
    return (n_links == 0) & (n_hits == 0) & ~says_none


def retry_zero_result(n_links: Column, n_hits: Column, says_none: Column, url: Column) -> Column:
    return (n_links == 0) & (n_hits == 0) & says_none & url.rlike(r"(?i)/explore(?:[/?]|$)")


def access_blocked(status: Column, action: Column, title: Column, body: Column) -> Column:
    """Refused by its status, a header's action, or a page that only checks who asks."""
    said = F.coalesce(action, F.lit("")).rlike("(?i)challenge|captcha")
    page = F.coalesce(title, F.lit("")).rlike(CHALLENGE_TITLE) | F.coalesce(body, F.lit("")).rlike(f"{CHALLENGE_MARKS}|{CHALLENGE_SCRIPT}")
    return F.coalesce(status.isin(401, 403), F.lit(False)) | said | page


def is_noise_line(line: Column) -> Column:
    """No word of two letters; or several, none of them with a vowel."""
    spoken = F.regexp_extract_all(F.trim(line), F.lit("[A-Za-z]{2,}"), F.lit(0))
    return let(spoken, lambda t: (F.size(t) == 0) | ((F.size(t) >= 2) & ~F.exists(t, lambda x: x.rlike("(?i)[aeiouy]"))))


def aggregate_rating(average: Column, count: Column, source: str) -> Column:
    """struct(rating, count, source); null unless both are positive numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")) & (x > 0)
    return F.when(number(average) & number(count), F.struct(average.cast("double").alias("rating"), rounded(count).cast("long").alias("count"), F.lit(source).alias("source")))


def best_rating(item: tuple[Column, Column], vintage: tuple[Column, Column]) -> Column:
    return F.coalesce(aggregate_rating(*item, "wine"), aggregate_rating(*vintage, "vintage"))


def review_meta(reviews: Column, item_id: Column) -> Column:
    """The first of the reviews (array of struct with ``item_id``) that is about the item or doesn't say what it is about."""
    return F.get(F.filter(reviews, lambda r: r["item_id"].isNull() | (r["item_id"] == item_id)), F.lit(0))


def structure_scale(value: Column) -> Column:
    """An external measure as a dimension; null if it isn't a number."""
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), clamped(value))


def review_count(value: Column) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value < float("inf")), rounded(value).cast("long"))


def note_hint(notes: Column) -> Column:
    """The first five words of four letters or more."""
    return F.array_join(F.slice(F.filter(words(F.coalesce(notes, F.lit(""))), lambda t: F.length(t) >= 4), 1, 5), " ")


def centred_cues(cues: Column) -> Column:
    """Of three cues or more (array of struct with ``image``), the middle one has an image if any has: it changes places with the first that has."""
    def of(x: Column) -> Column:
        at = F.array_position(F.transform(x, lambda c: c["image"].isNotNull()), True) - 1
        moved = F.transform(x, lambda c, i: F.when(i == 1, F.get(x, at.cast("int"))).when(i == at, F.get(x, F.lit(1))).otherwise(c))
        return F.when((F.size(x) < 3) | F.get(x, F.lit(1))["image"].isNotNull() | (at < 0), x).otherwise(moved)
    return let(cues, of)


def family(key: Column, known: list[str] = FAMILIES) -> Column:
    """A group's family: its key if it is known, else by what the key holds; null if nothing fits."""
    low = F.lower(key)
    out = F.when(low.isin(known), low)
    for parts, name in FAMILY_RULES:
        test = F.lit(False)
        for part in parts:
            test = test | low.contains(part)
        out = out.when(test, name)
    return out


def undisputed_tier(menu_amount: Column, retail_amount: Column, n_alternatives: Column) -> Column:
    """No tier where the menu gives several prices."""
    return F.when(n_alternatives == 0, benchmark_tier(menu_amount, retail_amount))


def scoped_key(namespace: Column, key: Column) -> Column:
    return F.concat_ws(":", namespace, key)

