"""Prices and vintages in menu texts. All return null for what they don't find."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import without_markers, word

YEAR = word(r"(?:19|20)\d{2}")
SHORT_YEAR = r"['’‘`](\d{2})(?![A-Za-z0-9_])"
_AMOUNT = r"\$?\d+(?:\.\d{2})?"
# The forms of a price at the end of a row.
_INLINE = r"^(.*?)(?:\s*/\s*(\d{1,2})(?!\d)(?:\.\d{2})?(?:\.\s*\d+)?\.?(?:\s+[A-Za-z0-9]+)?)\s*$"
_BARE = r"^(.*\S)\s+(\$?\d{1,3}(?:\.\d{2})?)\s*$"
_MENU = r"(?i)^(.*?)(?::\s*|\s+)((?:NA|\$?\d+(?:\.\d{2})?)(?:\s*/\s*(?:NA|\$?\d+(?:\.\d{2})?)){1,2})\s*$"
_SYMBOLS, _CODES = "€£¥₩₹", "EUR|GBP|CHF|SEK|DKK|NOK|JPY|CAD|AUD|NZD|kr"


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The group of the first match, null if there is none."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def vintage(text: Column, as_of_year: int | None = None) -> Column:
    """A year of four digits, else one of two after an apostrophe, not later than a year after ``as_of_year``."""
    full = found(text, YEAR).cast("int")
    if as_of_year is None:
        return full
    short = found(text, SHORT_YEAR, 1).cast("int")
    return F.coalesce(full, F.when(short <= as_of_year - 2000 + 1, 2000 + short).otherwise(1900 + short))


def number_in(price: Column) -> Column:
    """The first number of a price."""
    return found(price, r"\d+(?:\.\d{1,2})?").cast("double")


def dollars(amount: Column) -> Column:
    return F.when(amount == F.floor(amount), F.concat(F.lit("$"), amount.cast("long").cast("string"))).when(amount.isNotNull(), F.concat(F.lit("$"), F.format_string("%.2f", amount)))


def likely_price(token: Column) -> Column:
    plain = F.regexp_replace(F.trim(token), r"^\$", "")
    return F.coalesce(plain.rlike(r"^\d{1,3}(?:\.\d{2})?$") & plain.try_cast("double").between(5, 400), F.lit(False))


def ends_with_price(text: Column) -> Column:
    return likely_price(F.regexp_extract(text, r"(\d{1,3}(?:\.\d{2})?)\s*$", 1))


def is_price_line(line: Column) -> Column:
    return line.rlike(rf"^{_AMOUNT}(?:\s*/\s*{_AMOUNT}){{1,2}}$") | line.rlike(r"^\$\d+(?:\.\d{2})?$") | likely_price(line)


def largest_amount(slashed: Column) -> Column:
    """The largest of amounts between slashes."""
    return F.array_max(F.transform(F.split(slashed, r"\s*/\s*"), lambda a: F.regexp_replace(F.trim(a), r"^\$", "").try_cast("double")))


def inline_price(line: Column) -> Column:
    """struct(title, price) of a row whose price follows a slash or is its last word; the price is null otherwise."""
    slash, bare = line.rlike(_INLINE), line.rlike(_BARE) & likely_price(F.regexp_extract(line, _BARE, 2))
    title = F.when(slash, F.regexp_extract(line, _INLINE, 1)).when(bare, F.regexp_extract(line, _BARE, 1)).otherwise(line)
    price = F.when(slash, F.regexp_extract(line, _INLINE, 2)).when(bare, F.regexp_replace(F.regexp_extract(line, _BARE, 2), r"^\$", ""))
    return F.struct(F.trim(title).alias("title"), dollars(price.try_cast("double")).alias("price"))


def menu_price(line: Column) -> Column:
    """struct(title, price) of a row that ends with two or three amounts or "NA" between slashes; else null."""
    title = F.regexp_replace(F.trim(F.regexp_extract(line, _MENU, 1)), r"[:\s]+$", "")
    blob = F.regexp_extract(line, _MENU, 2)
    fits = line.rlike(_MENU) & title.rlike("[A-Za-z]") & ~F.exists(F.split(blob, r"\s*/\s*"), lambda t: F.trim(t).rlike(r"^(19|20)\d{2}$"))
    return F.when(fits, F.struct(title.alias("title"), dollars(largest_amount(blob)).alias("price")))


def raw_price(text: Column) -> Column:
    """A whole text as a price: dollars, two amounts (the larger), other currencies before or after, or a bare number of 5 to 2000."""
    t = F.trim(text)
    two = lambda mark: F.when(t.rlike(p := rf"^\$?(\d+)\s*{mark}\s*\$?(\d+)(?:\.\d{{2}})?$"), F.greatest(F.regexp_extract(t, p, 1).cast("long"), F.regexp_extract(t, p, 2).cast("long")))
    larger = F.coalesce(two("/"), two("[-–]"))

    def money(lead: str, trail: str, spell) -> Column:
        first = t.rlike(lead)
        unit = F.when(first, F.regexp_extract(t, lead, 1)).otherwise(F.regexp_extract(t, trail, 2))
        amount = F.regexp_replace(F.when(first, F.regexp_extract(t, lead, 2)).otherwise(F.regexp_extract(t, trail, 1)), ",", "").try_cast("double")
        plain = F.when(amount == F.floor(amount), amount.cast("long").cast("string")).when(amount.isNotNull(), F.format_string("%.2f", amount))
        return F.when((first | t.rlike(trail)) & amount.between(5, 20000), F.concat(spell(unit), plain))

    symbol = money(rf"^([{_SYMBOLS}])\s*(\d[\d,.]*)$", rf"^(\d[\d,.]*)\s*([{_SYMBOLS}])$", lambda u: u)
    code = money(rf"(?i)^({_CODES})\s+(\d[\d,.]*)$", rf"(?i)^(\d[\d,.]*)\s+({_CODES})$", lambda u: F.concat(F.when(F.length(u) == 2, F.lower(u)).otherwise(F.upper(u)), F.lit(" ")))
    bare = found(t, r"^\$?(\d+)(?:\.\d{2})?$", 1).try_cast("long")
    return F.coalesce(F.when(t.rlike(r"^\$\d+(?:\.\d{2})?$"), t), F.concat(F.lit("$"), larger.cast("string")), symbol, code, F.when(bare.between(5, 2000), F.concat(F.lit("$"), bare.cast("string"))))


def trailing_price(text: Column) -> Column:
    """struct(name, price) of a text with a price at its end that is no year; else null."""
    two, one = r"^(.*\S)\s+(\$?\d+\s*[/–\-]\s*\$?\d+)$", r"^(.*\S)\s+(\$?\d+(?:\.\d{2})?)$"
    part = lambda g: F.trim(F.when(text.rlike(two), F.regexp_extract(text, two, g)).otherwise(F.regexp_extract(text, one, g)))
    name, price = part(1), raw_price(part(2))
    return F.when(name.rlike("[A-Za-z]") & ~part(2).rlike(r"^(19|20)\d{2}$") & price.isNotNull(), F.struct(name.alias("name"), price.alias("price")))


def region_price(text: Column) -> Column:
    """struct(region, price) of a region with a price after it; else null."""
    clean, pattern = without_markers(text), r"^(.*\S)\s+(\d+(?:\s*/\s*\d+)?)$"
    blob = F.regexp_extract(clean, pattern, 2)
    amount = F.when(blob.contains("/"), largest_amount(blob)).otherwise(F.when(blob.try_cast("double").between(5, 2000), blob.try_cast("double")))
    return F.when(clean.rlike(pattern) & ~blob.rlike(r"^(19|20)\d{2}$") & amount.isNotNull(), F.struct(F.trim(F.regexp_extract(clean, pattern, 1)).alias("region"), dollars(amount).alias("price")))


def benchmark_tier(menu_amount: Column, retail_amount: Column) -> Column:
    """fair up to 2.5 times the retail price, average up to 3.5, else steep; null if either isn't positive."""
    times = F.try_divide(menu_amount, retail_amount)
    return F.when((menu_amount > 0) & (retail_amount > 0), F.when(times <= 2.5, "fair").when(times <= 3.5, "average").otherwise("steep"))


def within_budget(amount: Column, most: float | None, keep_unpriced: bool) -> Column:
    """Unpriced rows follow the flag; without a limit all priced rows stay."""
    return F.when(amount.isNull(), F.lit(keep_unpriced)).otherwise(F.lit(True) if most is None else amount <= most)
