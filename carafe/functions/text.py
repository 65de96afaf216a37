"""Text folding and small text repairs as column expressions.

Null texts are empty in the ``*_text`` and ``*_field`` folds and stay null elsewhere.
"""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of section headings, and what may stand beside them.
SECTION_WORDS = ["red", "white", "rose", "rosé", "pink", "sparkling", "orange", "sherry", "sake", "sweet"]
SECTION_CONTEXT = ["wines", "glass", "glasses", "carafe", "carafes", "bottle", "bottles", "split", "list", "lists", "by", "the", "and"]
# Recognition slips and their repairs.
CORRECTIONS = [(r"(?<![A-Za-z0-9_])Rhone(?![A-Za-z0-9_])", "Rhône"), (r"(?<![A-Za-z0-9_])Schaztel(?![A-Za-z0-9_])", "Schäztel"), ("Tradicién", "Tradición"), (r"Vino de\}\s+Volta", "Vino del Volta")]
# Named entities of page texts and of page titles, which differ in the dashes.
ENTITIES = {"apos": "'", "copy": "©", "emsp": " ", "ensp": " ", "gt": ">", "lt": "<", "nbsp": " ", "ndash": "-", "mdash": "-", "quot": '"', "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"', "thinsp": " ", "eacute": "é", "Eacute": "É", "amp": "&"}
TITLE_ENTITIES = ENTITIES | {"ndash": "–", "mdash": "—"}
_COUNTING = string.ascii_letters + string.digits + ",.:/&+\\-"
QUOTES = "‘’'“”\""


@lru_cache(maxsize=1)
def _plain_letters() -> tuple[str, str]:
    """Characters beyond ASCII whose compatibility decomposition, without marks, is one ASCII character; and these."""
    pairs = []
    for code in [*range(0xA0, 0xD800), *range(0xE000, 0x10000)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; expressions that use a value often would otherwise hold it as often."""
    return F.element_at(F.transform(F.array(value), use), 1)


def word(pattern: str) -> str:
    """A pattern between ASCII word limits."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def fold_accents(text: Column) -> Column:
    """Compatibility letters and accents to plain letters; texts in ASCII, which are most, are not gone through."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, *_plain_letters()), r"\p{M}+", "")).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normal_field(text: Column) -> Column:
    """Plain lower-case letters, digits and single spaces."""
    return squeeze(F.regexp_replace(F.lower(fold_accents(F.coalesce(text, F.lit("")))), r"[^a-z0-9\s]", " "))


def style_text(text: Column) -> Column:
    """``normal_field`` with every other character as a space, and a space on each side."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(fold_accents(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", " ")), F.lit(" "))


def quality_text(text: Column) -> Column:
    """Folded text with the characters that count for quality; case is kept."""
    plain = fold_accents(F.coalesce(text, F.lit("")))
    # single spaces, which most gaps are, stay as they are; characters are listed because the pattern engine looks up a list and walks ranges
    return F.trim(F.regexp_replace(plain, f" *[^{_COUNTING} ][^{_COUNTING}]*| {{2,}}", " "))


def identity_text(text: Column) -> Column:
    plain = F.lower(fold_accents(F.coalesce(text, F.lit(""))))
    return F.replace(F.regexp_replace(plain, "[‘’'`´\"“”«»]", " "), F.lit("&"), F.lit(" and "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def alpha_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(quality_text(text)), r"\s+"), lambda w: w.rlike("[a-z]"))


def section_header(text: Column) -> Column:
    """The first heading word, if all other words are context words or numbers; else null."""
    def of(tokens: Column) -> Column:
        heads = F.filter(tokens, lambda w: w.isin(SECTION_WORDS))
        rest = F.forall(tokens, lambda w: w.isin(SECTION_WORDS + SECTION_CONTEXT) | w.rlike(r"^\d+$"))
        return F.when((F.size(heads) > 0) & rest, F.get(heads, F.lit(0)))
    return let(words(normal_field(text)), of)


def corrected(text: Column) -> Column:
    for pattern, right in CORRECTIONS:
        text = F.regexp_replace(text, pattern, right)
    return text


def without_markers(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s*[*†‡§¶#]+\s*$", ""))


def sanitized_line(text: Column) -> Column:
    """A recognised line without bullets, trailing marks, handles and known slips. Most lines have none of what one of the patterns needs."""
    whole = text
    for pattern in (r"^\s+|\s+$", r"^[*•|¢]+\s*", r"\s+[|«»]+$", r"\s*[*†‡§¶#]+\s*$", r"\s+@\s*[A-Za-z0-9'’.+-]+$", r"^\s+|\s+$", r"^[a-z]\s+(?=[A-Z])"):
        text = F.regexp_replace(text, pattern, "")
    return F.when(whole.rlike(rf"^[\s*•|¢]|[\s|«»*†‡§¶#]$|@|^[a-z]\s|{'|'.join(p for p, _ in CORRECTIONS)}"), corrected(text)).otherwise(whole)


def without_repeats(text: Column) -> Column:
    """One copy of a phrase said twice; else without segments equal to the one before."""
    def of(plain: Column) -> Column:
        twice = F.regexp_extract(plain, r"(?i)^(.+?)(?:\s*[,;/]\s*|\s+)\1$", 1)
        parts = F.filter(F.transform(F.split(plain, r"\s*,\s*"), lambda p: F.trim(p)), lambda p: p != "")
        kept = lambda parts: F.array_join(F.filter(parts, lambda p, i: (i == 0) | (F.lower(p) != F.lower(F.get(parts, i - 1)))), ", ")
        return F.when(twice != "", F.trim(twice)).otherwise(let(parts, lambda parts: F.when(F.size(parts) < 2, plain).otherwise(kept(parts))))
    return let(squeeze(F.regexp_replace(text, ">+", " ")), of)


def decoded_entities(text: Column, named: dict[str, str] = ENTITIES) -> Column:
    """Each named or numeric entity decoded once; unknown ones stay."""
    def numeric(out: Column, pattern: str, base: int) -> Column:
        found = F.array_distinct(F.regexp_extract_all(out, F.lit(pattern), F.lit(1)))
        def one(acc: Column, digits: Column) -> Column:
            code = F.lpad(F.conv(digits, base, 16), 8, "0")
            char = F.when((F.length(digits) < 8) & (code <= "0010FFFF"), F.decode(F.unhex(code), "UTF-32"))
            return F.coalesce(F.replace(acc, F.concat(F.lit("&#" if base == 10 else "&#x"), digits, F.lit(";")), char), acc)
        return F.aggregate(found, out, one)
    text = F.when(text.contains("&#"), numeric(numeric(F.regexp_replace(text, "&#X", "&#x"), "&#([0-9]+);", 10), "&#x([0-9a-fA-F]+);", 16)).otherwise(text)
    for name, char in named.items():  # the ampersand is last, so that nothing is decoded twice
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9.\-_]", "_")


def first_hint(text: Column, hints: list[str]) -> Column:
    """The first of the hints, in their order, that the lower-cased text holds."""
    return let(F.lower(text), lambda low: F.coalesce(*[F.when(low.contains(h), F.lit(h)) for h in hints]))


def to_fixed(x: Column, places: int = 2) -> Column:
    """Rounded by the exact binary value."""
    return F.replace(F.format_number(x, places), F.lit(","), F.lit("")).cast("double")


def rounded(x: Column) -> Column:
    """Halves up, also below zero."""
    return F.floor(x + 0.5)
