"""Stored records: analyses and sidecar data as JSON.

Defined results: JSON that is missing or can't be read gives nulls (a sidecar: a struct of nulls); fields that older records lack are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .profile import CANDIDATE_FIELDS
from .taste import DIMENSIONS, rescaled

# Keys of stored JSON, in the order of the columns they become.
CANDIDATE_KEYS = ["id", "rawText", "confidence", "price", "menuTab", "menuSection", "producer", "label", "vintage", "color", "varietal", "region", "notes"]
SIDECAR_KEYS = ["mimeType", "sourceUrl"]
_CANDIDATE = {"id": "string", "raw_text": "string", "confidence": "double", **CANDIDATE_FIELDS}
_TASTE = ", ".join(f"{d}: double" for d in DIMENSIONS)


def _stored(text: Column, keys: list[str], kinds: list[str], names: list[str], many: bool) -> Column:
    """JSON with the stored keys as a struct (or an array of structs) with the columns' names."""
    as_struct = lambda fields: "struct<" + ", ".join(f"{n}: {k}" for n, k in zip(fields, kinds)) + ">"
    of = (lambda t: f"array<{t}>") if many else (lambda t: t)
    return F.from_json(text, of(as_struct(keys))).cast(of(as_struct(names)))


def sidecar(text: Column) -> Column:
    """struct(mime_type, source_url) of a sidecar's JSON; of nulls if it is missing or can't be read."""
    return _stored(F.coalesce(text, F.lit("{}")), SIDECAR_KEYS, ["string"] * 2, ["mime_type", "source_url"], False)


def decoded_candidates(text: Column) -> Column:
    """Candidates of a stored analysis, with every field; those that older records lack are null."""
    return _stored(text, CANDIDATE_KEYS, list(_CANDIDATE.values()), list(_CANDIDATE), True)


def rescaled_profiles(recommendations: Column) -> Column:
    """Recommendations with tastes on the present scale; those without a profile stay as they are."""
    def moved(rec: Column) -> Column:
        taste = rec["profile"]["taste"]
        for d in DIMENSIONS:
            taste = taste.withField(d, rescaled(rec["profile"]["taste"][d]))
        return F.when(rec["profile"].isNull(), rec).otherwise(rec.withField("profile", rec["profile"].withField("taste", taste)))
    return F.transform(recommendations, moved)


def decoded_recommendations(text: Column) -> Column:
    """Recommendations of a stored analysis, their tastes on the present scale."""
    taste = f"struct<{_TASTE}, {{}}: string, confidence: double>"
    kinds = ["string", "double", "double", f"struct<name: string, taste: {taste.format('sourceMode')}>"]
    read = F.from_json(text, "array<struct<" + ", ".join(f"{n}: {k}" for n, k in zip(["candidateId", "fitScore", "matchConfidence", "profile"], kinds)) + ">>")
    kinds[3] = f"struct<name: string, taste: {taste.format('source_mode')}>"
    return rescaled_profiles(read.cast("array<struct<" + ", ".join(f"{n}: {k}" for n, k in zip(["candidate_id", "fit_score", "match_confidence", "profile"], kinds)) + ">>"))
