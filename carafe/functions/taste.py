"""Taste vectors and their fit to a preference. Dimensions run from 1 to 5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import rounded

DIMENSIONS = ("body", "acidity", "tannin", "sweetness")
# The preference of somebody who has stated none.
DEFAULT_PREFERENCE = {"body": 3, "acidity": 5, "tannin": 3, "sweetness": 1}
DEFAULT_WEIGHTS = {"body": 0.1, "acidity": 0.4, "tannin": 0.1, "sweetness": 0.4}


def clamped(x: Column) -> Column:
    """From 1 to 5; null for null, which the least and greatest of a list would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), rounded(x)))).cast("int")


def rescaled(x: Column) -> Column:
    """Whole numbers above 5 are of an older scale to 10."""
    return F.when((x > 5) & (x == F.floor(x)), clamped(rounded(x / 2))).otherwise(clamped(x))


def observed_taste(values: dict[str, Column], mode: Column, confidence: Column) -> Column:
    """A taste struct from observed dimensions, any of which may be null (3 is then assumed and the confidence lowered)."""
    seen = F.filter(F.array(*[F.when(values[d].isNotNull(), F.lit(d)) for d in DIMENSIONS]), lambda d: d.isNotNull())
    fields = [F.coalesce(rescaled(values[d]), F.lit(3)).alias(d) for d in DIMENSIONS]
    return F.struct(*fields, F.when(F.size(seen) == 4, mode).otherwise("mapped").alias("source_mode"), (confidence * F.size(seen) / 4).alias("confidence"), seen.alias("observed"))


def comparable(taste: Column) -> Column:
    whole = F.size(F.array_intersect(taste["observed"], F.array(*map(F.lit, DIMENSIONS)))) == 4
    return F.coalesce((taste["confidence"] > 0) & ((taste["source_mode"] == "inferred") | whole), F.lit(False))


def comparable_fit(taste: Column, status: Column) -> Column:
    return F.coalesce(comparable(taste) & ((taste["source_mode"] == "inferred") | (status == "matched")), F.lit(False))


def fit_score(taste: dict[str, Column], preference: dict[str, float | Column] = DEFAULT_PREFERENCE, weights: dict[str, float | Column] = DEFAULT_WEIGHTS) -> Column:
    """0 to 100: how near a taste is to the preference by weighted distance; 100 if nothing has a weight."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    away = sum((F.abs(value(preference[d]) - taste[d]) * value(weights[d]) for d in DIMENSIONS), F.lit(0.0))
    most = sum((value(weights[d]) * 4 for d in DIMENSIONS), F.lit(0.0))
    return F.when(most == 0, 100).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), rounded((1 - away / most) * 100)))).cast("int")


def status_of(score: Column) -> Column:
    return F.when(score >= 0.82, "matched").when(score >= 0.65, "low-confidence").otherwise("unmatched")


def match_scale(identity: Column, confident: float = 0.75, least: float = 0.6) -> Column:
    """An identity on the scale of ``status_of``: a confident one is 0.82 or more, the least that counts 0.65."""
    high, low = 0.82 + (identity - confident) * 0.72, 0.65 + (identity - least) * (0.16 / (confident - least))
    return F.when(identity >= confident, F.least(F.lit(1.0), high)).otherwise(F.greatest(F.lit(0.0), low))
