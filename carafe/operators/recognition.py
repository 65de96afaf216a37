"""Which of several recognised texts of one page is the best.

A text is worth what the menu parser finds in it: the confidences of its items, their number, lines that end in a price and items under a heading,
less lines of noise. Confidences have two places and are added as decimals, and scores are rounded to nine places before they are compared, so
equal texts have equal scores whatever order their items come in.

Scale. Texts are parsed where they lie; items are added up by text before anything is shuffled by page. A page's texts are as many as its
variants, which are gathered in one row.

Defined results: null and blank texts are worth minus infinity. Of equal scores the first variant wins. A page of blank texts has its first variant.
Repeated variants of a page count once, by their first text. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.profile import is_noise_line
from .menu import blocks, candidates_of

# What an item, a price at the end of a line and a heading are worth, and what a line of noise costs.
ITEM, PRICE, HEADED, NOISE = 0.35, 0.2, 0.01, 0.18
ENDS_IN_PRICE = r"(?:^|[\s:/])\$?\d{1,3}(?:\.\d{2})?\s*$"


def _said_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def variant_scores(variants: DataFrame, page: str = "page_id", variant: str = "variant", text: str = "text", as_of_year: int = 2025) -> DataFrame:
    """page, variant, text, score: ``variants`` once each, with what they are worth."""
    once = variants.groupBy(F.col(page).alias("page"), F.col(variant).alias("variant")).agg(F.min_by(F.col(text).cast("string"), F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    keyed = once.select(F.struct("page", "variant").alias("id"), "text")
    items = candidates_of(blocks(keyed, "id", "text"), as_of_year)
    found = items.groupBy("id").agg(F.sum(F.col("extraction_confidence").cast("decimal(18,2)")).cast("double").alias("sure"), F.count(F.lit(1)).alias("n"), F.count("menu_section").alias("headed"))
    said = keyed.withColumn("_l", _said_lines(F.col("text")))
    counted = said.select("id", "text", F.size(F.filter("_l", is_noise_line)).alias("noise"), F.size(F.filter("_l", lambda x: x.rlike(ENDS_IN_PRICE))).alias("priced"), (F.size("_l") > 0).alias("some"))
    n = F.coalesce("n", F.lit(0))
    score = F.coalesce("sure", F.lit(0.0)) + n * ITEM + F.col("priced") * PRICE + F.coalesce("headed", F.lit(0)) / F.greatest(n, F.lit(1)) * HEADED - F.col("noise") * NOISE
    out = counted.join(found, "id", "left").withColumn("score", F.when(F.col("some"), F.round(score, 9)).otherwise(float("-inf")))
    return out.select("id.page", "id.variant", "text", "score").withColumnsRenamed({"page": page, "variant": variant})


def best_variants(variants: DataFrame, page: str = "page_id", variant: str = "variant", text: str = "text", as_of_year: int = 2025) -> DataFrame:
    """page, variant, text, score, alternates (the other variants' texts in order): one row per page."""
    scored = variant_scores(variants, page, variant, text, as_of_year)
    every = scored.groupBy(page).agg(F.max_by(F.struct(F.col(variant).alias("v"), F.col(text).alias("t"), F.col("score").alias("s")), F.struct("score", -F.col(variant))).alias("_b"), F.array_sort(F.collect_list(F.struct(F.col(variant).alias("v"), F.col(text).alias("t")))).alias("_all"))
    others = F.transform(F.filter("_all", lambda x: x["v"] != F.col("_b.v")), lambda x: x["t"])
    return every.select(page, F.col("_b.v").alias(variant), F.col("_b.t").alias(text), F.col("_b.s").alias("score"), others.alias("alternates"))
