"""Ranking, filtering and grouping of recommendations.

Recommendations have ``candidate_id``, ``fit_score``, ``match_confidence``, ``status`` and ``taste`` (null without a profile); candidates have
``candidate_id``, ``pos``, ``price``, ``menu_tab`` and ``menu_section``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.prices import number_in, within_budget
from ..functions.taste import comparable_fit


def recommended_order(eligible: Column, fit: Column, confidence: Column, *ties: Column) -> list[Column]:
    """Eligible fits first, by fit among them only; then confidence; then the ties."""
    return [eligible.desc(), F.when(eligible, fit).desc_nulls_last(), confidence.desc_nulls_last(), *ties]


def recommended(recs: DataFrame, *ties: Column) -> DataFrame:
    eligible = comparable_fit(F.col("taste"), F.col("status"))
    return recs.orderBy(*recommended_order(eligible, F.col("fit_score"), F.col("match_confidence"), *ties))


def with_candidates(recs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each recommendation with its candidate's columns, null if it has none. Adaptive execution picks the join's form by size."""
    return recs.join(candidates, "candidate_id", "left")


def discovered_order(pos: Column, rank: Column) -> list[Column]:
    """The candidates' own order, unknown ones last; then the rank so far."""
    return [pos.asc_nulls_last(), rank.asc_nulls_last()]


def section_id(tab: Column, section: Column) -> Column:
    return F.concat(F.coalesce(tab, F.lit("")), F.lit(":::"), F.coalesce(section, F.lit("")))


def section_label(tab: Column, section: Column, between: str = " · ") -> Column:
    label = F.concat_ws(between, F.when(tab != "", tab), F.when(section != "", section))
    return F.when(label == "", "Unlabeled results").otherwise(label)


def has_own_profile(taste: Column) -> Column:
    return F.coalesce(taste["source_mode"] != "inferred", F.lit(False))


def in_budget(recs: DataFrame, most: float | None, keep_unpriced: bool, price_col: str = "price") -> DataFrame:
    return recs.where(within_budget(number_in(F.col(price_col)), most, keep_unpriced))


def price_bounds(candidates: DataFrame, price_col: str = "price") -> DataFrame:
    """One row with low, high, priced and unpriced; none if no row has a price."""
    n = number_in(F.col(price_col))
    out = candidates.agg(F.greatest(F.lit(0), F.floor(F.min(n))).alias("low"), F.ceil(F.max(n)).alias("high"), F.count(n).alias("priced"), (F.count(F.lit(1)) - F.count(n)).alias("unpriced"))
    return out.where("priced > 0")


def sections(recs: DataFrame, *measures: Column) -> DataFrame:
    """One row per section, with measures and the place where it first appears (``first_pos``), by which sections are ordered."""
    ident = section_id(F.col("menu_tab"), F.col("menu_section"))
    label = section_label(F.first("menu_tab"), F.first("menu_section"))
    return recs.groupBy(ident.alias("section_id")).agg(label.alias("label"), F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"), *measures)


def in_section(recs: DataFrame, chosen: str | None) -> DataFrame:
    """The chosen section's rows; all rows if none is chosen or it has no rows. The test is one number, read by every task."""
    if chosen is None:
        return recs
    own = section_id(F.col("menu_tab"), F.col("menu_section")) == chosen
    there = recs.where(own).limit(1).agg(F.count(F.lit(1))).scalar()
    return recs.where(own | (there == 0))


def hidden_counts(recs: DataFrame, most: float | None, keep_unpriced: bool, price_col: str = "price") -> DataFrame:
    """One row: what the filters hide (``by_profile``: inferred profiles; ``by_price``: rows of the rest over the budget) and what is shown."""
    own, fits = has_own_profile(F.col("taste")), within_budget(number_in(F.col(price_col)), most, keep_unpriced)
    return recs.agg(F.count_if(~own).alias("by_profile"), F.count_if(own & ~fits).alias("by_price"), F.count_if(own & fits).alias("shown"))


def top_in_each(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each key. Spark limits each key's rows in each partition before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")
