"""What a user calls: menus in, ranked recommendations out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.taste import DEFAULT_PREFERENCE, DEFAULT_WEIGHTS, DIMENSIONS, comparable_fit, fit_score
from ..operators import html, layout, menu
from ..operators.ranking import recommended_order


def analyze_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_of_year: int = 2025) -> DataFrame:
    """Candidates of menu texts."""
    return menu.parse_menus(docs, id_col, text_col, as_of_year)


def analyze_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", as_of_year: int = 2025) -> DataFrame:
    """Candidates of menu pages."""
    return menu.with_candidate_id(menu.from_items(html.menu_items(pages, id_col, html_col), as_of_year), id_col)


def analyze_words(words: DataFrame, id_col: str = "doc_id", as_of_year: int = 2025) -> DataFrame:
    """Candidates of photographed menus from their recognised words."""
    return menu.parse_menus(layout.page_texts(words, [id_col]), id_col, "text", as_of_year)


def preview(pages: DataFrame) -> DataFrame:
    return html.title_preview(pages)


def scored(recs: DataFrame, preference: dict = DEFAULT_PREFERENCE, weights: dict = DEFAULT_WEIGHTS) -> DataFrame:
    """Recommendations with ``eligible`` and a ``fit_score`` by the preference, 0 if the fit can't be compared."""
    taste, ok = F.col("taste"), comparable_fit(F.col("taste"), F.col("status"))
    return recs.withColumn("eligible", ok).withColumn("fit_score", F.when(ok, fit_score({d: taste[d] for d in DIMENSIONS}, preference, weights)).otherwise(0))


def ranked(recs: DataFrame, *ties) -> DataFrame:
    return recs.orderBy(*recommended_order(F.col("eligible"), F.col("fit_score"), F.col("match_confidence"), *ties))
