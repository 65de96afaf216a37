"""Prices, tastes, tokens, styles and identities against worked cases."""

import pytest
from pyspark.sql import functions as F

from carafe.functions import identity as I
from carafe.functions import prices, quality, style, taste, tokens


def values(spark, cases, expression, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", expression(F.col("x")).alias("v")).orderBy("i").select("v").collect()]


def test_raw_prices(spark):
    cases = {"$95": "$95", "16 / 72": "$72", "18-75": "$75", "€45": "€45", "38 £": "£38", "kr 280": "kr 280", "45 chf": "CHF 45", "145": "$145", "3": None, "2500": None, "x": None, "": None, None: None}
    assert values(spark, list(cases), prices.raw_price) == list(cases.values())


def test_inline_prices(spark):
    got = values(spark, ["Ridge 2018 / 14", "Ridge 72", "Ridge 2018", "Ridge", None], prices.inline_price)
    assert [(r["title"], r["price"]) for r in got] == [("Ridge 2018", "$14"), ("Ridge", "$72"), ("Ridge 2018", None), ("Ridge", None), (None, None)]
    got = values(spark, ["Ridge: 15/60", "Ridge 2018 / 19", "Ridge NA / 60", "15/60"], prices.menu_price)
    assert [r and (r["title"], r["price"]) for r in got] == [("Ridge", "$60"), None, ("Ridge", "$60"), None]


def test_trailing_prices(spark):
    got = values(spark, ["Ridge 33/ 145", "Ridge 2019", "Ridge 45.50", "12 45"], prices.trailing_price)
    assert [r and tuple(r) for r in got] == [("Ridge", "$145"), None, ("Ridge", "$45"), None]


def test_vintages(spark):
    assert values(spark, ["Clos 2019", "Clos '22", "Clos '68", "12019", None], lambda x: prices.vintage(x, 2025)) == [2019, 2022, 1968, None, None]


def test_halves_round_up_and_old_scales_shrink(spark):
    assert values(spark, [2.5, 7.0, 6.5, -1.0], lambda x: taste.rescaled(x), "double") == [3, 4, 5, 1]


def test_fit_is_100_without_weights(spark):
    zero = {d: 0.0 for d in taste.DIMENSIONS}
    assert values(spark, [1], lambda x: taste.fit_score({d: x for d in taste.DIMENSIONS}, weights=zero), "int") == [100]


@pytest.mark.parametrize(("identity", "status"), [(0.9, "matched"), (0.75, "matched"), (0.7, "low-confidence"), (0.5, "unmatched")])
def test_identities_on_the_match_scale(spark, identity, status):
    assert values(spark, [identity], lambda x: taste.status_of(taste.match_scale(x)), "double") == [status]


def plain_quality(s):
    """The definition for ASCII texts, in plain Python."""
    import re

    kept = re.sub(r"\s+", " ", re.sub(r"[^A-Za-z0-9\s,.:/&+-]", " ", s.replace("'", " ").replace('"', " "))).strip()
    toks = [t for t in kept.lower().split() if re.search("[a-z]", t)]
    if not toks:
        return 0.0
    vowels, n = sum(bool(re.search("[aeiouy]", t)) for t in toks), len(toks)
    strong = sum(len(t) >= 3 for t in toks)
    score = len(re.sub("[^A-Za-z]", "", kept)) / max(1, len(kept.replace(" ", ""))) * 0.35 + (0.25 if strong >= 2 else 0.12 if strong else 0)
    score += 0.08 * any(len(t) >= 5 for t in toks) + 0.12 * (vowels >= min(2, n)) + 0.08 * bool(re.search("['\"]", s)) + 0.05 * bool(re.search(",| - |:", s))
    score -= min(0.14, sum(len(t) <= 2 for t in toks) / n * 0.14) + min(0.14, sum(bool(re.fullmatch(r"(.)\1+", t)) for t in toks) / n * 0.14)
    score -= 0.18 * (vowels == 0 and any(len(t) <= 3 for t in toks))
    return max(0.0, min(0.99, float(f"{score:.2f}")))


def test_text_quality(spark):
    cases = ["Ridge 'Lytton Springs' 2018", "xx zz", "a", "", "Keller, Riesling - dry", "bcd fgh", "1234", "Domaine de la Romanee: Conti, 1990"]
    assert values(spark, [*cases, None], quality.text_quality) == pytest.approx([*map(plain_quality, cases), 0.0])


def test_fuzzy_tokens(spark):
    pool = F.array(F.lit("grenouilles"), F.lit("ab"))
    got = values(spark, ["grenouilles", "grenoilles", "ac", "x"], lambda x: tokens.fuzzy_weight(x, pool))
    assert got == [1.0, 0.8, 0.0, 0.0]


def test_match_scores(spark):
    c = {f: F.lit(None).cast("string") for f in ("varietal", "region", "color")} | {"producer": F.lit("Fanny Sabre"), "label": F.lit("Bourgogne Rouge"), "raw_text": F.lit("Fanny Sabre Bourgogne Rouge"), "vintage": F.lit(2019)}
    profile = lambda label: {"producer": F.lit("Fanny Sabre"), "label": F.lit(label), "varietal": F.lit(None).cast("string"), "region": F.lit(None).cast("string"), "vintage": F.lit(2019)}
    same, other = spark.range(1).select(tokens.match_score(c, profile("Bourgogne Rouge")), tokens.match_score(c, profile("Cuvée Anatole"))).first()
    # all tokens agree: 0.5 + 0.18 + 0.18 * 0.6 (one label token) + vintage 0.1 + raw text 0.02 + concept 0.03
    assert same == pytest.approx(0.938) and other < 0.6


def test_styles(spark):
    cases = {"Louis Roederer Rosé Brut": "default_sparkling", "Sauvignon Blanc white": "sauvignon_blanc", "Grenache Blanc": "full_white", "Grenache white": "default_white", "Pinot Noir rosé wine": "rose_dry", "sparkling ginjo": "sake_sparkling", "house red": "default_red", "gin": None, "": None, None: None}
    assert values(spark, list(cases), style.style_key) == list(cases.values())


def test_more_style_entries_are_a_parameter(spark):
    entries = [*style.ENTRIES, ("bourgogne", "pinot_noir", 2, "chardonnay", None)]
    assert values(spark, ["Bourgogne blanc", "Bourgogne"], lambda x: style.style_key(x, entries)) == ["chardonnay", "pinot_noir"]


def test_identity_scores(spark):
    cases = [("Château Musar 2015", "Chateau Musar", "Musar Rouge", 0.65), ("Ridge 'Lytton Springs' 2018", "Ridge", "Lytton Springs", 1.0), ("Van Duzer", "Van Duzer", "Riesling", 0.58), ("", "A", "B", 0.0), (None, None, None, 0.0)]
    df = spark.createDataFrame(cases, "raw string, w string, n string, want double")
    row = {f: F.lit(None).cast("string") for f in ("producer", "label", "menu_section", "varietal")} | {"raw_text": F.col("raw")}
    for r in df.select("*", I.identity_score(row, {"winery": F.col("w"), "name": F.col("n"), "region": F.lit(None).cast("string")})["score"].alias("got")).collect():
        assert r["got"] == pytest.approx(r["want"]), r


def test_vintage_comparisons(spark):
    year = lambda x: F.lit(x).cast("int")
    cases = [(2019, "", 2019, "exact"), (2019, "", 2018, "conflict"), (None, "Brut NV", 2018, "conflict"), (None, "x", 2018, "unconstrained"), (2019, "", None, "unknown")]
    for a, text, b, want in cases:
        assert spark.range(1).select(I.compare_vintages(year(a), F.lit(text), year(b), F.lit(""))).first()[0] == want
