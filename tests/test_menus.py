"""Menus and pages to candidates, against worked cases."""

import pytest
from pyspark.sql import functions as F

from carafe.functions import rows as R
from carafe.operators import html
from carafe.plans import api

MENU = """RED WINES
Domaine Tempier Bandol 2019 - Provence, France $85
Ridge 'Lytton Springs' 2018
Dry Creek Valley
$72
Château Musar 2015 95
WHITE
Trimbach Riesling 2020 / 14
Keller | Riesling | Rheinhessen, Germany 17/68
chilled red - Jura, France
beer
Cloudy Bay Sauvignon Blanc
15 / 60
"""


@pytest.fixture(scope="module")
def parsed(spark):
    docs = spark.createDataFrame([(1, MENU, "x"), (2, None, "x"), (3, "", None), (4, "@@TAB: Cellar\n@@SECTION: White list\nDonnhoff Riesling 2021 $60", "y")], "doc_id long, text string, price string")
    return {(r["doc_id"], r["line_number"]): r for r in api.analyze_text(docs).collect()}


def test_each_item_of_a_menu_is_a_candidate(parsed):
    assert sorted(parsed) == [(1, 1), (1, 2), (1, 5), (1, 7), (1, 8), (1, 9), (1, 11), (4, 2)]


def test_fields_of_candidates(parsed):
    rows = {r["raw_text"]: r for r in parsed.values()}
    r = rows["Ridge 'Lytton Springs' 2018"]
    assert (r["producer"], r["label"], r["vintage"], r["price"], r["notes"], r["color"]) == ("Ridge", "Lytton Springs", 2018, "$72", "Dry Creek Valley", "red")
    r = rows["Keller, Riesling, Rheinhessen, Germany"]
    assert (r["varietal"], r["region"], r["price"], r["color"]) == ("riesling", "Rheinhessen, Germany", "$68", "white")
    r = rows["chilled red - Jura, France"]
    assert (r["producer"], r["label"], r["color"], r["region"]) == (None, "chilled red", "red", "Jura, France")
    r = rows["Cloudy Bay Sauvignon Blanc"]
    assert (r["producer"], r["label"], r["price"]) == ("Cloudy Bay", "Sauvignon Blanc", "$60")


def test_markers_set_tab_and_section(parsed):
    r = parsed[4, 2]
    assert (r["menu_tab"], r["menu_section"], r["color"], r["price"]) == ("Cellar", "White list", "white", "$60")


def test_row_tests(spark):
    cases = [("Napa, California", True), ("Louis Roederer, France", False), ("Burgundy, France", True), ("", False)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(c[0],) for c in cases], "t string").select("t", R.is_region_only(F.col("t"))).collect()}
    assert got == dict(cases)
    cases = [("G / B", True), ("glass bottle", True), ("draft list", True), ("Pliny IPA", True), ("x " * 150, True), ("Ridge Zinfandel 2019", False)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(c[0],) for c in cases], "t string").select("t", R.is_no_item(F.col("t"))).collect()}
    assert got == dict(cases)


PAGE = """<html><head><title>A &amp; B</title></head><body><nav>x</nav><h2>Red</h2><div>Ridge 'Lytton Springs' 2018 $72</div><div>Chateau Musar 2015</div>
<div>18</div><div>/</div><div>$80</div><h3>Cocktails</h3><p>Negroni 14</p></body></html>"""
DATA = """<script type="application/ld+json">{"@type":"Menu","hasMenuSection":{"name":"White","hasMenuItem":[{"name":"riesling","description":"Keller  2020",
"offers":[{"price":12},{"price":"55","description":"Bottle"}]},{"name":" "}]}}</script>"""


def test_pages_give_items(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, DATA), (3, None), (4, ""), (5, '<script type="application/ld+json">{broken</script>')], "page_id long, html string")
    got = sorted((r["page_id"], r["name"], r["price"], r["section"]) for r in html.menu_items(pages).collect())
    assert got == [(1, "Chateau Musar 2015", "$80", "Red"), (1, "Ridge 'Lytton Springs' 2018", "$72", "Red"), (2, "riesling Keller 2020", "$55", "White")]


def test_entities_and_links(spark):
    row = spark.createDataFrame([('&amp;lt; &#233;&#x2014;&eacute;&zzz; <a href="/m?page=2">', "ftp://a/b")], "t string, u string")
    from carafe.functions.text import decoded_entities

    got = row.select(decoded_entities(F.col("t")), html.pagination_links(F.col("t")), html.fetchable(F.col("u"))).first()
    assert tuple(got) == ('&lt; é—é&zzz; <a href="/m?page=2">', ["/m?page=2"], False)


def test_items_of_a_list_over_several_pages(spark):
    from carafe.operators import html

    item = "<li><p>{}</p><p>$40</p></li>"
    first = "<ul>" + item.format("Estate Alder, 2019") + '</ul><nav><a href="/list?page=2">2</a><a href="?page=2#top">2</a><a href="?page=3">3</a><a href="//other.example/x?page=4">4</a></nav>'
    known = [("https://wine.example/list", first), ("https://wine.example/list?page=2", "<ul>" + item.format("Estate Birch, 2018") + "</ul>"), ("https://other.example/x?page=4", "<ul>" + item.format("Estate Alder, 2019") + "</ul>")]
    pages = spark.createDataFrame([(1, *known[0]), (2, None, None)], "page_id int, url string, html string")
    out = html.paged_items(pages, spark.createDataFrame(known, "url string, html string")).select("page_id", "at", "name", "price").collect()
    assert sorted(map(tuple, out)) == [(1, 0, "Estate Alder, 2019", "$40"), (1, 1, "Estate Birch, 2018", "$40"), (1, 3, "Estate Alder, 2019", "$40")]
