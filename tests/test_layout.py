"""Recognised words of photographs, read by their places."""

import pytest

from carafe.operators import layout
from carafe.sources import WORD_SCHEMA

SCHEMA = "doc string, " + WORD_SCHEMA


def page(doc, *words):
    """Words (line, left, top, width, text[, height, conf]) as rows of one block."""
    return [(doc, 5, 1, 1, 1, w[0], k, *w[1:4], w[5] if len(w) > 5 else 12, float(w[6] if len(w) > 6 else 95), w[4]) for k, w in enumerate(words)]


def read(spark, rows, **kw):
    return {r.doc: r.text for r in layout.page_texts(spark.createDataFrame(rows, SCHEMA), ["doc"], **kw).collect()}


def suffixed(doc, suffix, left, height=12):
    return page(doc, (1, 10, 10, 50, "Chateau"), (1, 70, 10, 50, "Margot"), (1, 160, 10, 20, "42"), (1, left, 10, 18, suffix, height))


GONE = [("_|", 205, 12), (".", 300, 12), ("‘3", 300, 44), ("~", 300, 12)]
KEPT = [("_|", 200, 12), (".", 184, 12), ("‘3", 300, 12), ("‘31", 300, 44), ("125", 300, 44), ("9*", 300, 44), ("/9.", 300, 44), ("€", 300, 12), ("₹", 300, 12), ("NA", 300, 44), ("glass", 300, 44), ("|", 300, 12), ("(9)", 300, 44), ("¶9", 300, 44), ("9₹", 300, 44)]


def test_blobs_apart_go_and_amounts_stay(spark):
    rows = [r for s in GONE + KEPT for r in suffixed("|".join(map(str, s)), *s)]
    rows += page("no price", (1, 10, 10, 50, "Chateau"), (1, 70, 10, 50, "Margot"), (1, 160, 10, 20, "4l"), (1, 300, 10, 18, "."))
    rows += page("alone", (1, 160, 10, 20, "42"), (1, 300, 10, 18, "."))
    out = read(spark, rows, by_layout=False)
    assert read(spark, suffixed("blob", ".", 300)) == {"blob": "Chateau Margot 42"} and read(spark, suffixed("two", "125", 300)) == {"two": "Chateau Margot\n42"}
    for s in GONE:
        assert out["|".join(map(str, s))] == "Chateau Margot 42", s
    for s in KEPT:
        assert out["|".join(map(str, s))] == f"Chateau Margot 42 {s[0]}", s
    assert out["no price"] == "Chateau Margot 4l ." and out["alone"] == "42 ."


def two_columns(doc, right, tilt=1.5):
    words = []
    for k in range(10):
        top, by = 40 + 30 * k + round(k * tilt), 2 * k
        words += [(k + 1, 20 + by, top, 60, "Near"), (k + 1, 90 + by, top, 80, f"Hill{k}"), (k + 1, 330 + by, top, 24, str(40 + k))]
        words += [(k + 1, left + by, top, 60, text.format(k=k, p=80 + k)) for left, text in right]
    return page(doc, *words)


def test_two_columns_are_read_one_after_the_other(spark):
    out = read(spark, two_columns("two", [(400, "Far"), (470, "Shore{k}"), (720, "{p}")]) + two_columns("notes", [(400, "crisp"), (470, "citrus"), (560, "flint")], 0), by_layout=False)
    lines = out["two"].split("\n")
    assert lines[:2] == ["Near Hill0 40", "Near Hill1 41"] and lines[10:12] == ["Far Shore0 80", "Far Shore1 81"] and len(lines) == 20
    assert out["notes"].split("\n")[0] == "Near Hill0 40 crisp citrus flint" and len(out["notes"].split("\n")) == 10


def test_cards_in_a_grid_give_a_block_per_price(spark):
    card = [(1, 10, 10, 60, "Filter:"), (1, 90, 10, 60, "everything"),
            (2, 10, 40, 60, "Stone"), (2, 75, 40, 60, "Orchard"), (2, 200, 40, 60, "Amber"), (2, 265, 40, 60, "Coast"),
            (3, 10, 60, 60, "Pinot"), (3, 75, 60, 40, "Noir"), (3, 200, 60, 60, "Riesling"),
            (4, 10, 90, 40, "$21.99"), (4, 60, 90, 30, "Sold"), (4, 95, 90, 30, "Out"), (4, 200, 90, 40, "$16.99"),
            (5, 10, 300, 60, "Long"), (5, 75, 300, 60, "Meadow"), (5, 200, 300, 60, "Quiet"), (5, 265, 300, 60, "Harbour"),
            (6, 10, 330, 40, "$9.99", 12, 3), (6, 200, 330, 40, "$24.99")]
    out = read(spark, page("grid", *card))
    assert out["grid"] == "Stone Orchard\nPinot Noir\n$21.99\n\nAmber Coast\nRiesling\n$16.99\n\nLong Meadow\n$9.99\n\nQuiet Harbour\n$24.99"
    assert read(spark, page("grid", *card), by_layout=False)["grid"].split("\n")[3] == "$21.99 Sold Out $16.99"


def test_priced_rows_stay_rows(spark):
    rows = page("rows", (1, 12, 12, 54, "old"), (1, 72, 12, 58, "'hare'"), (1, 138, 12, 40, "shiraz"), (1, 208, 12, 20, "75"), (2, 12, 46, 60, "new"), (2, 82, 46, 44, "'bare"), (2, 132, 46, 38, "white'"), (2, 208, 46, 20, "72"))
    assert read(spark, rows)["rows"] == "old 'hare' shiraz 75\nnew 'bare white' 72"


def test_odd_pages(spark):
    rows = [("empty", 5, 1, 1, 1, 1, 1, 10, 10, 20, 12, 90.0, " "), ("null", 5, 1, 1, 1, 1, 1, None, 10, 20, 12, 90.0, "word"), ("unsure", 5, 1, 1, 1, 1, 1, 10, 10, 20, 12, 5.0, "word")]
    assert read(spark, rows) == {} and read(spark, []) == {}
    twice = page("twice", (1, 10, 10, 50, "Chateau"), (1, 10, 10, 50, "Chateau"))
    assert read(spark, twice) == {"twice": "Chateau Chateau"}


@pytest.mark.parametrize("text, row, section", [("Sancerre, Loire 12/18/60", True, False), ("Sancerre 12/60", False, False), ("Gamay: NA/48,", False, False), ("Gamay, Loire NA / 48", True, False), ("Old Vine Zin 48", True, False), ("Zin 48", False, False), ("Old Vine 3", False, False), ("Red wine by the glass", False, True), ("Rosé wine", False, False), ("Reds bottle", False, False)])
def test_rows_and_sections(spark, text, row, section):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(text,)], "t string").select(layout.is_menu_row(F.col("t")), layout.is_menu_section(F.col("t"))).first()
    assert tuple(got) == (row, section)


def test_cards_are_read_without_python(spark, sf):
    from carafe.plans import QUERIES

    plan = QUERIES["photo_cards"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_tasks_of_reading_lines_stay_small_however_many_words(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(layout, "TASK_ROWS", 50, raising=False)
    most = []
    for pages in (100, 400):
        words = spark.range(pages * 5).select((F.col("id") % pages).alias("page"), (-0.02 * (F.col("id") % 3)).alias("y"), (F.col("id") / 7).alias("x"), "id")
        read = layout.reading_lines(words, ["page"], "y", "x", 0.015, "id")
        tasks = read.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.count_distinct("page").alias("pages")).collect()
        assert sum(r.n for r in tasks) == pages * 5 and sum(r.pages for r in tasks) == pages
        most.append(max(r.n for r in tasks))
    assert most[0] < 200 and most[1] < 200
