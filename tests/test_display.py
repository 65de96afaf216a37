from pyspark.sql import functions as F

from carafe.functions import display as D


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()[0]


def test_titles_say_an_overlap_once(spark):
    cases = [("Château Musar", "Musar Rouge", "x", "Château Musar Rouge"), ("A", None, "x", "A"), (None, None, "raw  text", "raw text"), (None, None, None, "Unmatched"), ("A B", "C", None, "A B C"), ("Dom. A", "dom a", None, "Dom. A")]
    df = spark.createDataFrame(cases, "p string, l string, r string, want string")
    for r in df.select("want", D.title(F.col("p"), F.col("l"), F.col("r"), F.lit(None).cast("string")).alias("got")).collect():
        assert r["got"] == r["want"]


def test_details_leave_out_what_the_title_says(spark):
    assert one(spark, D.details(F.lit("Ridge Zinfandel"), F.lit("zinfandel"), F.lit("Sonoma"), F.lit(2019))) == "Sonoma · 2019"


def test_flavour_groups(spark):
    schema = "g array<struct<group:string,color:string,score:double,keywords:array<struct<name:string,image:string>>>>"
    groups = [("oak", "#aabbcc", 1.0, [("Vanilla", None), ("vanilla", "//i/v.png"), (" ", None)]), ("red_fruit", "red", 9.0, [("cherry", None)]), ("empty", None, 99.0, []), (None, None, None, [("x", None), ("y", None)]), ("earth", None, -1.0, [("soil", None)])]
    got = spark.createDataFrame([(groups,), (None,), ([],)], schema).select(D.flavour_groups(F.col("g")).alias("f")).collect()
    best = got[0]["f"]
    assert [(g["key"], g["label"], g["score"], g["note_count"]) for g in best] == [("red-fruit", "Red Fruit", 9.0, 1), ("oak", "Oaky", 1.0, 1), ("other", "Other", None, 2)]
    assert best[1]["keywords"] == ["Vanilla"] and best[1]["images"] == ["https://i/v.png"] and best[1]["color"] == "#aabbcc" and best[0]["color"] is None
    assert got[1]["f"] is None and got[2]["f"] is None


def test_amounts_and_marks(spark):
    assert one(spark, D.money(F.lit(1234.0))) == "$1,234" and one(spark, D.money(F.lit(12.5))) == "$12.50"
    assert one(spark, D.indicator_ratio(F.lit(9))) == 1.0 and one(spark, D.star_fill(F.lit(3.25), 4)) == 0.25
