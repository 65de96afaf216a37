"""Queries over written photographs and pages: the parts as lists in one or two columns, as cards in a grid and as lists over several pages. The SQL says what
should be read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import html, layout
from .queries import query, table

_LEFT = "concat(p_name, ' ', 10 + p_size)"
_RIGHT = "concat(p_type, ' ', p_brand, ' ', 60 + p_size)"


def _words(spark: SparkSession, sf_dir: str, per_page: int, *words: tuple[str, str, str, str, str]) -> DataFrame:
    """Word rows from expressions over the parts: line, left, top, width and text (null: no such word); ``per_page`` parts are a page."""
    made = [f"named_struct('line', int({line}), 'word', {k}, 'left', int({left}), 'top', int({top}), 'width', int({width}), 'text', {text})" for k, (line, left, top, width, text) in enumerate(words)]
    parts = table(spark, sf_dir, "part").withColumn("photo", F.expr(f"p_partkey div {per_page}")).withColumn("r", F.expr(f"int(p_partkey % {per_page})"))
    rows = parts.select("photo", "p_partkey", F.inline(F.expr(f"filter(array({', '.join(made)}), w -> w.text is not null)")))
    unsure = F.col("text").contains("smudge") | (F.col("text").rlike(r"^\d+$") & (F.col("p_partkey") % 4 == 0))
    fixed = {"level": 5, "page": 1, "block": 1, "paragraph": 1, "height": 12}
    return rows.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumn("conf", F.when(unsure, 10.0).otherwise(95.0))


def _pieces(texts: DataFrame, by: str, out: str) -> DataFrame:
    return texts.select("photo", F.posexplode(F.split("text", by)).alias("n", out))


@query("photo_lines", f"""WITH p AS (SELECT *, p_partkey // 12 AS photo, p_partkey % 12 AS r, count(*) OVER (PARTITION BY p_partkey // 12) AS n_rows FROM part)
  SELECT photo, r AS n, CASE photo % 3 WHEN 1 THEN concat({_LEFT}, ' ', p_type, ' ', p_brand) ELSE {_LEFT} END AS line FROM p
  UNION ALL SELECT photo, n_rows + r, {_RIGHT} FROM p WHERE photo % 3 = 0""")
def photo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tilted lists: two columns (photo % 3 = 0), prices before notes (1), one column (2); blobs apart behind prices and smudges go, unsure prices stay."""
    top, at = "40 + 31 * r", lambda left: f"{left} + 2 * r"
    blob = "case when p_partkey % 5 = 0 and photo % 3 {} then '_|' end"
    words = _words(
        spark, sf_dir, 12,
        ("r", at(20), top, "60", "split(p_name, ' ')[0]"), ("r", at(90), top, "60", "split(p_name, ' ')[1]"), ("r", at(330), top, "24", "string(10 + p_size)"),
        ("r", at(400), top, "60", "case when photo % 3 < 2 then p_type end"), ("r", at(470), top, "60", "case when photo % 3 < 2 then p_brand end"),
        ("r", at(720), top, "24", "case when photo % 3 = 0 then string(60 + p_size) end"), ("r", at(800), top, "8", blob.format("= 0")),
        ("r", at(420), top, "8", blob.format("= 2")), ("r", at(180), top, "50", "case when p_partkey % 11 = 0 then 'smudge' end"))
    return _pieces(layout.page_texts(words, ["photo"], by_layout=False), "\n", "line")


@query("photo_cards", """SELECT p_partkey // 8 AS photo, p_partkey % 8 AS n, concat(p_name, chr(10), p_type, ' ', p_brand, chr(10), '$', 10 + p_size, '.99') AS card FROM part""")
def photo_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight cards a photo, four beside each other: two title lines, then a price; a toolbar above and "Sold Out" marks go."""
    first, second, down = "300 * (r % 4) + 10", "300 * (r % 4) + 75", lambda y: f"{y} + 400 * (r div 4)"
    line = lambda k: f"10 * (r div 4) + {k}"
    sold = "case when p_partkey % 6 = 0 then '{}' end"
    words = _words(
        spark, sf_dir, 8,
        ("0", "10", "20", "60", "case when r = 0 then 'Filter: all' end"), ("0", "80", "20", "60", "case when r = 0 then 'products' end"),
        (line(1), first, down(40), "60", "split(p_name, ' ')[0]"), (line(1), second, down(40), "60", "split(p_name, ' ')[1]"),
        (line(2), first, down(60), "60", "p_type"), (line(2), second, down(60), "60", "p_brand"),
        (line(3), first, down(90), "50", "concat('$', 10 + p_size, '.99')"), (line(3), "300 * (r % 4) + 70", down(90), "30", sold.format("Sold")), (line(3), "300 * (r % 4) + 105", down(90), "30", sold.format("OUT")))
    return _pieces(layout.page_texts(words, ["photo"]), "\n\n", "card")


@query("list_pages", """WITH k AS (SELECT DISTINCT p_brand AS list, p_size % 12 AS "at" FROM part), u AS (SELECT list, "at", concat('https://lists.example/', replace(list, '#', '-'), CASE WHEN "at" > 0 THEN concat('?page=', "at" + 1) ELSE '' END) AS url FROM k)
  SELECT list, "at", url, md5(CASE WHEN "at" = 0 THEN 'first' ELSE concat('page ', "at" + 1) END) AS content FROM u WHERE "at" < 10 AND list IN (SELECT list FROM k WHERE "at" = 0)""")
def list_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list per brand over up to 12 pages; the first links to all others, each in three forms; the first nine count, as far as they are known."""
    pages = table(spark, sf_dir, "part").select(F.col("p_brand").alias("list"), F.expr("p_size % 12").alias("k")).distinct()
    pages = pages.withColumn("site", F.concat(F.lit("https://lists.example/"), F.replace("list", F.lit("#"), F.lit("-")))).withColumn("path", F.substring("site", 22, 100))
    links = "".join(f'<a href="{start}?page={k + 1}">{k + 1}</a>' for k in range(1, 12) for start in ("", "{site}", "{path}"))
    body = F.replace(F.replace(F.lit(links), F.lit("{site}"), F.col("site")), F.lit("{path}"), F.col("path"))
    number = (F.col("k") + 1).cast("string")
    pages = pages.select("list", "k", F.when(F.col("k") == 0, F.col("site")).otherwise(F.concat("site", F.lit("?page="), number)).alias("url"), F.when(F.col("k") == 0, body).otherwise(F.concat(F.lit("page "), number)).alias("html"))
    content = F.md5(F.when(F.col("at") == 0, "first").otherwise(F.col("html")).cast("binary"))
    return html.list_pages(pages.where("k = 0"), pages, "list").select("list", "at", "url", content.alias("content"))
