"""Recognised words with places: lines, columns and robust statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let

LINE_KEY = ["page", "block", "paragraph", "line"]

# Patterns and words that decide how recognised lines are read.
PRICE_WORD = r"^\$?\d{1,3}(?:\.\d{2})?$"
AMOUNT_SUFFIX = r"^(?=.*\p{N})[\p{N}\p{Sc}/|*†‡§¶#().,+−–—-]+$"
MARK_SUFFIX = r"^[/|*†‡§¶#\p{Sc}]+$"
ROW_END_PRICE = r"^[$€£]?\d{2,4}(?:[.,]\d{2})?[.,]?$"
SLASH_PRICES = r"(?i)(?:NA|\$?\d+(?:\.\d{2})?)(?:\s*/\s*(?:NA|\$?\d+(?:\.\d{2})?)){1,2}\s*$"
BARE_PRICE = r"^(.*\S)\s+(\d{1,3}(?:\.\d{2})?)\s*$"
SECTION_WORDS = ["red", "white", "rose", "rosé", "sparkling", "champagne", "orange", "sherry", "sake", "sweet"]
SECTION_CONTEXT = ["glass", "carafe", "bottle", "split", "wine", "wines"]
IGNORED_WORDS = ["sold", "out", "seal"]
TOOLBAR = ["filter:", "sort by:", "best selling", "products"]
BAND_GAP = 85
TITLE_REACH = 80
#: A task that sorts pages has about so many words (250 MB), however many there are.
TASK_ROWS = 1_200_000


def usable_words(words: DataFrame) -> DataFrame:
    """Words of recognition output: level 5 with text, and a confidence of 20 or a likely price."""
    sure = F.coalesce(F.floor("conf"), F.lit(0)) >= 20
    return words.where((F.col("level") == 5) & (F.trim("text") != "") & (sure | likely_price(F.col("text"))))


def likely_price(text: Column) -> Column:
    """A word that is an amount of 5 to 400."""
    word = F.trim(text)
    return F.coalesce(word.rlike(PRICE_WORD) & F.regexp_replace(word, r"^\$", "").try_cast("double").between(5, 400), F.lit(False))


def lines(words: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, text, left, top, bottom, center: words of a line from left to right. A line is short, so it may be gathered."""
    keys = keys or LINE_KEY
    ordered = F.array_sort(F.collect_list(F.struct("left", "text")))
    out = words.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"), F.min("left").alias("left"), F.max(F.col("left") + F.col("width")).alias("right"), F.min("top").alias("top"), F.max(F.col("top") + F.col("height")).alias("bottom"))
    return out.withColumn("center", (F.col("left") + F.col("right")) / 2)


def dealt(words: DataFrame, keys: list[str]) -> DataFrame:
    """The rows dealt by page over as many tasks as have ``TASK_ROWS`` each, one for each core at least; adaptive execution joins none of them.

    This counts ``words``, which for a stored table reads no column.
    """
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, -(-words.count() // TASK_ROWS))
    return words.repartition(tasks, *keys)


def reading_lines(words: DataFrame, keys: list[str], y: str, x: str, gap: float = 0.015, *ties: str) -> DataFrame:
    """The rows with ``line`` and ``place``, both from 0: from top (large y) to bottom, lines from the left.

    A line goes on as long as the next word down is no more than ``gap`` below the one before, wherever that lies, so a line that a tilt or a
    bound between buckets would part stays whole. Words without a place come last, in a line of their own. Equal places are told apart by ``ties``. A page is one window.
    A task sorts its words twice, so their number is bounded (``dealt``).
    """
    words = dealt(words, keys)
    down = Window.partitionBy(*keys).orderBy(F.col(y).desc_nulls_last(), F.col(x), *ties)
    breaks = F.coalesce((F.lag(y).over(down) - F.col(y) <= gap) | (F.lag(y).over(down).isNull() & F.col(y).isNull() & (F.row_number().over(down) > 1)), F.lit(False))
    lined = words.withColumn("_new", (~breaks).cast("int")).withColumn("line", F.sum("_new").over(down.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")
    return lined.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("line", F.col(x), F.col(y).desc_nulls_last(), *ties)) - 1)


def upper_median(df: DataFrame, keys: list[str], value: str, out: str = "median") -> DataFrame:
    """The middle value of each key, the upper one of two: ranks within the key, nothing gathered."""
    some = df.where(F.col(value).isNotNull())
    ranked = some.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias(out))


def clamped_fit(df: DataFrame, keys: list[str], y: str, x: str, most: float = 0.1) -> DataFrame:
    """keys, slope, intercept: least squares of x by y, the slope at most ``most`` either way, 0 if y doesn't vary."""
    slope = F.coalesce(F.greatest(F.lit(-most), F.least(F.lit(most), F.regr_slope(x, y))), F.lit(0.0))
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(slope.alias("slope"), (F.avg(x) - slope * F.avg(y)).alias("intercept"))


def gutter(df: DataFrame, keys: list[str], y: str, x: str, first: float, second: float) -> DataFrame:
    """``clamped_fit`` of the points within ``first`` of their median, fitted again within ``second`` of that fit."""
    near = df.join(upper_median(df, keys, x, "_m"), keys).where(F.abs(F.col(x) - F.col("_m")) <= first)
    rough = clamped_fit(near, keys, y, x).withColumnsRenamed({"slope": "_s", "intercept": "_i"})
    close = near.join(rough, keys).where(F.abs(F.col(x) - (F.col("_i") + F.col("_s") * F.col(y))) <= second)
    return clamped_fit(close, keys, y, x)


def column_of(left: Column, starts: Column, slack: float = 4.0) -> Column:
    """The number of the column with the greatest start at or before ``left`` and the slack; else 0. ``starts`` ascend."""
    return F.greatest(F.lit(0), F.size(F.filter(starts, lambda c: c <= left + slack)) - 1)


def word_lines(words: DataFrame, doc: list[str]) -> DataFrame:
    """doc and line key, ``words`` from left to right, ``top``, ``bottom``. A line is short, so it may be gathered."""
    word = F.struct("left", "word", "top", "width", "height", F.trim("text").alias("text"))
    return words.groupBy(*doc, *LINE_KEY).agg(F.array_sort(F.collect_list(word)).alias("words"), F.min("top").alias("top"), F.max(F.col("top") + F.col("height")).alias("bottom"))


def _named(word: Column) -> Column:
    return word["text"].rlike(r"\p{L}{2,}")


def _ends_row(word: Column) -> Column:
    return word["text"].rlike(ROW_END_PRICE) & ~word["text"].rlike(r"^(?:19|20)\d{2}$")


def _gap_after_price(words: Column, page_left: Column, span: Column) -> Column:
    """Middle of the first wide gap between a price and the next wine's words, in the middle three fifths of the page; else null."""
    heights = F.array_sort(F.transform(words, lambda w: w["height"]))
    height = F.get(heights, F.floor(F.size(words) / 2).cast("int"))

    def edges(i: Column) -> tuple[Column, Column]:
        return F.get(words, i)["left"] + F.get(words, i)["width"], F.get(words, i + 1)["left"]

    def splits(i: Column) -> Column:
        start, end = edges(i)
        middle = ((start + end) / 2 - page_left) / span
        before, after = F.exists(F.slice(words, 1, i), _named), F.size(F.filter(F.slice(words, i + 2, F.size(words)), _named))
        return middle.between(0.2, 0.8) & (end - start >= 1.5 * height) & _ends_row(F.get(words, i)) & before & (after >= 2)

    inner = F.when(F.size(words) > 2, F.sequence(F.lit(1), F.size(words) - 2))
    at = F.get(F.filter(inner, splits), F.lit(0))
    return (edges(at)[0] + edges(at)[1]) / 2


def split_columns(lines: DataFrame, doc: list[str]) -> DataFrame:
    """Lines of pages with two columns of priced rows cut at the gutter, with ``column`` and ``n``, the place in reading order from 0.

    The gutter is a line through the gaps after prices (``clamped_fit``, twice, without outliers), so tilted photographs split too. A page
    needs 8 lines, gaps in an eighth of them (4 at least) and prices in two fifths of the named right parts; other pages stay as they are.
    Everything is a window over the page, which is one exchange; a page is one photograph, so it is bounded.
    """
    page = Window.partitionBy(*doc)
    left = F.array_min(F.transform("words", lambda w: w["left"]))
    right = F.array_max(F.transform("words", lambda w: w["left"] + w["width"]))
    df = lines.withColumn("_n", F.count(F.lit(1)).over(page)).withColumn("_l", F.min(left).over(page)).withColumn("_s", F.max(right).over(page) - F.col("_l"))
    df = df.withColumn("_y", (F.col("top") + F.col("bottom")) / 2).withColumn("_x", F.when((F.col("_n") >= 8) & (F.col("_s") > 0), _gap_after_price(F.col("words"), F.col("_l"), F.nullif(F.col("_s"), F.lit(0)))))
    gaps = F.array_sort(F.collect_list("_x").over(page))
    df = df.withColumn("_m", F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")))
    enough = F.greatest(F.lit(4.0), F.col("_n") * 0.12)

    def fitted(df: DataFrame, near: Column) -> DataFrame:
        x, y = F.when(near, F.col("_x")), F.when(near, F.col("_y"))
        slope = F.coalesce(F.greatest(F.lit(-0.1), F.least(F.lit(0.1), F.regr_slope(x, y).over(page))), F.lit(0.0))
        at = F.avg(x).over(page) + slope * (F.col("_y") - F.avg(y).over(page))
        return df.withColumn("_at", F.when(F.count(x).over(page) >= enough, at))

    df = fitted(df, F.abs(F.col("_x") - F.col("_m")) <= F.col("_s") * 0.08)
    df = fitted(df, F.abs(F.col("_x") - F.col("_at")) <= F.col("_s") * 0.04)
    side = lambda test: F.filter("words", lambda w: test(w["left"] + w["width"] / 2))
    df = df.withColumn("_a", side(lambda c: c < F.col("_at"))).withColumn("_b", side(lambda c: c >= F.col("_at")))
    named = F.exists("_b", _named)
    priced = F.count_if(named & F.exists("_b", _ends_row)).over(page) / F.nullif(F.count_if(named).over(page), F.lit(0))
    df = df.withColumn("_two", F.coalesce(priced >= 0.4, F.lit(False)))
    part = lambda k, words: F.struct(F.lit(k).alias("column"), F.col(words).alias("words"))
    parts = F.when(F.col("_two"), F.filter(F.array(part(0, "_a"), part(1, "_b")), lambda p: F.size(p["words"]) > 0)).otherwise(F.array(part(0, "words")))
    out = df.select(*doc, *LINE_KEY, F.inline(parts))
    top, bottom = F.array_min(F.transform("words", lambda w: w["top"])), F.array_max(F.transform("words", lambda w: w["top"] + w["height"]))
    order = page.orderBy("column", "top", F.get("words", F.lit(0))["left"], *LINE_KEY)
    return out.withColumn("top", top).withColumn("bottom", bottom).withColumn("n", F.row_number().over(order) - 1)


def line_text(words: Column) -> Column:
    """The words of a line, without a blob of a page's edge that stands apart behind the price.

    What may be an amount, a mark or a word stays; a blob with one digit goes only if it is more than twice as high as the price.
    """
    last, price = F.element_at(words, -1), F.element_at(words, -2)
    titles = F.size(F.filter(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: w["text"].rlike(r"\p{L}")))
    apart = last["left"] - (price["left"] + price["width"]) > 2 * price["height"]
    digits = F.regexp_count(last["text"], F.lit(r"\p{N}"))
    blob = ~last["text"].rlike(r"\p{L}") & ~last["text"].rlike(AMOUNT_SUFFIX) & ~last["text"].rlike(MARK_SUFFIX)
    anomalous = (digits == 0) | ((digits == 1) & (last["height"] > 2 * price["height"]))
    drop = F.when(F.size(words) >= 4, likely_price(price["text"]) & blob & (titles >= 2) & apart & anomalous).otherwise(F.lit(False))
    kept = F.when(drop, F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    return F.array_join(F.transform(kept, lambda w: w["text"]), " ")


def is_menu_row(text: Column) -> Column:
    """A title with several slashed prices (and a comma or colon), or with two words and a bare price."""
    title_of = lambda t: F.regexp_replace(F.trim(t), r"[:\s]+$", "")
    amounts, title = F.regexp_extract(text, SLASH_PRICES, 0), title_of(F.regexp_replace(text, SLASH_PRICES, ""))
    several = (F.regexp_count(amounts, F.lit("/")) >= 2) | amounts.rlike(r"(?i)\bNA\b")
    slashed = several & title.rlike("[A-Za-z]") & title.rlike("[,:]")
    bare_title = title_of(F.regexp_extract(text, BARE_PRICE, 1))
    bare = likely_price(F.regexp_extract(text, BARE_PRICE, 2)) & (F.regexp_count(bare_title, F.lit("[A-Za-z]{2,}")) >= 2)
    return F.when(amounts != "", slashed).otherwise(bare)


def is_menu_section(text: Column) -> Column:
    """A colour or kind beside a serving or the word wine. Word ends are those of ASCII words."""
    end = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    has = lambda words: text.rlike(f"(?iu){end}(?:{'|'.join(words)}){end}")
    return has(SECTION_WORDS) & has(SECTION_CONTEXT)


def banded(lines: DataFrame, doc: list[str]) -> DataFrame:
    """Lines with ``prices``, their ``band`` (a line and the priced lines that follow closely) and ``band_prices``."""
    w = Window.partitionBy(*doc).orderBy("n")
    starts = (F.col("prices") == 0) | F.coalesce(F.col("top") - F.lag("bottom").over(w) > BAND_GAP, F.lit(True))
    df = lines.withColumn("prices", F.size(F.filter("words", lambda x: likely_price(x["text"])))).withColumn("_starts", starts.cast("int"))
    df = df.withColumn("band", F.sum("_starts").over(w)).drop("_starts")
    return df.withColumn("band_prices", F.sum("prices").over(Window.partitionBy(*doc, "band")))


def page_texts(words: DataFrame, doc: list[str], by_layout: bool = True) -> DataFrame:
    """doc, text: recognised words of a page (``sources.recognised_words`` with the columns ``doc``) as text for the menu parser.

    Pages of priced rows give their lines in reading order. Others (cards in a grid) give a block per price: the title lines of its column, from the band of
    priced lines and up to 80 pixels above it, then the price. Pages without such blocks give their lines; ``by_layout=False`` gives lines always.
    Pages without a usable word give no row. Word rows without a place or a text are left out.
    """
    places = ["left", "top", "width", "height"]
    used = usable_words(words).dropna(subset=[*places, "text"])
    lines = banded(split_columns(word_lines(used, doc), doc), doc).withColumn("text", line_text(F.col("words")))
    rows, sections = F.count_if(is_menu_row(F.col("text"))), F.count_if(is_menu_section(F.col("text")))
    word = F.transform("words", lambda w: F.struct(w["left"].alias("left"), w["text"].alias("text"), likely_price(w["text"]).alias("price")))
    ordered = F.array_sort(F.collect_list(F.struct("n", "text", "top", "band", (F.col("band_prices") >= 2).alias("priced"), word.alias("words"))))
    pages = lines.groupBy(*doc).agg(ordered.alias("lines"), (((rows >= 2) & (sections == 0)) | (rows >= 4)).alias("plain"))
    text = F.array_join(F.filter(F.transform("lines", lambda x: x["text"]), lambda t: t != ""), "\n")
    cards = F.when(~F.col("plain") & F.exists("lines", lambda x: x["priced"]) & F.lit(by_layout), F.col("lines"))
    found = F.when(cards.isNotNull(), card_texts(F.col("lines")))
    return pages.select(*doc, let(found, lambda c: F.when(F.size(c) > 0, F.array_join(c, "\n\n")).otherwise(text)).alias("text"))


def is_title(text: Column) -> Column:
    """Two words with letters, or one of five characters."""
    spoken = F.filter(F.split(F.regexp_replace(text, r"[^A-Za-z0-9\s+'’,.-]", " "), r"\s+"), lambda w: w.rlike("[A-Za-z]"))
    return let(spoken, lambda w: (F.size(w) >= 2) | F.exists(w, lambda x: F.length(x) >= 5))


def card_texts(lines: Column) -> Column:
    """An array of texts from a page's ordered lines (text, top, band, priced, words): a block per price of the bands with two prices or more.

    Bands come one after the other, as lines that one has used are no titles of the next: a fold whose state is which lines are used and the blocks
    so far. In a band each word belongs to the last price that starts no more than 4 pixels right of it. Titles are lines of the band and free
    ones above, up to the first free line that begins more than ``TITLE_REACH`` pixels above it.
    """
    numbered = F.transform(lines, lambda x, i: F.struct(i.alias("i"), x["text"].alias("text"), x["top"].alias("top"), x["band"].alias("band"), x["priced"].alias("priced"), x["words"].alias("words"), (is_title(x["text"]) & ~F.lower(x["text"]).rlike("|".join(map(re.escape, TOOLBAR)))).alias("title")))

    def folded(every: Column) -> Column:
        def placed(x: Column) -> Column:
            """The band's sources with their words in columns, and its prices from left to right."""
            first = F.get(x["members"], F.lit(0))
            above = F.filter(every, lambda k: (k["i"] < first["i"]) & ~F.array_contains(x["used"], k["i"]))
            stop = F.coalesce(F.array_max(F.transform(F.filter(above, lambda k: k["top"] < first["top"] - TITLE_REACH), lambda k: k["i"])), F.lit(-1))
            sources = F.concat(F.filter(above, lambda k: (k["i"] > stop) & k["title"]), x["members"])
            prices = F.array_sort(F.flatten(F.transform(x["members"], lambda k: F.transform(F.filter(F.transform(k["words"], lambda w, j: F.struct(w["left"].alias("left"), k["i"].alias("i"), j.alias("j"), w["text"].alias("text"), w["price"].alias("price"))), lambda w: w["price"]), lambda w: w))))
            return F.struct(sources.alias("sources"), prices.alias("prices"))

        def split(x: Column) -> Column:
            column = lambda w: F.greatest(F.lit(0), F.size(F.filter(x["prices"], lambda q: q["left"] <= w["left"] + 4)) - 1)
            own = lambda k: F.transform(F.filter(k["words"], lambda w: ~w["price"] & ~F.lower(w["text"]).isin(IGNORED_WORDS)), lambda w: F.struct(column(w).alias("c"), w["text"].alias("text")))
            return F.struct(F.transform(x["sources"], own).alias("rows"), x["prices"].alias("prices"), F.transform(x["sources"], lambda k: k["i"]).alias("lines"))

        def blocks(x: Column) -> Column:
            said = lambda c: F.filter(F.transform(x["rows"], lambda r: F.array_join(F.transform(F.filter(r, lambda w: w["c"] == c), lambda w: w["text"]), " ")), is_title)
            made = F.filter(F.transform(x["prices"], lambda q, c: let(said(c), lambda t: F.when(F.size(t) > 0, F.array_join(F.concat(t, F.array(q["text"])), "\n")))), lambda t: t.isNotNull())
            return F.struct(made.alias("made"), x["lines"].alias("lines"))

        def step(s: Column, band: Column) -> Column:
            members = F.filter(every, lambda k: k["priced"] & (k["band"] == band))
            found = let(let(let(F.struct(members.alias("members"), s["used"].alias("used")), placed), split), blocks)
            return let(found, lambda f: F.when(F.size(f["made"]) > 0, F.struct(F.concat(s["used"], f["lines"]).alias("used"), F.concat(s["blocks"], f["made"]).alias("blocks"))).otherwise(s))

        start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<string>").alias("blocks"))
        bands = F.array_distinct(F.transform(F.filter(every, lambda k: k["priced"]), lambda k: k["band"]))
        return F.aggregate(bands, start, step, lambda s: s["blocks"])

    return let(numbered, folded)
