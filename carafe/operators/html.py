"""Pages to tokens, items and links. A page is one row from end to end; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rows as R
from ..functions.lexicon import ITEM_SECTIONS, OTHER_SECTIONS, SECTION_FILLERS
from ..functions.prices import YEAR, raw_price, trailing_price
from ..functions.text import TITLE_ENTITIES, decoded_entities, let, squeeze, words

# Elements without content, the ends of blocks, and the label of hidden texts.
NOISE = ["script", "style", "noscript", "svg", "template", "nav", "header", "footer", "form", "figure", "head", "cart-drawer", "cart-notification", "menu-drawer"]
BLOCK_ENDS = ["div", "section", "article", "p", "li", "ul", "ol", "tr", "table", "label", "span", "main"]
HEADING = "@@HEADING@@"
_HIDDEN = r'(?i)<[^>]+\bclass="[^"]*\bvisually-hidden\b[^"]*"[^>]*>[\s\S]*?</[a-z]+>'
_SHORT_YEAR = r"['’‘`]\d{2}(?![A-Za-z0-9_])"
_LABEL = "['’‘\"][^'’‘\"]{2,}['’‘\"]"
_TOKEN = "array<struct<type:string,text:string>>"


def visible_lines(html: Column) -> Column:
    """The page's non-empty lines of text, decoded; headings of the second to fourth order begin with a mark."""
    text = F.when(html.contains("<!--"), F.regexp_replace(html, r"<!--[\s\S]*?-->", " ")).otherwise(html)
    text = F.regexp_replace(text, rf"(?i)<({'|'.join(NOISE)})\b[\s\S]*?</\1>", " ")
    text = F.when(text.contains("visually-hidden"), F.regexp_replace(text, _HIDDEN, " ")).otherwise(text)
    text = F.regexp_replace(text, "(?i)<h[234][^>]*>", f"\n{HEADING}")
    text = F.regexp_replace(text, rf"(?i)</(?:h[234]|{'|'.join(BLOCK_ENDS)})>|<br\s*/?>", "\n")
    text = decoded_entities(F.regexp_replace(text, "<[^>]+>", " "))
    text = F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.trim(F.regexp_replace(x, " *[\t\x0b\f\r\n ][\\s ]*| {2,}", " "))), lambda x: x != "")


def is_section_name(text: Column) -> Column:
    every = words(F.regexp_replace(F.lower(text), r"[^a-záàéèêëùûü\s&]", " "))
    return let(every, lambda w: F.size(w).between(1, 5) & F.forall(w, lambda x: x.isin(sorted({*ITEM_SECTIONS, *OTHER_SECTIONS, *SECTION_FILLERS}))))


def is_other_section(section: Column) -> Column:
    return F.coalesce(F.exists(F.split(F.regexp_replace(F.lower(section), r"[^a-z\s]", " "), r"\s+"), lambda w: w.isin(OTHER_SECTIONS)), F.lit(False))


def has_structure(text: Column) -> Column:
    return text.contains("|") | text.rlike(YEAR) | text.rlike(_LABEL)


def _tokens_of(line: Column) -> Column:
    token = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    heading = line.startswith(HEADING)

    def of(text: Column) -> Column:
        named = text.rlike(YEAR) | text.rlike(_SHORT_YEAR) | text.rlike(_LABEL) | text.rlike(r"\s+-\s+") | text.contains(",")
        item = ~heading | named | (~is_section_name(text) & (F.size(words(text)) > 4))
        per_unit = r"(?i)^(\d+(?:\.\d{2})?)\s+per\s+(glass|bottle)$"
        bottle = F.when(F.lower(F.regexp_extract(text, per_unit, 2)) == "bottle", raw_price(F.regexp_extract(text, per_unit, 1)))
        nothing = F.array().cast(_TOKEN)

        def found(x: Column) -> Column:
            whole = F.when(~heading & x["price"].isNotNull(), F.array(token("price", x["price"]))).when(~heading & is_section_name(text), F.array(token("section", text))).otherwise(F.array(token("text", text)))
            return F.when(x["inline"].isNotNull(), F.array(token("text", x["inline"]["name"]), token("price", x["inline"]["price"]))).otherwise(whole)

        body = let(F.struct(trailing_price(text).alias("inline"), raw_price(text).alias("price")), found)
        unit = F.when(bottle.isNotNull(), F.array(token("price", bottle))).otherwise(nothing)
        out = F.when(text == "", nothing).when(~item, F.array(token("section", text)))
        return out.when(~heading & text.rlike(r"^(glass|bottle)\s*\$\s*$"), nothing).when(~heading & text.rlike(per_unit), unit).otherwise(body).cast(_TOKEN)

    return let(F.trim(F.regexp_replace(line, f"^{HEADING}", "")), of)


def leaf_tokens(html: Column) -> Column:
    """Sections, prices and texts of a page in order."""
    return F.flatten(F.transform(visible_lines(html), _tokens_of))


def page_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Items of pages: id, pos, name, price, section, tab.

    A fold over a page's tokens: names gather until a price, a section or a new title; a price may come before or after its name; a larger
    price after a slash replaces the last one. Of items with equal name and price the last stays.
    """
    state = "struct<items:array<struct<name:string,price:string,section:string>>,names:array<string>,pending:string,section:string,just:boolean,slash:boolean>"
    item = lambda name, price, section: F.struct(name.alias("name"), price.alias("price"), section.alias("section"))

    def judged(t: Column) -> Column:
        text, is_text = t["text"], t["type"] == "text"
        other = is_text & R.is_no_item(text)
        title = is_text & ~other & R.starts_title(text, R.facts(text))
        return F.struct(t["type"].alias("type"), text.alias("text"), other.alias("other"), title.alias("title"), has_structure(text).alias("marked"), is_other_section(text).alias("foreign"))

    def made(items, names, pending, section, just, slash) -> Column:
        return F.struct(items.alias("items"), names.alias("names"), pending.alias("pending"), section.alias("section"), just.alias("just"), slash.alias("slash"))

    none, nothing, no = F.lit(None).cast("string"), F.array().cast("array<string>"), F.lit(False)

    def flushed(s: Column, price: Column) -> Column:
        """The items with the gathered name, unless it or its section is about something else."""
        joined = F.regexp_replace(F.trim(F.array_join(s["names"], " ")), r"\s*\|\s*", ", ")
        return F.when(F.size(s["names"]) == 0, s["items"]).otherwise(let(joined, lambda name: F.when((name == "") | R.is_no_item(name) | is_other_section(s["section"]), s["items"]).otherwise(F.concat(s["items"], F.array(item(name, price, s["section"]))))))

    def step(s: Column, t: Column) -> Column:
        named = F.size(s["names"]) > 0
        section = made(flushed(s, s["pending"]), nothing, none, t["text"], no, no)
        # a price
        digits = lambda p: F.coalesce(F.regexp_replace(p, r"\D", "").try_cast("bigint"), F.lit(0))
        last = F.try_element_at(s["items"], F.lit(-1))
        upgraded = F.concat(F.slice(s["items"], 1, F.greatest(F.size(s["items"]) - 1, F.lit(0))), F.array(item(last["name"], t["text"], last["section"])))
        raised = F.when((F.size(s["items"]) > 0) & (digits(t["text"]) > digits(last["price"])), upgraded).otherwise(s["items"])
        before = s["pending"].isNotNull()
        price = F.when(named, made(flushed(s, F.coalesce(s["pending"], t["text"])), nothing, F.when(before, t["text"]), s["section"], ~before, s["slash"]))
        price = price.when(s["just"] & s["slash"], made(raised, s["names"], s["pending"], s["section"], s["just"], no)).when(s["just"], s).otherwise(made(s["items"], s["names"], t["text"], s["section"], s["just"], s["slash"]))
        # a text
        mark = made(s["items"], s["names"], s["pending"], s["section"], s["just"], s["slash"] | t["text"].contains("/"))
        other = F.when(~t["text"].rlike("[A-Za-z]"), mark).otherwise(made(flushed(s, s["pending"]), nothing, none, s["section"], no, no))
        anew = named & ((~s["slash"] & t["title"]) | F.array_contains(s["names"], t["text"]))
        prose = named & ~s["slash"] & ~t["marked"] & has_structure(F.array_join(s["names"], " "))
        text = F.when(anew, made(flushed(s, s["pending"]), F.array(t["text"]), none, s["section"], no, no)).when(prose, s).otherwise(made(s["items"], F.concat(s["names"], F.array(t["text"])), s["pending"], s["section"], no, no))
        return F.when(t["type"] == "section", section).when(t["type"] == "price", price).when(t["other"], other).otherwise(text).cast(state)

    tokens = pages.select(id_col, leaf_tokens(F.col(html_col)).alias("_t")).withColumn("_t", F.transform("_t", judged))
    start = made(F.array().cast("array<struct<name:string,price:string,section:string>>"), nothing, none, none, no, no).cast(state)
    found = tokens.select(id_col, F.aggregate("_t", start, step, lambda s: flushed(s, s["pending"])).alias("_i"))
    key = lambda x: F.struct(R.plain_key(x["name"]).alias("n"), F.coalesce(x["price"], F.lit("")).alias("p"))
    found = found.withColumn("_k", F.transform("_i", key))
    kept = F.filter("_i", lambda x, i: ~F.array_contains(F.slice(F.col("_k"), i + 2, F.greatest(F.size("_k"), F.lit(1))), F.get(F.col("_k"), i)))
    return found.select(id_col, F.posexplode_outer(kept).alias("pos", "_x")).where("_x is not null").select(id_col, "pos", "_x.name", "_x.price", "_x.section", F.lit(None).cast("string").alias("tab"))


def json_ld_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Items of schema.org menus in the page: id, pos, name, price, section, tab. The bottle's offer counts, else the largest of 5 to 2000."""
    blocks = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)<script[^>]+type=["']application/ld\+json["'][^>]*>([\s\S]*?)</script>"""), F.lit(1))
    many = lambda c: f"if(schema_of_variant({c}) like 'ARRAY%', cast({c} as array<variant>), array({c}))"
    df = pages.select(id_col, F.posexplode(blocks).alias("_b", "_json")).withColumn("_v", F.try_parse_json("_json")).where("_v is not null")
    df = df.select(id_col, "_b", F.posexplode(F.expr(many("_v"))).alias("_r", "_v")).where("try_variant_get(_v, '$[\"@type\"]', 'string') = 'Menu'")
    df = df.withColumn("_v", F.expr("try_variant_get(_v, '$.hasMenuSection', 'variant')")).where("_v is not null").select(id_col, "_b", "_r", F.posexplode(F.expr(many("_v"))).alias("_s", "_v"))
    df = df.withColumn("section", F.expr("nullif(trim(try_variant_get(_v, '$.name', 'string')), '')")).where(~is_other_section(F.col("section")))
    df = df.withColumn("_v", F.expr("try_variant_get(_v, '$.hasMenuItem', 'variant')")).where("_v is not null").select(id_col, "_b", "_r", "_s", "section", F.posexplode(F.expr(many("_v"))).alias("_n", "_v"))
    df = df.withColumn("name", F.expr("nullif(trim(try_variant_get(_v, '$.name', 'string')), '')")).where("name is not null")
    said = squeeze(F.expr("try_variant_get(_v, '$.description', 'string')"))
    df = df.withColumn("name", F.concat_ws(" ", "name", F.when(said != "", said))).withColumn("_o", F.expr("try_variant_get(_v, '$.offers', 'variant')"))
    offers = F.expr(f"transform(if(_o is null, array(), {many('_o')}), o -> struct(try_variant_get(o, '$.price', 'double') as price, lower(try_variant_get(o, '$.description', 'string')) as said))")
    df = df.withColumn("_o", F.filter(offers, lambda o: o["price"].between(5, 2000)))
    bottle = F.get(F.filter("_o", lambda o: o["said"].contains("bottle")), F.lit(0))["price"]
    best = F.coalesce(bottle, F.array_max(F.transform("_o", lambda o: o["price"])))
    return df.select(id_col, F.struct("_b", "_r", "_s", "_n").alias("pos"), "name", F.concat(F.lit("$"), F.floor(best + 0.5).cast("string")).alias("price"), "section", F.lit(None).cast("string").alias("tab"))


def menu_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Items of pages by their structured data, or by their text where there is none; unpriced twins of priced items go."""
    from .keyed import without_priceless_twins

    structured = json_ld_items(pages, id_col, html_col).drop("pos")
    plain = page_items(pages.join(structured.select(id_col).distinct(), id_col, "left_anti"), id_col, html_col).drop("pos")
    both = structured.unionByName(plain).withColumn("_key", R.plain_key(F.col("name")))
    return without_priceless_twins(both, [id_col, "section", "_key"], "price").drop("_key")


def pagination_links(html: Column, most: int = 9) -> Column:
    """The first distinct links to further pages of a list."""
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"#]*[?&]page=\d+[^"]*)"'), F.lit(1))), 1, most)


def resolved(href: Column, base: Column) -> Column:
    """An address as seen from the page ``base``, without its fragment. Dot segments stay as they are; null if ``base`` is no address."""
    bare = F.regexp_replace(href, "#.*$", "")
    site, path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0), F.regexp_extract(base, r"^[^?#]*", 0)
    folder = F.when(path == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_extract(path, r"^.*/", 0))
    own = F.when(path == site, folder).otherwise(path)
    seen = F.when(bare.startswith("//"), F.concat(F.regexp_extract(base, "^[^:]*:", 0), bare)).when(bare.startswith("/"), F.concat(site, bare)).when(bare.startswith("?"), F.concat(own, bare)).otherwise(F.concat(folder, bare))
    return F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), bare).when(site != "", seen)


def list_pages(pages: DataFrame, known: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, at, url, html: each page (``at`` 0) and the further pages of its list, as ``at`` 1 to 9 in the order in which they are linked first.

    ``known`` has fetched pages by address (of several with one address, any one is taken); what isn't known gives no row.
    """
    own = pages.select(F.col(id_col), F.lit(0).alias("at"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    every = pagination_links(F.col("html"), 2**31 - 1)
    addresses = F.slice(F.array_distinct(F.filter(F.transform(every, lambda h: resolved(h, F.col("url"))), lambda u: u.isNotNull())), 1, 9)
    linked = own.select(id_col, F.posexplode(addresses).alias("k", "url"))
    fetched = known.groupBy(F.col(url_col).alias("url")).agg(F.any_value(html_col).alias("html"))
    return own.unionByName(linked.join(fetched, "url").select(id_col, (F.col("k") + 1).alias("at"), "url", "html"))


def paged_items(pages: DataFrame, known: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``menu_items`` of all ``list_pages``, with ``at``. Items that two pages share stay twice."""
    every = list_pages(pages, known, id_col, url_col, html_col)
    items = menu_items(every.select(F.struct(F.col(id_col).alias("id"), "at").alias("part"), "html"), "part", "html")
    return items.select(F.col("part.id").alias(id_col), F.col("part.at").alias("at"), *[c for c in items.columns if c != "part"])


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"#]+)"'), F.lit(1)))


def title_preview(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, title (decoded; null without one) and domain."""
    raw = F.trim(F.regexp_extract(html_col, r"(?i)<title[^>]*>([^<]+)</title>", 1))
    return pages.select(id_col, decoded_entities(F.when(raw != "", raw), TITLE_ENTITIES).alias("title"), F.try_parse_url(F.col(url_col), F.lit("HOST")).alias("domain"))


def fetchable(url: Column) -> Column:
    """Web addresses that are no PDF."""
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https") & ~path.endswith(".pdf"), F.lit(False))
