"""Lines and tokens of pages, and items of pages that are written from the parts, with SQL that states the rules again.

The noise strip of the library refers back to the tag that it opened; the SQL lists the tags instead. Pages have no numeric entities.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prices
from ..functions.lexicon import ITEM_SECTIONS, OTHER_SECTIONS, SECTION_FILLERS
from ..functions.text import ENTITIES
from ..operators import html
from . import lines as L
from . import menus as M
from .lines import _list
from .queries import query, table


def _noise() -> str:
    return "(?is)" + "|".join(rf"<{re.escape(t)}\b.*?</{re.escape(t)}>" for t in html.NOISE)


def _decoded(x: str) -> str:
    for name, char in ENTITIES.items():
        x = f"replace({x}, '&{name};', {chr(39) + char.replace(chr(39), chr(39) * 2) + chr(39)})"
    return x


def _lines_sql(source: str) -> str:
    """v(page_id, pos, line) of ``source``(page_id, html)."""
    ends = "|".join(html.BLOCK_ENDS)
    text = r"regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
    text = f"regexp_replace({text}, '{_noise()}', ' ', 'g')"
    text = rf"""regexp_replace({text}, '(?is)<[^>]+\bclass="[^"]*\bvisually-hidden\b[^"]*"[^>]*>.*?</[a-z]+>', ' ', 'g')"""
    text = f"regexp_replace({text}, '(?i)<h[234][^>]*>', chr(10) || '{html.HEADING}', 'g')"
    text = rf"regexp_replace({text}, '(?i)</(?:h[234]|{ends})>|<br\s*/?>', chr(10), 'g')"
    text = _decoded(f"regexp_replace({text}, '<[^>]+>', ' ', 'g')")
    text = rf"regexp_replace({text}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')"
    split = rf"list_filter(list_transform(regexp_split_to_array({text}, '\r?\n'), lambda x: trim(regexp_replace(x, '[\s\x{{A0}}]+', ' ', 'g'))), lambda x: x <> '')"
    return f"{source}, cut AS (SELECT page_id, {split} AS lines FROM src), v AS (SELECT page_id, i - 1 AS pos, lines[i] AS line FROM cut, unnest(range(1, len(lines) + 1)) AS u(i))"


_PAGES = "src AS (SELECT page_id, html FROM pages)"


@query("page_lines", f"WITH {_lines_sql(_PAGES)} SELECT page_id, pos, line FROM v")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible lines of pages."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.visible_lines(F.col("html"))).alias("pos", "line"))


def _raw_price(t: str) -> str:
    two = lambda mark: rf"^\$?([0-9]+)\s*{mark}\s*\$?([0-9]+)(?:\.[0-9]{{2}})?$"
    larger = " ".join(f"WHEN regexp_matches({t}, '{two(m)}') THEN '$' || greatest(CAST(regexp_extract({t}, '{two(m)}', 1) AS BIGINT), CAST(regexp_extract({t}, '{two(m)}', 2) AS BIGINT))" for m in ("/", "[-–]"))

    def money(lead: str, trail: str, unit: str) -> str:
        amount = f"TRY_CAST(replace(CASE WHEN regexp_matches({t}, '{lead}') THEN regexp_extract({t}, '{lead}', 2) ELSE regexp_extract({t}, '{trail}', 1) END, ',', '') AS DOUBLE)"
        said = f"CASE WHEN regexp_matches({t}, '{lead}') THEN regexp_extract({t}, '{lead}', 1) ELSE regexp_extract({t}, '{trail}', 2) END"
        plain = f"CASE WHEN {amount} = floor({amount}) THEN CAST(CAST({amount} AS BIGINT) AS VARCHAR) ELSE printf('%.2f', {amount}) END"
        return f"WHEN (regexp_matches({t}, '{lead}') OR regexp_matches({t}, '{trail}')) AND {amount} BETWEEN 5 AND 20000 THEN {unit.format(said)} || {plain}"

    symbol = money(r"^([€£¥₩₹])\s*([0-9][0-9,.]*)$", r"^([0-9][0-9,.]*)\s*([€£¥₩₹])$", "{0}")
    codes = "EUR|GBP|CHF|SEK|DKK|NOK|JPY|CAD|AUD|NZD|kr"
    code = money(rf"(?i)^({codes})\s+([0-9][0-9,.]*)$", rf"(?i)^([0-9][0-9,.]*)\s+({codes})$", "CASE WHEN length({0}) = 2 THEN lower({0}) ELSE upper({0}) END || ' '")
    bare = rf"WHEN TRY_CAST(nullif(regexp_extract({t}, '^\$?([0-9]+)(?:\.[0-9]{{2}})?$', 1), '') AS BIGINT) BETWEEN 5 AND 2000 THEN '$' || TRY_CAST(regexp_extract({t}, '^\$?([0-9]+)(?:\.[0-9]{{2}})?$', 1) AS BIGINT)"
    return rf"CASE WHEN regexp_matches({t}, '^\$[0-9]+(?:\.[0-9]{{2}})?$') THEN {t} {larger} {symbol} {code} {bare} END"


_LABEL = "[''’‘\"][^''’‘\"]{2,}[''’‘\"]"
_NAMES = r"list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-záàéèêëùûü\s&]', ' ', 'g'), '\s+'), lambda w: w <> '')"
_UNIT = r"(?i)^([0-9]+(?:\.[0-9]{2})?)\s+per\s+(glass|bottle)$"
_TOKENS = rf"""t0 AS (SELECT page_id, pos AS line_pos, starts_with(line, '{html.HEADING}') AS heading, trim(regexp_replace(line, '^{html.HEADING}', '')) AS text FROM v),
  t1 AS (SELECT *, len({_NAMES}) BETWEEN 1 AND 5 AND len(list_filter({_NAMES}, lambda w: NOT list_contains({_list(sorted({*ITEM_SECTIONS, *OTHER_SECTIONS, *SECTION_FILLERS}))}, w))) = 0 AS named_section, len({M._WORDS.format('text')}) AS n_words,
    regexp_matches(text, '{L._YEAR}') OR regexp_matches(text, '[''’‘`][0-9]{{2}}\b') OR regexp_matches(text, '{_LABEL}') OR regexp_matches(text, '\s+-\s+') OR contains(text, ',') AS signal,
    CASE WHEN regexp_matches(text, '{L._TWO}') THEN trim(regexp_extract(text, '{L._TWO}', 1)) ELSE trim(regexp_extract(text, '{L._ONE}', 1)) END AS t_name, CASE WHEN regexp_matches(text, '{L._TWO}') THEN trim(regexp_extract(text, '{L._TWO}', 2)) ELSE trim(regexp_extract(text, '{L._ONE}', 2)) END AS t_blob FROM t0 WHERE text <> ''),
  t2 AS (SELECT *, {_raw_price('t_blob')} AS t_price, {_raw_price('text')} AS whole FROM t1),
  t3 AS (SELECT page_id, line_pos, CASE WHEN heading AND NOT signal AND (named_section OR n_words <= 4) THEN [{{'type': 'section', 'text': text}}] WHEN NOT heading AND regexp_matches(text, '^(glass|bottle)\s*\$\s*$') THEN []
      WHEN NOT heading AND regexp_matches(text, '{_UNIT}') THEN CASE WHEN lower(regexp_extract(text, '{_UNIT}', 2)) = 'bottle' THEN list_filter([{{'type': 'price', 'text': {_raw_price(f"regexp_extract(text, '{_UNIT}', 1)")}}}], lambda x: x.text IS NOT NULL) ELSE [] END
      WHEN regexp_matches(t_name, '[A-Za-z]') AND NOT regexp_matches(t_blob, '^(19|20)[0-9]{{2}}$') AND t_price IS NOT NULL THEN [{{'type': 'text', 'text': t_name}}, {{'type': 'price', 'text': t_price}}]
      WHEN NOT heading AND whole IS NOT NULL THEN [{{'type': 'price', 'text': whole}}] WHEN NOT heading AND named_section THEN [{{'type': 'section', 'text': text}}] ELSE [{{'type': 'text', 'text': text}}] END AS made FROM t2),
  tokens AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY line_pos, i) - 1 AS pos, made[i].type AS type, made[i].text AS text FROM t3, unnest(range(1, len(made) + 1)) AS u(i))"""


@query("page_tokens", f"WITH {_lines_sql(_PAGES)}, {_TOKENS} SELECT page_id, pos, type, text FROM tokens")
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections, prices and texts of pages in order."""
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.leaf_tokens(F.col("html"))).alias("pos", "token")).select("page_id", "pos", "token.*")


# a line of a menu as a list entry, a paragraph or a heading, and prices and separators between
_ENTRY = f"""CASE WHEN p_partkey % 9 = 4 THEN concat('<h3>', CASE p_partkey % 4 WHEN 0 THEN 'Red wines' WHEN 1 THEN 'Cocktails' WHEN 2 THEN {M.LINE} ELSE 'White' END, '</h3>') WHEN p_partkey % 9 = 6 THEN concat('<p>', CAST(p_size AS STRING), CASE p_partkey % 5 WHEN 0 THEN ' per bottle' WHEN 1 THEN ' per glass' WHEN 2 THEN ' EUR' WHEN 3 THEN ' / ' ELSE '' END, '</p>')
  WHEN p_partkey % 9 = 7 THEN concat('<span>', CASE p_partkey % 3 WHEN 0 THEN '/' WHEN 1 THEN concat('$', CAST(p_size * 3 AS STRING)) ELSE concat(CAST(p_size AS STRING), ' - ', CAST(p_size * 2 AS STRING)) END, '</span>') WHEN p_partkey % 9 = 8 THEN concat('<li>', p_name, ' ', p_brand, '<br>', {M.LINE}, '</li>') ELSE concat('<li>', {M.LINE}, '</li>') END"""


def written_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, html: each eleven parts make a page."""
    p = table(spark, sf_dir, "part").select(F.expr("p_partkey div 11").alias("page_id"), F.col("p_size").cast("long").alias("s"), F.col("p_partkey").alias("p"), F.expr(_ENTRY).alias("entry"))
    told = p.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("s", "p", "entry"))).alias("l"))
    return told.select("page_id", F.concat(F.lit("<html><body>"), F.array_join(F.transform("l", lambda x: x["entry"]), ""), F.lit("</body></html>")).alias("html"))


_WRITTEN = f"src AS (SELECT p_partkey // 11 AS page_id, '<html><body>' || string_agg({_ENTRY}, '' ORDER BY p_size, p_partkey) || '</body></html>' AS html FROM part GROUP BY ALL)"


def _plain(x: str) -> str:
    return L._squeezed(rf"regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g')")


def _no_item(x: str, serving: str, plain: str) -> str:
    return rf"(regexp_matches(trim({x}), '^[A-Za-z]\s*/\s*[A-Za-z]$') OR {serving} OR regexp_matches({plain}, '\bipa\b') OR {plain} = '' OR length({plain}) > 200 OR len(list_filter({_list(L.NOT_AN_ITEM)}, lambda h: contains({plain}, h))) > 0)"


def _foreign(x: str) -> str:
    return rf"coalesce(len(list_filter(regexp_split_to_array(regexp_replace(lower({x}), '[^a-z\s]', ' ', 'g'), '\s+'), lambda w: list_contains({_list(OTHER_SECTIONS)}, w))) > 0, false)"


def _structure(x: str) -> str:
    return f"(contains({x}, '|') OR regexp_matches({x}, '{L._YEAR}') OR regexp_matches({x}, '{_LABEL}'))"


def _serving(x: str) -> str:
    said = f"list_filter(string_split(lower({L._quality(x)}), ' '), lambda t: t <> '')"
    other = rf"list_filter({said}, lambda t: NOT list_contains({_list(L.SERVING)}, t) AND NOT regexp_matches(t, '^[0-9]{{1,3}}(\.[0-9]{{2}})?$'))"
    return rf"(NOT (regexp_matches({x}, '[‘''“\"]') OR regexp_matches({x}, '{L._YEAR}') OR regexp_matches({x}, '\s+-\s+')) AND list_has_any({said}, {_list(L.SERVING)}) AND len({other}) <= 1)"


_JOINED = r"regexp_replace(trim(array_to_string(b.names, ' ')), '\s*\|\s*', ', ', 'g')"


def _flush(price: str) -> str:
    """The items with the gathered name, unless it or its section is about something else."""
    kept = f"joined = '' OR {_no_item('joined', _serving('joined'), _plain('joined'))} OR {_foreign('section')}"
    return f"CASE WHEN len(names) = 0 OR {kept} THEN items ELSE list_append(items, {{'name': joined, 'price': {price}, 'section': section}}) END"


_DIGITS = r"coalesce(TRY_CAST(regexp_replace({0}, '[^0-9]', '', 'g') AS BIGINT), 0)"
#: What a token does: see the cases of ``html.page_items``.
_ACT = rf"""CASE WHEN type = 'section' THEN 'section' WHEN type = 'price' THEN CASE WHEN len(names) > 0 THEN CASE WHEN pending IS NOT NULL THEN 'close' ELSE 'priced' END WHEN just AND slash THEN 'raise' WHEN just THEN 'skip' ELSE 'wait' END
  WHEN other THEN CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'break' ELSE 'mark' END WHEN len(names) > 0 AND ((NOT slash AND title) OR list_contains(names, text)) THEN 'anew' WHEN len(names) > 0 AND NOT slash AND NOT marked AND {_structure("array_to_string(names, ' ')")} THEN 'skip' ELSE 'gather' END"""
_ITEMS = rf"""l AS (SELECT page_id AS doc, pos, pos + 1 AS n, type, text AS line FROM tokens), {M._FACTS},
  told AS (SELECT doc, n, type, line AS text, type = 'text' AND {_no_item('line', 'serving', 'plain')} AS other, type = 'text' AND starts AS starting, {_structure('line')} AS marked FROM step),
  walk AS (SELECT doc, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(name VARCHAR, price VARCHAR, section VARCHAR)[]) AS items, CAST([] AS VARCHAR[]) AS names, CAST(NULL AS VARCHAR) AS pending, CAST(NULL AS VARCHAR) AS section, false AS just, false AS slash FROM (SELECT DISTINCT doc FROM l)
    UNION ALL SELECT doc, n, CASE WHEN act IN ('section', 'break', 'anew') THEN {_flush('pending')} WHEN act IN ('close', 'priced') THEN {_flush('coalesce(pending, text)')} WHEN act = 'raise' AND len(items) > 0 AND {_DIGITS.format('text')} > {_DIGITS.format('items[-1].price')} THEN list_append(items[1:len(items) - 1], {{'name': items[-1].name, 'price': text, 'section': items[-1].section}}) ELSE items END,
      CASE WHEN act IN ('section', 'break', 'close', 'priced') THEN [] WHEN act = 'anew' THEN [text] WHEN act = 'gather' THEN list_append(names, text) ELSE names END, CASE WHEN act IN ('section', 'break', 'anew', 'priced') THEN NULL WHEN act IN ('close', 'wait') THEN text ELSE pending END, CASE WHEN act = 'section' THEN text ELSE section END,
      CASE WHEN act IN ('section', 'break', 'anew', 'gather', 'close') THEN false WHEN act = 'priced' THEN true ELSE just END, CASE WHEN act IN ('section', 'break', 'anew', 'gather', 'raise') THEN false WHEN act = 'mark' THEN slash OR contains(text, '/') ELSE slash END
      FROM (SELECT *, {_ACT} AS act FROM (SELECT b.doc, t.n, b.items, b.names, b.pending, b.section, b.just, b.slash, t.type, t.text, t.other, t.starting AND NOT t.other AS title, t.marked, {_JOINED} AS joined FROM walk b JOIN told t ON t.doc = b.doc AND t.n = b.n + 1))),
  ended AS (SELECT doc, {_flush('pending')} AS items FROM (SELECT b.*, {_JOINED} AS joined FROM walk b QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC) = 1)),
  item AS (SELECT doc, i, items[i].name AS name, items[i].price AS price, items[i].section AS section FROM ended, unnest(range(1, len(items) + 1)) AS u(i)),
  kept AS (SELECT * FROM item QUALIFY row_number() OVER (PARTITION BY doc, {L._squeezed('lower(name)')}, coalesce(price, '') ORDER BY i DESC) = 1)"""


@query("page_items", f"""WITH RECURSIVE {_lines_sql(_WRITTEN)}, {_TOKENS}, {_ITEMS}
  SELECT doc AS page_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS INTEGER) AS pos, name, price, section FROM kept""")
def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of pages that are written from the parts."""
    return html.page_items(written_pages(spark, sf_dir)).select("page_id", "pos", "name", "price", "section")


_A, _B = "CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING)", "CAST(p_size AS STRING)"
_AMOUNT = f"CASE p_partkey % 12 WHEN 0 THEN concat('$', {_A}) WHEN 1 THEN concat({_B}, ' / $', {_A}) WHEN 2 THEN concat({_A}, '-', {_B}) WHEN 3 THEN concat('€ ', {_A}) WHEN 4 THEN concat({_A}, ' eur') WHEN 5 THEN {_B} WHEN 6 THEN concat('kr ', {_A}, '.50') WHEN 7 THEN concat({_A}, ',', lpad({_B}, 3, '0'), ' £') WHEN 8 THEN concat('$', {_B}, '.75') WHEN 9 THEN concat({_A}, ' – ', {_B}, '.00') WHEN 10 THEN concat('CHF ', {_B}) ELSE concat('about ', {_A}) END"


@query("price_parse", f"SELECT p_partkey, {_raw_price('t')} AS price FROM (SELECT p_partkey, trim({_AMOUNT}) AS t FROM part)")
def price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", prices.raw_price(F.expr(_AMOUNT)).alias("price"))
