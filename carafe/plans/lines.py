"""Queries over menu lines written from the parts, in all shapes that the line functions tell apart, with SQL that states each rule again.

One expression, which both engines read, writes the lines; a third of the shapes hold what a rule looks for, the others what it must not take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, identity, prices, quality, rows, text, tokens
from ..functions.lexicon import COLOURS, GEOGRAPHY, MORE_REGIONS, NOT_AN_ITEM, REGIONS, SERVING, VARIETALS
from .queries import query, spread, table

_N, _Y, _W = "CAST(p_size AS STRING)", "CAST(1990 + p_partkey % 35 AS STRING)", "split_part(p_name, ' ', 1)"
_SHAPES = [
    f"concat('Chateau ', p_name, ' ', {_Y}, ' ', {_N})",
    f"concat('Chateau ', p_name, ' / ', {_N})",
    f"concat(p_name, ' ', {_N}, '/', CAST(p_size * 3 AS STRING))",
    f"concat(p_name, ': ', {_N}, ' / NA / $', CAST(p_size * 2 AS STRING))",
    f"concat('$', {_N})",
    _N,
    f"concat({_N}, ' / ', CAST(p_size * 4 AS STRING))",
    "'Glass 12 / Bottle 48'",
    f"concat('glass bottle ', {_W})",
    "'G / B'",
    "'Napa Valley, California'",
    "'Sonoma, CA'",
    "'Pinot Noir'",
    "'Syrah/Grenache'",
    f"concat('Ridge ', {_W}, ' Pinot Noir')",
    "concat('Riesling with notes of ', p_name)",
    f"concat('Pinot Noir ', {_W}, ' aromas of ', p_name)",
    f"concat('NV Brut ', {_W})",
    f"concat('Le ', '‘', {_W}, '’', ' Blanc ', {_N}, '.50')",
    f"concat({_W}, ' ', chr(39), lpad({_N}, 2, '0'), ' red')",
    "concat('draft beer ', p_name)",
    "''",
    f"concat('White - Burgundy, France ', {_W})",
    f"concat('  ', p_name, '   ', {_Y}, ' $', {_N}, '.50 ')",
    f"concat('Rosé de ', {_W}, ' éclat ', p_name)",
    f"concat('* ', p_name, ' | ', {_W}, ' **')",
    "concat(p_name, ', ', p_name)",
    "concat('Tradicién Rhone ', p_name)",
    f"concat('Cabernet Sauvignon, ', {_W}, ', Italy, red')",
    f"concat({_Y}, ' Oregon & ', {_W})",
    f"concat(p_name, ' EUR ', {_N}, ' - 12')",
    "'Red wines by the glass'",
    "'WHITE & Rosé 2'",
    "concat(p_type, ' IPA')",
    f"concat({_W}, ' @', {_W}, ' ', {_Y}, 'x')",
    f"concat({_W}, ' Shiraz, ', {_W}, ' garnacha reserva napa 750ml')",
    f"concat({_N}, 'l 2019 wine of the ', p_name)",
    f"concat('0 ', {_W}, ' 2010, 111 ', p_name, ', 12, 12, 2012')",
]
LINE = f"CASE p_partkey % {len(_SHAPES)} " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SHAPES)) + " END"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def menu_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name", "p_type"), "p_partkey").select("*", F.expr(LINE).alias("line"))


_LINES = f"l AS (SELECT p_partkey, p_size, p_name, p_type, {LINE} AS line FROM part)"
_YEAR = r"\b(?:19|20)[0-9]{2}\b"
_QUOTED = "[‘''“\"][^’''\"”]+[’''\"”]"


def _squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def _quality(x: str) -> str:
    return _squeezed(rf"regexp_replace(regexp_replace(strip_accents({x}), '[‘’''“”\"]', ' ', 'g'), '[^A-Za-z0-9\s,.:/&+-]', ' ', 'g')")


def _dollars(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN '$' || CAST(CAST({x} AS BIGINT) AS VARCHAR) WHEN {x} IS NOT NULL THEN '$' || printf('%.2f', {x}) END"


def _likely(x: str) -> str:
    bare = rf"regexp_replace(trim({x}), '^\$', '')"
    return rf"(regexp_matches({bare}, '^[0-9]{{1,3}}(\.[0-9]{{2}})?$') AND coalesce(TRY_CAST({bare} AS DOUBLE) BETWEEN 5 AND 400, false))"


def _largest(x: str) -> str:
    return rf"list_max(list_transform(regexp_split_to_array({x}, '\s*/\s*'), lambda a: TRY_CAST(regexp_replace(trim(a), '^\$', '') AS DOUBLE)))"


_INLINE = r"^(.*?)(?:\s*/\s*([0-9]{1,2})(?:\.[0-9]{2})?(?:\.\s*[0-9]+)?\.?(?:\s+[A-Za-z0-9]+)?)\s*$"
_BARE = r"^(.*\S)\s+(\$?[0-9]{1,3}(?:\.[0-9]{2})?)\s*$"
_MENU = r"(?i)^(.*?)(?::\s*|\s+)((?:NA|\$?[0-9]+(?:\.[0-9]{2})?)(?:\s*/\s*(?:NA|\$?[0-9]+(?:\.[0-9]{2})?)){1,2})\s*$"
_TWO, _ONE = r"^(.*\S)\s+(\$?[0-9]+\s*[/–\-]\s*\$?[0-9]+)$", r"^(.*\S)\s+(\$?[0-9]+(?:\.[0-9]{2})?)$"
_REGION = r"^(.*\S)\s+([0-9]+(?:\s*/\s*[0-9]+)?)$"
_UNMARKED = r"trim(regexp_replace({0}, '\s*[*†‡§¶#]+\s*$', ''))"
_PRICED = rf"""p AS (SELECT *, CASE WHEN regexp_matches(line, '{_INLINE}') THEN trim(regexp_extract(line, '{_INLINE}', 1)) WHEN regexp_matches(line, '{_BARE}') AND {_likely(f"regexp_extract(line, '{_BARE}', 2)")} THEN trim(regexp_extract(line, '{_BARE}', 1)) ELSE trim(line) END AS title,
    CASE WHEN regexp_matches(line, '{_INLINE}') THEN TRY_CAST(regexp_extract(line, '{_INLINE}', 2) AS DOUBLE) WHEN regexp_matches(line, '{_BARE}') AND {_likely(f"regexp_extract(line, '{_BARE}', 2)")} THEN TRY_CAST(regexp_replace(regexp_extract(line, '{_BARE}', 2), '^\$', '') AS DOUBLE) END AS amount,
    regexp_replace(trim(regexp_extract(line, '{_MENU}', 1)), '[:\s]+$', '') AS m_title, regexp_extract(line, '{_MENU}', 2) AS blob FROM l),
  m AS (SELECT *, regexp_matches(line, '{_MENU}') AND regexp_matches(m_title, '[A-Za-z]') AND len(list_filter(regexp_split_to_array(blob, '\s*/\s*'), lambda t: regexp_matches(trim(t), '^(19|20)[0-9]{{2}}$'))) = 0 AS fits FROM p)"""


@query("line_prices", rf"""WITH {_LINES}, {_PRICED},
  t AS (SELECT *, CASE WHEN regexp_matches(line, '{_TWO}') THEN trim(regexp_extract(line, '{_TWO}', 1)) ELSE trim(regexp_extract(line, '{_ONE}', 1)) END AS t_name, CASE WHEN regexp_matches(line, '{_TWO}') THEN trim(regexp_extract(line, '{_TWO}', 2)) ELSE trim(regexp_extract(line, '{_ONE}', 2)) END AS t_blob, {_UNMARKED.format('line')} AS clean FROM m),
  n AS (SELECT *, list_transform(regexp_extract_all(t_blob, '[0-9]+(?:\.[0-9]+)?'), lambda x: CAST(CAST(x AS DOUBLE) AS BIGINT)) AS numbers FROM t),
  r AS (SELECT *, CASE WHEN regexp_matches(t_blob, '^\$[0-9]+(\.[0-9]{{2}})?$') THEN t_blob WHEN len(numbers) = 2 THEN '$' || list_max(numbers) WHEN CAST(nullif(regexp_extract(t_blob, '^[0-9]+'), '') AS BIGINT) BETWEEN 5 AND 2000 THEN '$' || regexp_extract(t_blob, '^[0-9]+') END AS t_price, regexp_extract(clean, '{_REGION}', 2) AS r_blob FROM n),
  a AS (SELECT *, regexp_matches(t_name, '[A-Za-z]') AND NOT regexp_matches(t_blob, '^(19|20)[0-9]{{2}}$') AND t_price IS NOT NULL AS ends_priced, CASE WHEN r_blob LIKE '%/%' THEN {_largest('r_blob')} WHEN TRY_CAST(r_blob AS DOUBLE) BETWEEN 5 AND 2000 THEN TRY_CAST(r_blob AS DOUBLE) END AS r_amount FROM r)
  SELECT p_partkey, regexp_matches(line, '^\$?[0-9]+(\.[0-9]{{2}})?(\s*/\s*\$?[0-9]+(\.[0-9]{{2}})?){{1,2}}$') OR regexp_matches(line, '^\$[0-9]+(\.[0-9]{{2}})?$') OR {_likely('line')} AS price_line, {_likely('line')} AS likely, {_likely("regexp_extract(line, '([0-9]{1,3}(?:[.][0-9]{2})?)[ ]*$', 1)")} AS ends,
    title, {_dollars('amount')} AS price, CASE WHEN fits THEN m_title END AS menu_title, CASE WHEN fits THEN {_dollars(_largest('blob'))} END AS menu_price,
    CASE WHEN ends_priced THEN t_name END AS trailing_name, CASE WHEN ends_priced THEN t_price END AS trailing_price,
    CASE WHEN regexp_matches(clean, '{_REGION}') AND NOT regexp_matches(r_blob, '^(19|20)[0-9]{{2}}$') AND r_amount IS NOT NULL THEN trim(regexp_extract(clean, '{_REGION}', 1)) END AS region,
    CASE WHEN regexp_matches(clean, '{_REGION}') AND NOT regexp_matches(r_blob, '^(19|20)[0-9]{{2}}$') THEN {_dollars('r_amount')} END AS region_price,
    CASE WHEN regexp_matches(line, '{_YEAR}') THEN CAST(regexp_extract(line, '{_YEAR}') AS INTEGER) WHEN regexp_matches(line, '[''’‘`][0-9]{{2}}\b') THEN CAST(regexp_extract(line, '[''’‘`]([0-9]{{2}})\b', 1) AS INTEGER) + CASE WHEN CAST(regexp_extract(line, '[''’‘`]([0-9]{{2}})\b', 1) AS INTEGER) <= 26 THEN 2000 ELSE 1900 END END AS vintage FROM a""")
def line_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("line")
    got = menu_lines(spark, sf_dir).select("p_partkey", prices.is_price_line(x).alias("price_line"), prices.likely_price(x).alias("likely"), prices.ends_with_price(x).alias("ends"), prices.inline_price(x).alias("i"), prices.menu_price(x).alias("m"), prices.trailing_price(x).alias("t"), prices.region_price(x).alias("r"), prices.vintage(x, 2025).alias("vintage"))
    return got.select("p_partkey", "price_line", "likely", "ends", "i.title", "i.price", F.col("m.title").alias("menu_title"), F.col("m.price").alias("menu_price"), F.col("t.name").alias("trailing_name"), F.col("t.price").alias("trailing_price"), "r.region", F.col("r.price").alias("region_price"), "vintage")


def _without_repeats(x: str) -> str:
    """A phrase said twice, once; ``x`` is a column."""
    lengths = rf"list_filter(range(1, length({x})), lambda n: 2 * n < length({x}) AND lower(right({x}, n)) = lower(left({x}, n)) AND regexp_full_match(substr({x}, n + 1, length({x}) - 2 * n), '\s*[,;/]\s*|\s+'))"
    parts = rf"list_filter(list_transform(regexp_split_to_array({x}, '\s*,\s*'), lambda p: trim(p)), lambda p: p <> '')"
    return f"CASE WHEN len({lengths}) > 0 THEN trim(left({x}, {lengths}[1])) WHEN len({parts}) < 2 THEN {x} ELSE array_to_string(list_filter({parts}, lambda p, i: i = 1 OR lower(p) <> lower({parts}[i - 1])), ', ') END"


_CORRECTED = r"regexp_replace(replace(replace({0}, 'Tradicién', 'Tradición'), 'Vino de' || chr(125) || ' Volta', 'Vino del Volta'), '\bRhone\b', 'Rhône', 'g')"
_ROW_FACTS = rf"""{_PRICED},
  q AS (SELECT *, {_quality('line')} AS quality, {_squeezed(r"regexp_replace(lower(line), '[^a-z0-9\s]', ' ', 'g')")} AS plain, {_squeezed("regexp_replace(" + _CORRECTED.format(_UNMARKED.format('line')) + ", '>+', ' ', 'g')")} AS tidy FROM m),
  s AS (SELECT *, list_filter(string_split(lower(quality), ' '), lambda t: t <> '') AS words, list_filter(regexp_split_to_array({_squeezed(r"regexp_replace(lower(strip_accents(line)), '[^a-z0-9\s]', ' ', 'g')")}, '\s+'), lambda t: t <> '') AS folded, regexp_matches(tidy, '(?i)^(chilled\s+red|red|white|orange|sparkling|rose|rosé)\s*[-—:]\s*.*[A-Za-z]') AS styled FROM q),
  f AS (SELECT *, NOT (regexp_matches(line, '[‘''“"]') OR regexp_matches(line, '{_YEAR}') OR regexp_matches(line, '\s+-\s+')) AND list_has_any(words, {_list(SERVING)}) AND len(list_filter(words, lambda t: NOT list_contains({_list(SERVING)}, t) AND NOT regexp_matches(t, '^[0-9]{{1,3}}(\.[0-9]{{2}})?$'))) <= 1 AND NOT styled AS serving, len(list_filter({_list(VARIETALS)}, lambda v: contains(lower(line), v))) > 0 AS varietal FROM s)"""
_SAID = rf"(?i)\b(?:{'|'.join(VARIETALS)})\b(?:\s+(?:with|showing|offering)\b|.*\b(?:notes?|aromas?|flavou?rs?) of\b)"


@query("line_tests", rf"""WITH {_LINES}, {_ROW_FACTS}
  SELECT p_partkey, serving, regexp_matches(trim(line), '^[A-Za-z]\s*/\s*[A-Za-z]$') OR serving OR plain = '' OR regexp_matches(plain, '\bipa\b') OR length(plain) > 200 OR len(list_filter({_list(NOT_AN_ITEM)}, lambda h: contains(plain, h))) > 0 AS no_item,
    regexp_matches(line, ',\s*[A-Z]{{2}}$') AS state, len(regexp_split_to_array(lower(line), '\s*,\s*')) >= 2 AND len(list_filter(regexp_split_to_array(lower(line), '\s*,\s*'), lambda p: NOT list_contains({_list(REGIONS + GEOGRAPHY + MORE_REGIONS)}, p))) = 0 AND list_contains({_list(GEOGRAPHY)}, regexp_split_to_array(lower(line), '\s*,\s*')[-1]) AS region_only,
    regexp_matches(trim(line), '^[A-Z][A-Za-zÀ-ÿ]+(/[A-Z][A-Za-zÀ-ÿ]+)+$') OR (regexp_matches(trim(line), '^[A-Za-zÀ-ÿ]+$') AND varietal) AS fragment,
    len(list_filter({_list(VARIETALS)}, lambda v: regexp_matches(line, '(?i)\b' || v || '$') AND regexp_matches(strip_accents(left(line, length(line) - length(v))), '[A-Za-z]'))) > 0 AS named,
    regexp_matches(line, '{_SAID}') AND NOT regexp_matches(line, '{_YEAR}') AND NOT regexp_matches(line, '{_QUOTED}') AS described,
    regexp_matches(line, '{_YEAR}') OR regexp_matches(line, '(?i)^(NV|N\.V\.)\s') OR regexp_matches(line, '{_QUOTED}') OR varietal OR amount IS NOT NULL OR fits AS identified,
    CASE WHEN len(list_filter(folded, lambda w: list_contains({_list(text.SECTION_WORDS)}, w))) > 0 AND len(list_filter(folded, lambda w: NOT list_contains({_list(text.SECTION_WORDS + text.SECTION_CONTEXT)}, w) AND NOT regexp_matches(w, '^[0-9]+$'))) = 0 THEN list_filter(folded, lambda w: list_contains({_list(text.SECTION_WORDS)}, w))[1] END AS header,
    CASE WHEN styled THEN lower(trim(regexp_extract(tidy, '(?i)^(chilled\s+red|red|white|orange|sparkling|rose|rosé)\s*[-—:]', 1))) END AS style FROM f""")
def line_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("line")
    return menu_lines(spark, sf_dir).select(
        "p_partkey", rows.is_serving_line(x).alias("serving"), rows.is_no_item(x).alias("no_item"), rows.ends_in_state(x).alias("state"), rows.is_region_only(x).alias("region_only"), rows.is_varietal_fragment(x).alias("fragment"),
        rows.names_varietal(x).alias("named"), rows.describes_varietal(x).alias("described"), rows.has_identity(x).alias("identified"), text.section_header(x).alias("header"), rows.style_region(x)["style"].alias("style"),
    )


_TAIL = rf"(?i)^(.*?\b(?:{'|'.join(GEOGRAPHY)})\b)"


@query("line_texts", rf"""WITH {_LINES},
  c AS (SELECT *, {_CORRECTED.format('line')} AS right, {_squeezed("regexp_replace(line, '>+', ' ', 'g')")} AS once, {_quality('line')} AS quality, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(line)), '[_\s]+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM l),
  u AS (SELECT *, {_squeezed("regexp_replace(" + _UNMARKED.format('"right"') + ", '>+', ' ', 'g')")} AS unmarked FROM c),
  k AS (SELECT *, {_without_repeats('unmarked')} AS said FROM u),
  r AS (SELECT *, {_squeezed('said')} AS region FROM k)
  SELECT p_partkey, {_squeezed(r"regexp_replace(lower(strip_accents(line)), '[^a-z0-9\s]', ' ', 'g')")} AS field, ' ' || trim(regexp_replace(lower(strip_accents(line)), '[^a-z0-9]+', ' ', 'g')) || ' ' AS style_text, quality,
    replace(regexp_replace(lower(strip_accents(line)), '[‘’''`´"“”«»]', ' ', 'g'), '&', ' and ') AS identity_text, array_to_string(list_filter(string_split(lower(quality), ' '), lambda w: regexp_matches(w, '[a-z]')), ' ') AS alpha,
    {_UNMARKED.format('line')} AS unmarked, "right" AS corrected, {_without_repeats('once')} AS without_repeats, trim(regexp_replace(CASE WHEN regexp_matches(region, '{_TAIL}') THEN trim(regexp_extract(region, '{_TAIL}', 1)) ELSE region END, '[,:;/-]+$', '')) AS region,
    regexp_replace(line, '[^a-zA-Z0-9.\-_]', '_', 'g') AS file, {_squeezed('line')} AS shown, trim(regexp_replace(lower(strip_accents(line)), '[^\pL\pN]+', ' ', 'g')) AS compared, CASE WHEN slug = '' THEN 'other' ELSE slug END AS slug,
    strip_accents(line) AS folded, list_filter({_list(VARIETALS)}, lambda v: contains(lower(line), v))[1] AS varietal, list_filter({_list(COLOURS)}, lambda v: contains(lower(line), v))[1] AS colour FROM r""")
def line_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("line")
    return menu_lines(spark, sf_dir).select(
        "p_partkey", text.normal_field(x).alias("field"), text.style_text(x).alias("style_text"), text.quality_text(x).alias("quality"), text.identity_text(x).alias("identity_text"), F.array_join(text.alpha_tokens(x), " ").alias("alpha"),
        text.without_markers(x).alias("unmarked"), text.corrected(x).alias("corrected"), text.without_repeats(x).alias("without_repeats"), rows.clean_region(x).alias("region"), text.safe_filename(x).alias("file"), display.shown(x).alias("shown"),
        display.compared(x).alias("compared"), display.group_key(x).alias("slug"), text.fold_accents(x).alias("folded"), text.first_hint(x, VARIETALS).alias("varietal"), text.first_hint(x, COLOURS).alias("colour"),
    )


_FIELD = _squeezed(r"regexp_replace(lower(strip_accents({0})), '[^a-z0-9\s]', ' ', 'g')")
_CORE_OUT = _list([*tokens.STOPWORDS, *tokens.COUNTRIES, *tokens.CONCEPTS, *tokens.VARIETAL_TOKENS])
_CONCEPT = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tokens.CONCEPTS.items()) + " END"
_SAME = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in identity.SYNONYMS.items()) + " ELSE t END"
_CORE = rf"list_filter(string_split({{0}}, ' '), lambda t: length(t) > 1 AND NOT list_contains({_CORE_OUT}, t) AND NOT regexp_matches(t, '^(19|20)[0-9]{{{{2}}}}$') AND NOT regexp_matches(t, '^[0-9]+(l|ml)$'))"
_IDENTITY_TEXT = "replace(regexp_replace(lower(strip_accents({0})), '[‘’''`´\"“”«»]', ' ', 'g'), '&', ' and ')"
_RAW_WORDS = f"regexp_extract_all({_IDENTITY_TEXT}, '[a-z0-9]+')"
_WORTH = rf"length(t) > 1 AND NOT list_contains({_list([*identity.STOP, *identity.NOISE, *identity.TASTING])}, t) AND NOT regexp_matches(t, '^[0-9]+(ml|cl|l|oz)?$')"
_GRAPES = "list_filter([" + ", ".join(rf"CASE WHEN regexp_matches({{0}}, '\b(?:{p})\b') THEN '{n}' END" for n, p in identity.GRAPE_PATTERNS.items()) + "], lambda g: g IS NOT NULL)"
_MARK = r"(?i)(?:^|[\s,(\[;])(?:n\.?\s*(?:/\s*)?v\.?|non[\s-]?vintage)(?:$|[\s,).\];])"


@query("line_words", rf"""WITH {_LINES}, w AS (SELECT *, {_FIELD.format('line')} AS a, {_FIELD.format('p_name')} AS b, {_IDENTITY_TEXT.format('line')} AS low, {_IDENTITY_TEXT.format("concat(p_name, ' merlot')")} AS low_hit FROM l),
  t AS (SELECT *, {_CORE.format('a')} AS core, {_CORE.format('b')} AS core_b, list_distinct(list_filter(string_split(a, ' '), lambda t: t <> '')) AS all_a, list_distinct(list_filter(string_split(b, ' '), lambda t: t <> '')) AS all_b, {_GRAPES.format('low')} AS grapes, {_GRAPES.format('low_hit')} AS hit_grapes FROM w),
  r AS (SELECT *, list_filter(core, lambda t: NOT list_contains(core_b, t)) AS rest FROM t)
  SELECT p_partkey, array_to_string(core, ' ') AS core, array_to_string(list_filter(list_transform({_RAW_WORDS.format('line')}, lambda t: {_SAME}), lambda t: {_WORTH}), ' ') AS identity_words,
    array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(a, ' '), lambda t: {_CONCEPT}), lambda c: c IS NOT NULL))), ' ') AS concepts,
    array_to_string(list_sort(list_distinct(list_concat(core, core_b))), ' ') AS pooled, CASE WHEN len(rest) > 0 AND len(all_b) > 0 THEN len(list_filter(rest, lambda t: list_contains(all_b, t))) / len(rest) ELSE 0.0e0 END AS recovered,
    CASE WHEN len(core) > 0 AND len(core_b) > 0 THEN len(list_filter(core, lambda t: list_contains(core_b, t))) / len(core) ELSE 0.0e0 END AS exact,
    CASE WHEN a = '' OR b = '' THEN 0.0e0 WHEN a = b THEN 1.0e0 WHEN contains(a, b) OR contains(b, a) THEN 0.8e0 ELSE len(list_intersect(all_a, all_b)) / len(list_distinct(list_concat(all_a, all_b))) END AS field_score,
    array_to_string(grapes, ' ') AS grapes, len(grapes) > 0 AND len(list_filter(hit_grapes, lambda g: NOT list_contains(grapes, g))) > 0 AS grape_conflict,
    array_to_string(list_filter(list_distinct(list_filter({_RAW_WORDS.format('line')}, lambda t: {_WORTH} AND NOT list_contains({_list([*identity.PLACES, *identity.CLASSES, *identity.PRODUCER_KINDS, *identity.GRAPES, "years"])}, t))), lambda t: true), ' ') = '' AS nothing_to_search,
    CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN CASE WHEN 2000 + p_size = 2000 + p_partkey % 50 THEN 'exact' ELSE 'conflict' END ELSE 'unknown' END WHEN regexp_matches(line, '{_MARK}') THEN CASE WHEN p_size % 2 = 0 THEN 'conflict' ELSE 'unknown' END ELSE 'unconstrained' END AS vintages FROM r""")
def line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, name = F.col("line"), F.col("p_name")
    core, core_b, named, hit = (F.col(c) for c in ("_core", "_core_b", "_named", "_hit"))  # read once a row, used several times
    year, hit_year = F.when(F.col("p_size") % 3 == 0, 2000 + F.col("p_size")), F.when(F.col("p_size") % 2 == 0, 2000 + F.col("p_partkey") % 50)
    joined = lambda a: F.array_join(a, " ")
    read = {"_core": tokens.identity_tokens(x), "_core_b": tokens.identity_tokens(name), "_named": identity.grapes(x), "_hit": identity.grapes(F.concat(name, F.lit(" merlot")))}
    return menu_lines(spark, sf_dir).withColumns(read).select(
        "p_partkey", joined(core).alias("core"), joined(identity.identity_words(x)).alias("identity_words"), joined(F.array_sort(tokens.concepts(x))).alias("concepts"), joined(F.array_sort(tokens.pool(core, core_b))).alias("pooled"),
        tokens.recovery(core, core_b, F.array_distinct(tokens.tokens(name))).alias("recovered"), tokens.exact_overlap(core, core_b).alias("exact"), tokens.field_score(x, name).alias("field_score"), joined(named).alias("grapes"),
        ((F.size(named) > 0) & (F.size(F.array_except(hit, named)) > 0)).alias("grape_conflict"), (F.size(identity.search_words(x)) == 0).alias("nothing_to_search"), identity.compare_vintages(year, x, hit_year, name).alias("vintages"),
    )


def _text_score(q: str, asked: str) -> str:
    """The quality of a text whose folded form is ``q`` and whose marks are looked up in ``asked``."""
    some = lambda test: f"len(list_filter(tokens, lambda t: {test}))"
    return rf"""(0.35e0 * len(regexp_extract_all({q}, '[A-Za-z]')) / greatest(1, length(replace({q}, ' ', '')))
    + CASE WHEN {some('length(t) >= 3')} >= 2 THEN 0.25e0 WHEN {some('length(t) >= 3')} = 1 THEN 0.12e0 ELSE 0 END + CASE WHEN {some('length(t) >= 5')} > 0 THEN 0.08e0 ELSE 0 END
    + CASE WHEN {some("regexp_matches(t, '[aeiouy]')")} >= least(2, len(tokens)) THEN 0.12e0 ELSE 0 END + CASE WHEN regexp_matches({asked}, '[‘’''“”"]') THEN 0.08e0 ELSE 0 END + CASE WHEN regexp_matches({asked}, ',| - |:') THEN 0.05e0 ELSE 0 END
    - least(0.14e0, 0.14e0 * {some('length(t) <= 2')} / len(tokens)) - least(0.14e0, 0.14e0 * {some("length(t) >= 2 AND len(list_distinct(string_split(t, ''))) = 1")} / len(tokens))
    - CASE WHEN {some("NOT regexp_matches(t, '[aeiouy]') AND length(t) <= 3")} > 0 AND {some("regexp_matches(t, '[aeiouy]')")} = 0 THEN 0.18e0 ELSE 0 END)"""


def _unit(x: str) -> str:
    return f"greatest(0.0e0, least(0.99e0, CAST(printf('%.2f', {x}) AS DOUBLE)))"


def _quality_sql(source: str, keys: str) -> str:
    any_of = lambda words: f"len(list_filter({_list(words)}, lambda h: contains(low, h))) > 0"
    return rf"""WITH {source}, q AS (SELECT *, {_quality("coalesce(line, '')")} AS q FROM l), t AS (SELECT *, lower(q) AS low, list_filter(string_split(lower(q), ' '), lambda w: regexp_matches(w, '[a-z]')) AS tokens FROM q),
  s AS (SELECT *, CASE WHEN len(tokens) > 0 THEN {_unit(_text_score('q', 'line'))} ELSE 0.0e0 END AS quality, CASE WHEN len(tokens) > 0 THEN {_unit(_text_score('q', 'low'))} ELSE 0.0e0 END AS plain FROM t)
  SELECT {keys}, quality, CASE WHEN low <> '' THEN {_unit(f"(plain * 0.8e0 + CASE WHEN contains(low, ',') THEN 0.05e0 ELSE 0 END + CASE WHEN {any_of(VARIETALS)} THEN 0.08e0 ELSE 0 END + CASE WHEN {any_of(REGIONS)} THEN 0.08e0 ELSE 0 END + CASE WHEN {any_of(COLOURS)} THEN 0.05e0 ELSE 0 END + CASE WHEN regexp_matches(low, '{_YEAR}') THEN 0.04e0 ELSE 0 END)")} ELSE 0.0e0 END AS notes_quality FROM s"""


def _qualities(df: DataFrame, key: str, of: str) -> DataFrame:
    return df.select(key, quality.qualities(F.col(of)).alias("q")).select(key, "q.quality", "q.notes_quality")


@query("line_quality", _quality_sql(_LINES, "p_partkey"))
def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qualities(menu_lines(spark, sf_dir), "p_partkey", "line")


@query("text_quality", _quality_sql("l AS (SELECT doc_id, coalesce(text, '') AS line FROM documents)", "doc_id"))
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _qualities(table(spark, sf_dir, "documents"), "doc_id", "text")
