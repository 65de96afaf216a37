"""Queries over the style dictionary and the catalogue lookup, with SQL that states the rules again.

Parts are both the dictionary (their names as aliases of two and three words) and the catalogue (brands as wineries; a third of its words are in an
eighth of the entries). Suppliers write the menu rows, each about one part. All texts are made by expressions that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity, style
from ..operators import matching, styles
from .lines import _IDENTITY_TEXT, _SAME, _list
from .queries import query, table

_ADJECTIVE, _NOUN = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
_TEXTS = {
    "own": f"CASE p_partkey % 12 WHEN 0 THEN concat(p_name, ' Pinot Noir') WHEN 1 THEN concat('Riesling red ', {_NOUN}) WHEN 2 THEN concat('Brut Rosé ', p_name) WHEN 3 THEN concat('Gin & ', {_NOUN}) WHEN 4 THEN concat(p_name, ' Grenache-Blanc, ', p_name) WHEN 5 THEN concat('Sparkling ', {_NOUN}, ' sake') WHEN 6 THEN concat({_NOUN}, ' white Merlot') WHEN 7 THEN concat({_NOUN}, ' BLANC') WHEN 8 THEN concat(p_name, ' rouge') WHEN 9 THEN concat({_NOUN}, ' ', {_ADJECTIVE}) WHEN 10 THEN concat('Extra Brut ', p_name, ' ', p_type) END",
    "varietal": "CASE p_partkey % 5 WHEN 0 THEN 'Syrah' WHEN 1 THEN 'a blush wine' END",
    "notes": "CASE p_partkey % 7 WHEN 0 THEN 'dry blackberry and sour cherry' WHEN 1 THEN 'served chilled' WHEN 2 THEN 'hints of Nebbiolo' END",
    "section": "CASE p_partkey % 3 WHEN 0 THEN 'Red wines' WHEN 1 THEN 'House pours' END",
    "color": "CASE p_partkey % 8 WHEN 0 THEN 'Champagne' WHEN 1 THEN 'rosé' WHEN 2 THEN 'Sparkling' WHEN 3 THEN 'orange' WHEN 4 THEN 'RED' WHEN 5 THEN 'white' END",
}
# by the length of a name: its style, and what a white or a red word makes of it
_NAMED = {"key": ["pinot_noir", "medium_white", "champagne", "nebbiolo"], "white": ["chardonnay", None, None, None], "red": [None, "light_red", None, None]}
_OF = {n: "CASE length(p_name) % 4 " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v) + " END" for n, values in _NAMED.items()}
_AFTER = len(style.ENTRIES)


def style_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small dictionary, and all names of parts, with and without their types."""
    p = table(spark, sf_dir, "part")
    names = p.select(F.expr("p_name").alias("alias"), "p_name", "p_partkey").unionByName(p.select(F.expr("concat(p_name, ' ', p_type)").alias("alias"), "p_name", "p_partkey"))
    named = names.groupBy("alias", "p_name").agg((F.min("p_partkey") + _AFTER).alias("place"))
    return styles.dictionary(spark).unionByName(named.select("alias", F.expr(_OF["key"]).alias("key"), F.lit(2).alias("tier"), F.expr(_OF["white"]).alias("white"), F.expr(_OF["red"]).alias("red"), "place"))


def _words(x: str) -> str:
    return f"string_split(trim(regexp_replace(lower(strip_accents({x})), '[^a-z0-9]+', ' ', 'g')), ' ')"


def _has(kinds: list[str]) -> str:
    return f"len(list_filter(taken, lambda t: t.tier = 9 AND list_contains({_list(kinds)}, t.key))) > 0"


_FIRST = "list_sort(list_transform(list_filter(taken, lambda t: {0}), lambda t: {{'tier': t.tier, 's': t.s, 'key': t.key, 'white': t.white, 'red': t.red}}))[1]"
_ENTRY_ROWS = ", ".join(f"('{a}', '{k}', {t}, {i})" for i, (a, k, t, _, _) in enumerate(style.ENTRIES))
_COLOUR_ROWS = ", ".join(f"('{w}', '{kind}')" for kind, words in (("rose", style.ROSE_WORDS), ("red", style.RED_WORDS), ("white", [w for w in style.WHITE_WORDS if w != "bianca"]), ("reds", ["reds"]), ("whites", ["whites"]), ("bianca", ["bianca"])) for w in words)
_STYLES_SQL = f"""e AS (SELECT alias, key, tier, NULL AS white, NULL AS red, place FROM (VALUES {_ENTRY_ROWS}) AS v(alias, key, tier, place)
    UNION ALL SELECT alias, {_OF['key']}, 2, {_OF['white']}, {_OF['red']}, min(p_partkey) + {_AFTER} FROM (SELECT p_name AS alias, p_name, p_partkey FROM part UNION ALL SELECT concat(p_name, ' ', p_type), p_name, p_partkey FROM part) GROUP BY alias, p_name),
  o AS (SELECT {_words('alias')} AS words, key, CASE WHEN tier = 2 AND list_contains({_list(style.SPARKLING)}, key) THEN 0 ELSE tier END AS tier, white, red, place, false AS colour FROM e QUALIFY row_number() OVER (PARTITION BY {_words('alias')} ORDER BY place) = 1
    UNION ALL SELECT [w], kind, 9, NULL, NULL, 0, true FROM (VALUES {_COLOUR_ROWS}) AS c(w, kind)),
  w AS (SELECT DISTINCT text, {_words('text')} AS words FROM texts WHERE text IS NOT NULL),
  h AS (SELECT text, i AS s, i + len(o.words) AS e, o.* FROM w, unnest(range(1, len(w.words) + 1)) AS u(i), o WHERE w.words[i] = o.words[1] AND w.words[i:i + len(o.words) - 1] = o.words),
  g AS (SELECT text, list_reduce(list([{{'colour': colour, 's': s, 'e': e, 'tier': tier, 'key': key, 'white': white, 'red': red}}] ORDER BY colour, length(array_to_string(words, ' ')) DESC, place, s), lambda a, x: CASE WHEN len(list_filter(a, lambda t: NOT t.colour AND t.s < x[1].e AND t.e > x[1].s)) > 0 THEN a ELSE list_concat(a, x) END) AS taken FROM h GROUP BY text),
  f AS (SELECT text, taken, {_FIRST.format('NOT t.colour')} AS best, {_FIRST.format(f"t.tier = 0 AND list_contains({_list(style.SPARKLING)}, t.key)")} AS sparkling, len(list_filter(taken, lambda t: NOT t.colour AND starts_with(t.key, 'sake'))) > 0 AS sake FROM g),
  styled AS (SELECT text, CASE WHEN best.key = 'default_sparkling' AND sake THEN 'sake_sparkling' WHEN best.key = 'rose_dry' AND sparkling.key IS NOT NULL THEN sparkling.key
      WHEN best.key IS NOT NULL AND {_has(['rose'])} AND list_contains({_list(style.RED_STYLES)}, best.key) THEN 'rose_dry' WHEN best.key IS NOT NULL AND {_has(['white', 'bianca'])} AND list_contains({_list(style.RED_STYLES)}, best.key) THEN coalesce(best.white, 'default_white')
      WHEN best.key IS NOT NULL AND {_has(['red'])} AND NOT list_contains({_list(style.RED_STYLES)}, best.key) AND best.red IS NOT NULL THEN best.red WHEN best.key IS NOT NULL THEN best.key
      WHEN {_has(['rose'])} THEN 'rose_dry' WHEN {_has(['red', 'reds'])} THEN 'default_red' WHEN {_has(['white', 'whites'])} THEN 'default_white' END AS key FROM f)"""
_VECTOR = "CASE key " + " ".join(f"WHEN '{k}' THEN {list(v)}" for k, v in style.VECTORS.items()) + " ELSE [3, 3, 3, 3] END"


@query("style_tastes", f"""WITH m AS (SELECT p_partkey, {', '.join(f'{e} AS {n}' for n, e in _TEXTS.items())} FROM part),
  texts AS (SELECT own AS text FROM m UNION SELECT varietal FROM m UNION SELECT notes FROM m UNION SELECT section FROM m), {_STYLES_SQL},
  k AS (SELECT p_partkey, notes, a.key AS own_key, coalesce(a.key, b.key, c.key) AS sure, d.key AS section_key, lower(strip_accents(color)) AS color, regexp_matches(' ' || array_to_string({_words('own')}, ' ') || ' ', ' ({'|'.join(style.OTHER_DRINKS)}) ') AND a.key IS NULL AS other
    FROM m LEFT JOIN styled a ON a.text = own LEFT JOIN styled b ON b.text = varietal LEFT JOIN styled c ON c.text = notes LEFT JOIN styled d ON d.text = section),
  s AS (SELECT p_partkey, notes, coalesce(NOT other AND sure IS NOT NULL, sure IS NOT NULL) AS specific, CASE WHEN other THEN 'default_unknown' ELSE coalesce(sure, section_key, CASE color WHEN 'champagne' THEN 'champagne' WHEN 'rose' THEN 'rose_dry' WHEN 'sparkling' THEN 'default_sparkling' WHEN 'orange' THEN 'orange_wine' WHEN 'red' THEN 'default_red' WHEN 'white' THEN 'default_white' ELSE 'default_unknown' END) END AS key FROM k),
  v AS (SELECT p_partkey, key, specific, {_VECTOR} AS v, coalesce(contains(notes, 'chilled'), false) AS cold, coalesce(contains(notes, 'blackberry'), false) AS berry, coalesce(contains(notes, 'sour cherry'), false) AS sour, coalesce(contains(notes, 'dry'), false) AS dry FROM s)
  SELECT p_partkey, key, specific, greatest(1, least(5, v[1] - CAST(cold AS INT) + CAST(berry AS INT))) AS body, greatest(1, least(5, v[2] + CAST(sour AS INT))) AS acidity, greatest(1, least(5, CASE WHEN cold THEN greatest(1, v[3] - 1) ELSE v[3] END + CAST(berry AS INT))) AS tannin,
    CASE WHEN dry THEN 1 ELSE v[4] END AS sweetness, CASE WHEN key = 'default_unknown' THEN 0.0e0 WHEN specific THEN 0.45e0 ELSE 0.35e0 END AS confidence FROM v""")
def style_tastes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of rows made from parts by a dictionary made from parts, and the taste that each suggests."""
    m = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(e).alias(n) for n, e in _TEXTS.items()])
    df = styles.with_style(m, "p_partkey", style_entries(spark, sf_dir), *[F.col(n) for n in _TEXTS])
    return df.select("p_partkey", "style.key", "style.specific", style.inferred_taste(F.col("style"), F.col("notes")).alias("taste")).select("p_partkey", "key", "specific", "taste.body", "taste.acidity", "taste.tannin", "taste.sweetness", "taste.confidence")


_DIGITS = "'0123456789', 'abcdefghij'"
_MAKER = f"concat(translate(regexp_extract(p_brand, '[0-9]+', 0), {_DIGITS}), 'hill')"
_NAME = f"concat(p_name, CASE WHEN p_partkey % 11 = 0 THEN concat(' ', translate(CAST(p_partkey AS STRING), {_DIGITS}), 'mark') WHEN p_size % 7 = 3 THEN ' merlot' ELSE '' END)"
_ENTRY = {"winery": f"concat('Domaine ', {_MAKER})", "name": _NAME, "region": "CASE WHEN p_partkey % 6 = 1 THEN p_name ELSE lower(p_type) END", "year": "2000 + p_size % 20", "retail_price": "p_retailprice"}
# whole name with its year, name alone, winery alone, without a vintage, another colour, a quoted cuvée, another grape
_ROW = {
    "raw_text": f"CASE s_suppkey % 7 WHEN 0 THEN concat('Domaine ', {_MAKER}, ' ', p_name, ' ', CAST(2000 + p_size % 20 AS STRING)) WHEN 1 THEN {_NAME} WHEN 2 THEN concat({_MAKER}, ' estate') WHEN 3 THEN concat({_MAKER}, ' ', p_name, ' NV') WHEN 4 THEN concat({_MAKER}, ' ', p_name, ' white') WHEN 5 THEN concat({_MAKER}, ' \"', {_NOUN}, '\" ', {_ADJECTIVE}) ELSE concat({_MAKER}, ' ', p_name, ' Syrah') END",
    "producer": f"CASE s_suppkey % 7 WHEN 0 THEN concat('Domaine ', {_MAKER}) WHEN 1 THEN NULL ELSE {_MAKER} END",
    "label": f"CASE s_suppkey % 7 WHEN 1 THEN {_NAME} WHEN 2 THEN NULL WHEN 4 THEN concat(p_name, ' white') WHEN 5 THEN concat('\"', {_NOUN}, '\" ', {_ADJECTIVE}) WHEN 6 THEN concat(p_name, ' Syrah') ELSE p_name END",
    "vintage": "CASE WHEN s_suppkey % 7 IN (0, 4) THEN 2000 + p_size % 20 END",
}
_I = identity


def _keep(x: str, test: str) -> str:
    return f"list_filter({x}, lambda t: {test})"


def _in(words: list[str], t: str = "t") -> str:
    return f"list_contains({_list(words)}, {t})"


def _identity(x: str, synonyms: bool = True) -> str:
    raw = f"regexp_extract_all({_IDENTITY_TEXT.format(f'coalesce({x}, {chr(39) * 2})')}, '[a-z0-9]+')"
    return _keep(f"list_transform({raw}, lambda t: {_SAME})" if synonyms else raw, rf"length(t) > 1 AND NOT {_in([*_I.STOP, *_I.NOISE, *_I.TASTING])} AND NOT regexp_matches(t, '^[0-9]+(ml|cl|l|oz)?$')")


def _worth_search(x: str) -> str:
    return _keep(_identity(x, False), f"NOT {_in([*_I.PLACES, *_I.CLASSES, *_I.PRODUCER_KINDS, 'years'])}")


def _once(x: str) -> str:
    """In order; ``x`` is a column."""
    return f"list_filter({x}, lambda y, i: list_position({x}, y) = i)"


def _same(a: str, b: str) -> str:
    slip = f"length({a}) >= 7 AND length({b}) >= 7 AND left({a}, 2) = left({b}, 2) AND levenshtein({a}, {b}) <= 1"
    begins = f"length({a}) >= 6 AND length({b}) >= 6 AND (starts_with({a}, {b}) OR starts_with({b}, {a}))"
    return f"({a} = {b} OR (NOT {_in(_I.GRAPES, a)} AND NOT {_in(_I.GRAPES, b)} AND (({slip}) OR ({begins}))))"


def _in_pool(pool: str, t: str = "t") -> str:
    return f"len(list_filter({pool}, lambda p: {_same('p', t)})) > 0"


def _weight(role: str, t: str = "t") -> str:
    first = f"WHEN {_in([*_I.PRODUCER_KINDS, *_I.PLACES], t)} THEN 0.15e0" if role == "producer" else f"WHEN {_in(_I.PRODUCER_KINDS, t)} THEN 0.2e0"
    return f"CASE {first} WHEN {_in(_I.CLASSES, t)} THEN 0.45e0 {f'WHEN {_in(_I.PLACES, t)} THEN 0.1e0' if role == 'candidate' else ''} ELSE 1.0e0 END"


def _covered(mine: str, pool: str, role: str) -> str:
    total = f"list_sum(list_transform({_once(mine)}, lambda t: {_weight(role)}))"
    found = f"list_sum(list_transform({_once(mine)}, lambda t: CASE WHEN {_in_pool(pool)} THEN {_weight(role)} ELSE 0.0e0 END))"
    return f"CASE WHEN coalesce({total}, 0) > 0 THEN {found} / {total} ELSE 0.0e0 END"


_MAIN = f"{_in(_I.GRAPES)} AND NOT {_in(_I.GRAPE_PARTS)}"
_TALLY = lambda test: f"len(list_filter(n, lambda t: {test}))"
_SUM = lambda test: f"coalesce(list_sum(list_transform(list_filter(n, lambda t: {test}), lambda t: t.v)), 0.0e0)"
_CUVEE = f"t.v >= 0.3e0 AND NOT {_in(_I.CLASSES, 't.t')}"
_GRAPE_NAMES = "list_filter([CASE WHEN regexp_matches({0}, '\\bmerlot\\b') THEN 'merlot' END, CASE WHEN regexp_matches({0}, '\\bsyrah\\b') THEN 'syrah' END], lambda g: g IS NOT NULL)"
_LOOKUP_SQL = f"""WITH c AS (SELECT s_suppkey AS candidate_id, {', '.join(f'{e} AS {n}' for n, e in _ROW.items())}, 'Red' AS menu_section FROM supplier JOIN part ON p_partkey = s_suppkey),
  k0 AS (SELECT DISTINCT {', '.join(f'{e} AS {n}' for n, e in _ENTRY.items())}, min(p_partkey) OVER (PARTITION BY {_ENTRY['winery']}, {_NAME}) AS wine_id FROM part),
  texts AS (SELECT raw_text AS text FROM c UNION SELECT name FROM k0), {_STYLES_SQL.replace(', NULL AS white', ', CAST(NULL AS VARCHAR) AS white')},
  colours AS (SELECT text, CASE WHEN {_in(style.RED_STYLES, 'key')} THEN 'red' WHEN {_in(style.WHITE_STYLES, 'key')} THEN 'white' END AS colour FROM styled),
  k AS (SELECT k0.*, colour, {_identity('winery')} AS ww, {_identity('name')} AS all_n, {_identity('region')} AS rg, {_identity("winery || ' ' || name", False)} AS has FROM k0 LEFT JOIN colours ON text = name),
  m1 AS (SELECT c.*, colour, {_identity('raw_text')} AS rw, {_worth_search('producer')} AS pw, {_worth_search('label')} AS lw, {_worth_search('raw_text')} AS aw, {_keep(_identity("regexp_extract(raw_text, '" + chr(34) + "([^" + chr(34) + "]{2,48})" + chr(34) + "', 1)"), f"NOT {_in([*_I.GRAPES, *_I.PLACES, *_I.CLASSES, *_I.PRODUCER_KINDS])}")} AS q FROM c LEFT JOIN colours ON text = raw_text),
  m2 AS (SELECT *, CASE WHEN len(pw) + len(lw) > 0 THEN list_concat(pw, lw) ELSE aw END AS spoken, {_keep('pw', f"NOT {_in(_I.GRAPES)}")} AS made FROM m1),
  m3 AS (SELECT *, {_keep(_once('spoken'), f"NOT {_in(_I.GRAPES)}")} AS names, {_keep(_once('spoken'), _in(_I.GRAPES))} AS grape, list_slice({_keep('made', 'NOT list_contains(q, t)')}, 1, 2) AS maker FROM m2),
  m4 AS (SELECT *, list_concat(maker, q) AS quoted, list_concat(names, list_slice(grape, 1, 1)) AS grown FROM m3),
  m5 AS (SELECT *, list_filter([list_slice(names, 1, 4), CASE WHEN len(q) > 0 AND len(maker) > 0 THEN list_slice({_once('quoted')}, 1, 4) END, list_slice(names, 1, 2), CASE WHEN len(names) <= 2 AND len(grape) > 0 THEN list_slice({_once('grown')}, 1, 3) END, list_slice({_once('made')}, 1, 3)], lambda p: p IS NOT NULL AND len(p) > 0) AS every FROM m4),
  m AS (SELECT *, CASE WHEN len(names) > 0 THEN list_slice({_once('every')}, 1, {matching.MOST_SEARCHES}) ELSE [] END AS plans FROM m5),
  found AS (SELECT candidate_id, winery, name, min(i) - 1 AS plan FROM m, unnest(range(1, len(plans) + 1)) AS u(i), (SELECT DISTINCT winery, name, has FROM k) WHERE list_has_all(has, plans[i]) GROUP BY ALL),
  pair AS (SELECT m.candidate_id, plan, rw, q, k.* EXCLUDE (colour), raw_text, vintage AS asked, {_keep('all_n', 'NOT list_contains(ww, t)')} AS nw FROM found JOIN m USING (candidate_id) JOIN k USING (winery, name)
    WHERE coalesce(m.colour = k.colour, true) AND NOT (len({_GRAPE_NAMES.format('lower(label)')}) > 0 AND len(list_filter({_GRAPE_NAMES.format('name')}, lambda g: NOT list_contains({_GRAPE_NAMES.format('lower(label)')}, g))) > 0)),
  word AS (SELECT *, len(list_filter(rw, lambda t: {_in(_I.GRAPES)})) > 0 AS grape, list_concat(ww, nw) AS hit_words, {_keep('ww', f"({_weight('producer')}) = 1 AND NOT {_in(_I.GIVEN_NAMES)}")} AS own FROM pair),
  judged AS (SELECT *, list_transform({_once('nw')}, lambda t: {{'t': t, 'w': CASE WHEN list_contains(rg, t) OR {_in(_I.PLACES)} THEN 0.1e0 ELSE {_weight('name')} END, 'found': {_in_pool('rw')}}}) AS n0, {_covered('ww', 'rw', 'producer')} AS maker, list_concat(hit_words, rg) AS pool,
    len(own) = 0 OR len(list_filter(own, lambda t: {_in_pool('rw')})) > 0 AS seen, len(list_filter(hit_words, lambda t: {_MAIN})) > 0 AND len(list_filter(rw, lambda t: {_MAIN} AND NOT list_contains(hit_words, t))) > 0 AS grape_gone, len(q) > 0 AND len(list_filter(q, lambda t: {_in_pool('hit_words')})) = 0 AS quote_gone FROM word),
  valued AS (SELECT *, {_covered('rw', 'pool', 'candidate')} AS cov, list_transform(n0, lambda t: {{'t': t.t, 'w': t.w, 'found': t.found, 'v': CASE WHEN {_in(_I.GRAPES, 't.t')} AND NOT grape THEN 0.3e0 ELSE t.w END}}) AS n FROM judged),
  summed AS (SELECT *, {_TALLY('t.w > 0.1e0')} = 0 AS everywhere, CASE WHEN {_SUM('true')} > 0 AND {_TALLY('t.w > 0.1e0')} > 0 THEN {_SUM('t.found')} / {_SUM('true')} ELSE 1.0e0 END AS named, {_TALLY(f"NOT t.found AND t.v = 1 AND NOT {_in(_I.GRAPES, 't.t')}")} AS missing, {_TALLY(_CUVEE)} AS cuvees, {_TALLY(_CUVEE + ' AND t.found')} AS met,
    list_transform(list_filter(n, lambda t: t.w = 1 AND NOT {_in(_I.GRAPES, 't.t')} AND t.found), lambda t: t.t) AS matched, {_TALLY('t.w > 0.1e0')} = 0 AND len(n) > 0 AND {_TALLY('t.found')} = 0 AS guess FROM valued),
  alone AS (SELECT *, NOT seen AND cov >= 0.85e0 AND missing = 0 AND len(matched) >= 1 AND (met = cuvees OR len(matched) >= 2) AS alone, 0.4e0 * maker + 0.35e0 * named + 0.25e0 * cov AS plain FROM summed),
  scored AS (SELECT *, CASE WHEN len(rw) = 0 THEN 0.0e0 ELSE greatest(0.0e0, least(CASE WHEN alone THEN least(0.8e0, 0.5e0 * named + 0.5e0 * cov) WHEN NOT seen THEN plain * 0.45e0 ELSE plain END, CASE WHEN missing >= 2 THEN 0.55e0 WHEN missing = 1 AND named < 0.5e0 THEN 0.62e0 ELSE 1.0e0 END,
      CASE WHEN cuvees > 0 AND met = 0 THEN 0.58e0 ELSE 1.0e0 END, CASE WHEN grape_gone THEN 0.58e0 ELSE 1.0e0 END, CASE WHEN quote_gone THEN 0.55e0 ELSE 1.0e0 END, CASE WHEN NOT alone AND maker < 0.6e0 THEN 0.58e0 WHEN NOT alone AND maker < 0.75e0 THEN 0.7e0 ELSE 1.0e0 END)) END AS score,
    CASE WHEN len(list_filter(rw, lambda t: ({_weight('candidate')}) = 1 AND NOT {_in(_I.GRAPES)} AND NOT {_in_pool('ww')} AND {_in_pool('nw')})) > 0 THEN 0.025e0 ELSE 0.0e0 END - least(0.01e0, 0.002e0 * len(list_filter({_once('nw')}, lambda t: NOT {_in_pool('rw')}))) AS bonus,
    CASE WHEN asked = year THEN 3 WHEN asked IS NULL AND NOT regexp_matches(raw_text, ' NV$') THEN 2 ELSE 0 END AS rank FROM alone),
  item AS (SELECT candidate_id, upto, wine_id, {{'plan': plan, 'year': year, 'name': name, 'rank': rank, 'hit': {{'winery': winery, 'name': name, 'region': region, 'year': year, 'price': retail_price, 'bonus': bonus, 'rank': rank}}, 'judged': {{'score': score, 'alone': alone, 'cuvee': matched, 'guess': guess}}}} AS x FROM scored, unnest(range(plan, {matching.MOST_SEARCHES})) AS u(upto)),
  fold AS (SELECT candidate_id, upto, wine_id, list_reduce(list(x ORDER BY x), lambda k, y: CASE WHEN y.rank > k.rank OR (y.rank = k.rank AND y.judged.score > k.judged.score) THEN {{'plan': y.plan, 'year': y.year, 'name': y.name, 'rank': y.rank, 'hit': y.hit, 'judged': CASE WHEN k.judged.score > y.judged.score THEN k.judged ELSE y.judged END}} ELSE k END) AS f FROM item GROUP BY ALL),
  last AS (SELECT candidate_id, coalesce(min(upto) FILTER (f.judged.score >= {matching.DECISIVE} OR (f.judged.alone AND f.judged.score >= {matching.CONFIDENT})), {matching.MOST_SEARCHES - 1}) AS upto FROM fold GROUP BY candidate_id),
  kept AS (SELECT candidate_id, wine_id, f.hit AS hit, f.judged AS judged, count(*) OVER (PARTITION BY candidate_id, f.hit.winery) AS around FROM fold JOIN last USING (candidate_id, upto)),
  capped AS (SELECT *, CASE WHEN judged.guess AND around > 1 THEN least(judged.score, {matching.GUESS_CAP}) ELSE judged.score END AS identity FROM kept),
  best AS (SELECT * FROM capped QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY identity + CASE WHEN hit.rank = 3 THEN 0.02e0 ELSE 0.0e0 END + hit.bonus DESC, wine_id) = 1),
  makers AS (SELECT candidate_id, count(DISTINCT winery) AS n FROM best, k WHERE judged.alone AND identity >= {matching.LEAST} AND len(list_filter(judged.cuvee, lambda t: NOT ({_in_pool(_identity('k.name', False))}))) = 0 GROUP BY candidate_id),
  kind AS (SELECT best.*, coalesce(n, 0) > 1 AS shared FROM best LEFT JOIN makers USING (candidate_id))"""


@query("catalogue_match", f"""{_LOOKUP_SQL}
  SELECT candidate_id, wine_id, CASE WHEN identity >= 0.75e0 THEN least(1.0e0, 0.82e0 + (identity - 0.75e0) * 0.72e0) ELSE greatest(0.0e0, 0.65e0 + (identity - 0.6e0) * (0.16e0 / 0.15e0)) END AS match_score, hit.winery || ' ' || hit.name AS display_name, hit.winery AS producer, hit.name AS label,
    CASE WHEN hit.rank = 3 THEN hit.year ELSE c.vintage END AS vintage, hit.region AS region, hit.price AS retail_price FROM kind JOIN c USING (candidate_id) WHERE NOT shared AND identity >= {matching.LEAST}""")
def catalogue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' menu rows looked up among the parts as a catalogue."""
    p = table(spark, sf_dir, "part")
    listed = p.select("p_partkey", *[F.expr(e).alias(n) for n, e in _ENTRY.items()]).withColumn("wine_id", F.min("p_partkey").over(Window.partitionBy("winery", "name"))).drop("p_partkey").distinct()
    rows = table(spark, sf_dir, "supplier").join(p, F.col("p_partkey") == F.col("s_suppkey"))
    menu = rows.select(F.col("s_suppkey").alias("candidate_id"), *[F.expr(e).alias(n) for n, e in _ROW.items()], F.lit("Red").alias("menu_section"), F.lit(None).cast("string").alias("varietal"))
    # a limit far below the default, so that common words are looked up by two and in blocks
    return matching.lookup(menu, listed, limit=200, entries=style_entries(spark, sf_dir))
