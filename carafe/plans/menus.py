"""The menu parser over menus written from the parts, and SQL that states it again as recursion over lines.

A menu is seven lines in all shapes that the line functions tell apart, in an order that follows no rule, so that blocks begin, go on and end in many ways.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prices, quality, text
from ..functions.lexicon import COLOURS, DESCRIPTORS, GEOGRAPHY, REGIONS, VARIETALS
from ..operators import menu
from . import lines as L
from .lines import _list, _squeezed
from .queries import query, table

_N, _Y, _W = L._N, L._Y, L._W
_SHAPES = [
    *L._SHAPES,
    f"concat(p_name, ' | Riesling | Rheinhessen, Germany ', {_N}, '/', CAST(p_size * 4 AS STRING))",
    f"concat('Keller ', {_W}, ' | Mosel ', {_N}, ' *')",
    "concat('Domaine ', p_type, ' ', chr(34), p_name, chr(34), ' Bandol - Provence, France')",
    f"concat('Ridge ', chr(39), p_type, chr(39), ' ', {_Y})",
    "'chilled red - Jura, France'",
    f"concat({_Y}, ' Burgundy')",
    "'Dry Creek Valley, California'",
    "concat('Cloudy Bay ', p_type, ' Sauvignon Blanc')",
    f"concat('Grand ', p_type, ' Estate White ', {_N}, ' ')",
    "'Provence, France'",
    "concat('Maison ', p_type, ' -')",
    "'Eyrie, OR'",
]
LINE = f"CASE p_partkey % {len(_SHAPES)} " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SHAPES)) + " END"
_HEAD = {"tab": "CASE WHEN doc % 4 = 1 THEN '@@TAB: Cellar' END", "section": "CASE WHEN doc % 5 < 2 THEN CASE WHEN doc % 3 = 0 THEN '@@SECTION: White list' ELSE 'Red Wines' END END"}
AS_OF = 2025


def menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: each seven parts make a menu; where one has a tab or a heading, it comes first or in the middle."""
    p = table(spark, sf_dir, "part").select(F.expr("p_partkey div 7").alias("doc"), "p_size", "p_partkey", F.expr(LINE).alias("line"))
    heads = p.select("doc").distinct()
    every = p.select("doc", "p_size", "p_partkey", "line").unionByName(heads.selectExpr("doc", "0 as p_size", "-1L as p_partkey", f"{_HEAD['tab']} as line")).unionByName(heads.selectExpr("doc", "doc % 40 as p_size", "0L as p_partkey", f"{_HEAD['section']} as line"))
    told = every.where("line is not null").groupBy(F.col("doc").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_size").cast("long").alias("s"), F.col("p_partkey").alias("p"), "line"))).alias("l"))
    return told.select("doc_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


_SANE = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '^[*•|¢]+\s*', ''), '\s+[|«»]+$', ''), '\s*[*†‡§¶#]+\s*$', ''), '\s+@\s*[A-Za-z0-9''’.+-]+$', ''), '^\s+|\s+$', '', 'g'))"
_QUOTED = L._QUOTED
_YEAR = L._YEAR
_NV = r"(?i)^(?:NV|N\.V\.)"
_SHORT = "[''’‘`][0-9]{2}\\b"
_SLASHED = r"/\s*\$?[0-9]+(?:\.[0-9]{2})?\b"
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_STYLED = r"(?i)^(chilled\s+red|red|white|orange|sparkling|rose|rosé)\s*[-—:]\s*(.+)$"
_TIDY = "" + _squeezed("regexp_replace(" + L._CORRECTED.format(L._UNMARKED) + ", '>+', ' ', 'g')")


def _hint(x: str, hints: list[str]) -> str:
    return f"list_filter({_list(hints)}, lambda h: contains(lower({x}), h))[1]"


def _alpha(x: str) -> str:
    return f"list_filter(string_split(lower({L._quality(x)}), ' '), lambda w: regexp_matches(w, '[a-z]'))"


def _capitals(x: str, least: str) -> str:
    bare = r"regexp_replace(w, '^[^\pL\pN]+|[^\pL\pN''’.-]+$', '', 'g')"
    return rf"len(list_filter({_WORDS.format(x)}, lambda w: regexp_matches({bare}, '^\p{{Lu}}[\pL''’.-]{least}$')))"


def _priced(x: str) -> str:
    blob, title = f"regexp_extract({x}, '{L._MENU}', 2)", rf"regexp_replace(trim(regexp_extract({x}, '{L._MENU}', 1)), '[:\s]+$', '')"
    fits = rf"regexp_matches({x}, '{L._MENU}') AND regexp_matches({title}, '[A-Za-z]') AND len(list_filter(regexp_split_to_array({blob}, '\s*/\s*'), lambda t: regexp_matches(trim(t), '^(19|20)[0-9]{{2}}$'))) = 0"
    bare = f"regexp_matches({x}, '{L._BARE}') AND {L._likely(f'''regexp_extract({x}, '{L._BARE}', 2)''')}"
    return f"(regexp_matches({x}, '{L._INLINE}') OR ({bare}) OR ({fits}))"


def _identified(x: str) -> str:
    return rf"(regexp_matches({x}, '{_YEAR}') OR regexp_matches({x}, '{_NV}\s') OR regexp_matches({x}, '{_QUOTED}') OR {_hint(x, VARIETALS)} IS NOT NULL OR {_priced(x)})"


def _goes_on(s: str, title: str) -> str:
    return f"(CASE {s}.go_kind WHEN 'no' THEN false WHEN 'named' THEN NOT {_identified(title)} ELSE {s}.go_rest AND NOT ({s}.varietal AND {_hint(title, VARIETALS)} IS NOT NULL) END)"


def _vintage(x: str) -> str:
    short = rf"CAST(regexp_extract({x}, '[''’‘`]([0-9]{{2}})\b', 1) AS INTEGER)"
    return f"CASE WHEN regexp_matches({x}, '{_YEAR}') THEN CAST(regexp_extract({x}, '{_YEAR}') AS INTEGER) WHEN regexp_matches({x}, '{_SHORT}') THEN {short} + CASE WHEN {short} <= {AS_OF - 2000 + 1} THEN 2000 ELSE 1900 END END"


def _regions(name: str, source: str) -> str:
    """Tables that end in ``name``(t, region): texts t of ``source``(t) as regions, without marks and repeats, cut after a geographic word."""
    u = _squeezed("regexp_replace(" + L._UNMARKED.format(L._CORRECTED.format("t")) + ", '>+', ' ', 'g')")
    return rf"""{name}1 AS (SELECT DISTINCT t, {u} AS u FROM ({source}) WHERE t IS NOT NULL), {name}2 AS (SELECT t, {L._without_repeats('u')} AS k FROM {name}1), {name}3 AS (SELECT t, {_squeezed('k')} AS r FROM {name}2),
  {name} AS (SELECT t, trim(regexp_replace(CASE WHEN regexp_matches(r, '{L._TAIL}') THEN trim(regexp_extract(r, '{L._TAIL}', 1)) ELSE r END, '[,:;/-]+$', '')) AS region FROM {name}3)"""


def _header(x: str) -> str:
    folded = rf"list_filter(string_split({_squeezed(rf"regexp_replace(lower(strip_accents({x})), '[^a-z0-9\s]', ' ', 'g')")}, ' '), lambda t: t <> '')"
    return f"CASE WHEN len(list_filter({folded}, lambda w: list_contains({_list(text.SECTION_WORDS)}, w))) > 0 AND len(list_filter({folded}, lambda w: NOT list_contains({_list(text.SECTION_WORDS + text.SECTION_CONTEXT)}, w) AND NOT regexp_matches(w, '^[0-9]+$'))) = 0 THEN list_filter({folded}, lambda w: list_contains({_list(text.SECTION_WORDS)}, w))[1] END"


_ALL = f"""raw AS (SELECT p_partkey // 7 AS doc, CAST(p_size AS BIGINT) AS s, p_partkey AS p, {LINE} AS line FROM part
    UNION ALL SELECT doc, 0, -1, {_HEAD['tab']} FROM (SELECT DISTINCT p_partkey // 7 AS doc FROM part) UNION ALL SELECT doc, doc % 40, 0, {_HEAD['section']} FROM (SELECT DISTINCT p_partkey // 7 AS doc FROM part)),
  clean AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY s, p, line) - 1 AS pos, {L._CORRECTED.format("regexp_replace(" + _SANE.format('line') + ", '^[a-z]" + chr(92) + "s+([A-Z])', '" + chr(92) + "1')")} AS line FROM raw WHERE line IS NOT NULL),
  l AS (SELECT doc, pos, row_number() OVER (PARTITION BY doc ORDER BY pos) AS n, line FROM clean WHERE line <> '')"""
_FACTS = f"""{L._ROW_FACTS},
  g1 AS (SELECT *, amount IS NOT NULL OR fits AS priced, regexp_matches(line, '{L._SAID}') AND NOT regexp_matches(line, '{_YEAR}') AND NOT regexp_matches(line, '{_QUOTED}') AND amount IS NULL AND NOT fits AS described,
    len(list_filter({_list(VARIETALS)}, lambda v: regexp_matches(line, '(?i)\\b' || v || '$') AND regexp_matches(strip_accents(left(line, length(line) - length(v))), '[A-Za-z]'))) > 0 AS named, {_WORDS.format('line')} AS said,
    CASE WHEN regexp_matches(tidy, '^(19|20)[0-9]{{2}}\\b') THEN CAST(left(tidy, 4) AS INTEGER) END AS year, CASE WHEN regexp_matches(tidy, '^(19|20)[0-9]{{2}}\\b') THEN regexp_replace(trim(substr(tidy, 5)), '^[-,:]\\s*', '') ELSE tidy END AS rest_of FROM f),
  g2 AS (SELECT *, lower({L._quality('rest_of')}) AS low, len({_alpha('rest_of')}) AS n_alpha, {_capitals('tidy', '+')} AS caps FROM g1),
  g3 AS (SELECT *, regexp_matches(low, '\\b(?:{'|'.join(GEOGRAPHY)})\\b') AS tail, len(list_filter({_list(DESCRIPTORS)}, lambda d: contains(low, d))) AS descriptors FROM g2),
  {_regions('lr', 'SELECT rest_of AS t FROM g3')},
  g4 AS (SELECT g3.*, region AS go_region, tidy <> '' AND n_alpha BETWEEN 2 AND 10 AND (tail OR (year IS NOT NULL AND regexp_matches(low, '\\b(?:{'|'.join(REGIONS)})\\b') AND n_alpha <= 4))
      AND NOT (regexp_matches(tidy, '{_QUOTED}') OR regexp_matches(tidy, '\\s+-\\s+') OR regexp_matches(tidy, '{_SLASHED}') OR regexp_matches(low, '\\b(?:{'|'.join(v for v in VARIETALS if v != 'champagne')})\\b') OR regexp_matches(low, '\\b(?:domaine|chateau|château|winery|vineyards?|estate)\\b'))
      AND NOT (year IS NULL AND n_alpha >= 4 AND caps >= 3 AND NOT contains(tidy, ',')) AND NOT (descriptors >= 2 AND NOT tail) AND NOT styled AND NOT serving AND (region <> '' OR year IS NOT NULL) AS go FROM g3 JOIN lr ON lr.t = rest_of),
  g5 AS (SELECT *, regexp_matches(trim(line), '^[A-Z][A-Za-zÀ-ÿ]+(/[A-Z][A-Za-zÀ-ÿ]+)+$') OR (regexp_matches(trim(line), '^[A-Za-zÀ-ÿ]+$') AND varietal) AS fragment, regexp_matches(line, ',\\s*[A-Z]{{2}}$') AS state, len(list_filter(said, lambda w: regexp_matches(w, '[A-Za-z]'))) AS alpha,
    regexp_matches(line, '{_YEAR}') OR regexp_matches(line, '{_NV}(?:[^A-Za-z0-9_]|$)') OR regexp_matches(line, '{_QUOTED}') OR regexp_matches(line, '\\s+-\\s+') OR regexp_matches(line, '\\s+-$') AS marks FROM g4),
  g6 AS (SELECT *, CASE WHEN described OR priced OR styled OR go OR marks OR fragment THEN 'no' WHEN named THEN 'named' ELSE 'perhaps' END AS go_kind,
    state OR (NOT contains(line, ',') AND len(said) BETWEEN 1 AND 6 AND alpha > 0 AND ({_capitals('line', '*')} / alpha >= 0.6e0 OR {_hint('line', COLOURS + VARIETALS)} IS NOT NULL)) AS go_rest,
    NOT (described OR serving OR go) AND (named OR marks OR regexp_matches(line, '{_SHORT}') OR ({L._likely(f"regexp_extract(line, '{L._BARE}', 2)")} AND len(list_filter({_alpha(f"regexp_extract(line, '{L._BARE}', 1)")}, lambda w: length(w) >= 2)) >= 2) OR ({_capitals('line', '+')} >= 3 AND (regexp_matches(line, '{_SLASHED}') OR (NOT contains(line, ',') AND len(said) >= 4)))) AS starts,
    regexp_matches(line, '{_YEAR}') OR regexp_matches(line, '{_NV}\\s') OR regexp_matches(line, '{_QUOTED}') OR priced OR (NOT contains(line, ',') AND len(said) <= 12 AND named) AS evidence,
    len(regexp_split_to_array(lower(line), '\\s*,\\s*')) >= 2 AND len(list_filter(regexp_split_to_array(lower(line), '\\s*,\\s*'), lambda p: NOT list_contains({_list(REGIONS + GEOGRAPHY + L.MORE_REGIONS)}, p))) = 0 AND list_contains({_list(GEOGRAPHY)}, regexp_split_to_array(lower(line), '\\s*,\\s*')[-1]) AS region_only,
    CASE WHEN starts_with(line, '@@TAB:') THEN 'tab' WHEN starts_with(line, '@@SECTION:') THEN 'section' WHEN {_header('line')} IS NOT NULL THEN 'header'
      WHEN regexp_matches(trim(line), '^[A-Za-z]\\s*/\\s*[A-Za-z]$') OR serving OR plain = '' OR regexp_matches(plain, '\\bipa\\b') OR length(plain) > 200 OR len(list_filter({_list(L.NOT_AN_ITEM)}, lambda h: contains(plain, h))) > 0 THEN 'other'
      WHEN regexp_matches(line, '^\\$?[0-9]+(\\.[0-9]{{2}})?(\\s*/\\s*\\$?[0-9]+(\\.[0-9]{{2}})?){{1,2}}$') OR regexp_matches(line, '^\\$[0-9]+(\\.[0-9]{{2}})?$') OR {L._likely('line')} THEN 'price' ELSE 'text' END AS kind,
    {L._likely("regexp_extract(line, '([0-9]{1,3}(?:[.][0-9]{2})?)[ ]*$', 1)")} OR priced AS ends, {L._largest('line')} AS largest FROM g5),
  step AS (SELECT *, CASE WHEN kind = 'tab' THEN trim(substr(line, 7)) END AS new_tab, CASE WHEN kind = 'section' THEN trim(substr(line, 11)) ELSE {_squeezed("regexp_replace(line, '[^" + chr(92) + "pL" + chr(92) + "pN" + chr(92) + "s]', ' ', 'g')")} END AS heading,
    {_header("CASE WHEN starts_with(line, '@@SECTION:') THEN trim(substr(line, 11)) ELSE line END")} AS color, coalesce(lead(kind) OVER (PARTITION BY doc ORDER BY n) = 'price', false) AS price_next, pos < coalesce(min(pos) FILTER (kind = 'header') OVER (PARTITION BY doc), -1) AS before FROM g6)"""
#: What a line does to the open block: skip, begin another, push, end with it (region), drop (early), price, or move to other headings.
_ACTION = f"""CASE WHEN s.kind = 'text' THEN CASE WHEN len(b.held) > 0 AND b.cost IS NOT NULL THEN CASE WHEN s.region_only AND NOT s.price_next THEN 'end' WHEN s.before AND NOT (s.evidence OR s.price_next) THEN 'drop' ELSE 'begin' END
      WHEN len(b.held) = 0 THEN CASE WHEN s.before AND NOT (s.evidence OR s.price_next) THEN 'skip' ELSE 'begin' END WHEN s.starts AND NOT {_goes_on('s', 'b.title')} THEN 'begin' ELSE 'push' END
    WHEN s.kind = 'price' THEN CASE WHEN len(b.held) > 0 THEN 'price' ELSE 'skip' END ELSE 'move' END"""
_BLOCKS = f"""walk AS (SELECT doc, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS held, '' AS title, CAST(0 AS BIGINT) AS since, CAST(NULL AS DOUBLE) AS cost, CAST(NULL AS VARCHAR) AS color, CAST(NULL AS VARCHAR) AS tab, CAST(NULL AS VARCHAR) AS section,
      CAST(NULL AS STRUCT(held BIGINT[], since BIGINT, cost DOUBLE, color VARCHAR, tab VARCHAR, section VARCHAR)) AS done FROM (SELECT DISTINCT doc FROM l)
    UNION ALL SELECT doc, n, CASE action WHEN 'skip' THEN held WHEN 'price' THEN held WHEN 'begin' THEN [n] WHEN 'push' THEN list_append(held, n) ELSE [] END, CASE action WHEN 'begin' THEN line WHEN 'push' THEN title || ' ' || line WHEN 'skip' THEN title WHEN 'price' THEN title ELSE '' END,
      CASE action WHEN 'begin' THEN pos ELSE since END, CASE action WHEN 'price' THEN greatest(cost, largest) WHEN 'push' THEN cost WHEN 'skip' THEN cost END, CASE WHEN kind = 'tab' THEN NULL WHEN kind IN ('section', 'header') THEN new_color ELSE color END,
      CASE WHEN kind = 'tab' THEN new_tab ELSE tab END, CASE WHEN kind = 'tab' THEN NULL WHEN kind IN ('section', 'header') THEN heading ELSE section END,
      CASE WHEN action = 'end' THEN {{'held': list_append(held, n), 'since': since, 'cost': cost, 'color': color, 'tab': tab, 'section': section}} WHEN action IN ('begin', 'drop', 'move') AND len(held) > 0 THEN {{'held': held, 'since': since, 'cost': cost, 'color': color, 'tab': tab, 'section': section}} END
      FROM (SELECT s.doc, s.n, s.pos, s.line, s.kind, s.largest, s.color AS new_color, s.new_tab, s.heading, b.held, b.title, b.since, b.cost, b.color, b.tab, b.section, {_ACTION} AS action FROM walk b JOIN step s ON s.doc = b.doc AND s.n = b.n + 1)),
  block AS (SELECT doc, done.* FROM walk WHERE done IS NOT NULL UNION ALL SELECT doc, held, since, cost, color, tab, section FROM walk WHERE len(held) > 0 QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC) = 1 AND n = (SELECT max(n) FROM l WHERE l.doc = walk.doc)),
  place AS (SELECT b.*, row_number() OVER () AS id FROM block b),
  part_of AS (SELECT id, i, s.* FROM place p, unnest(range(1, len(p.held) + 1)) AS u(i) JOIN step s ON s.doc = p.doc AND s.n = p.held[i]),
  head AS (SELECT id, CAST(1 AS BIGINT) AS i, line AS said, ends, line AS last, CAST(1 AS BIGINT) AS taken, false AS over FROM part_of WHERE i = 1
    UNION ALL SELECT id, i, CASE WHEN more THEN said || ' ' || line ELSE said END, CASE WHEN more THEN now_ends ELSE ends END, CASE WHEN more THEN line ELSE last END, taken + CAST(more AS BIGINT), NOT more
      FROM (SELECT h.id, x.i, h.said, h.ends, h.last, h.taken, x.line, x.ends AS now_ends, NOT h.over AND NOT h.ends AND ((regexp_matches(h.last, '[-—]$') AND x.state) OR {_goes_on('x', 'h.said')}) AS more FROM head h JOIN part_of x ON x.id = h.id AND x.i = h.i + 1)),
  titled AS (SELECT id, trim(said) AS t, taken FROM head QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1),
  noted AS (SELECT id, list(line ORDER BY i) FILTER (i > taken) AS notes, list({{'v': CASE WHEN go THEN year END, 'r': CASE WHEN go THEN nullif(go_region, '') END}} ORDER BY i) FILTER (i > taken) AS more, list(fragment ORDER BY i) FILTER (i > taken) AS fragments FROM part_of JOIN titled USING (id) GROUP BY id)"""
_BARE_TWO = r"^(.*\S)\s+([0-9]+(?:\s*/\s*[0-9]+)?)$"


def _region_price(x: str, what: str) -> str:
    clean = L._UNMARKED.format(x)
    blob = f"regexp_extract({clean}, '{_BARE_TWO}', 2)"
    amount = f"CASE WHEN {blob} LIKE '%/%' THEN {L._largest(blob)} WHEN TRY_CAST({blob} AS DOUBLE) BETWEEN 5 AND 2000 THEN TRY_CAST({blob} AS DOUBLE) END"
    fits = f"regexp_matches({clean}, '{_BARE_TWO}') AND NOT regexp_matches({blob}, '^(19|20)[0-9]{{2}}$') AND ({amount}) IS NOT NULL"
    return f"CASE WHEN {fits} THEN " + (f"trim(regexp_extract({clean}, '{_BARE_TWO}', 1))" if what == "region" else L._dollars(f"({amount})")) + " END"


_DISPLAY = r"trim(regexp_replace(lower({0}), '[^\pL\pN]+', ' ', 'g'))"
_EXTRA = "CASE WHEN NOT contains(" + _DISPLAY.format("shown") + ", " + _DISPLAY.format("{0}") + ") THEN {0} END"
_SAID_LABEL = r"""^(?:(.*?)\s+)?(?:"([^"]+)"|“([^”]+)”|[‘'']((?:[^’'']|[’'']\pL)+)[’''])\s*(.*)$"""
_ENDS = sorted(VARIETALS, key=len, reverse=True)
_BY_GRAPE = lambda g: " ".join(rf"WHEN regexp_matches(who, '(?i)^(.*\S)\s+({h.replace(' ', chr(92) + 's+')})$') THEN trim(regexp_extract(who, '(?i)^(.*\S)\s+({h.replace(' ', chr(92) + 's+')})$', {g}))" for h in _ENDS)
_PLACED = r"list_filter(regexp_split_to_array(who, '\s{2,}| - |, '), lambda p: p <> '')"
_TWO = "list_filter(string_split(who, ' '), lambda w: w <> '')"
_LABEL_TAIL = rf"regexp_replace(trim(regexp_extract(who, '{_SAID_LABEL}', 5)), '^[-,]\s*', '')"
_LABEL_SAID = f"trim(regexp_extract(who, '{_SAID_LABEL}', 2) || regexp_extract(who, '{_SAID_LABEL}', 3) || regexp_extract(who, '{_SAID_LABEL}', 4))"
_FIELDS = rf"""c1 AS (SELECT place.*, t, notes, more, fragments, list_filter(list_transform(regexp_split_to_array(t, '\s*\|\s*'), lambda p: trim(p)), lambda p: p <> '') AS piped FROM place JOIN titled USING (id) LEFT JOIN noted USING (id)),
  c2 AS (SELECT *, CASE WHEN contains(t, '|') AND len(piped) >= 2 THEN piped END AS pipes FROM c1),
  c3 AS (SELECT *, CASE WHEN len(pipes) < 3 THEN pipes[2] ELSE array_to_string(pipes[3:], ', ') END AS tail, coalesce(pipes[1], t) AS name FROM c2),
  c4 AS (SELECT *, {_region_price('tail', 'region')} AS tail_region, {_region_price('tail', 'price')} AS tail_price, CASE WHEN pipes IS NULL AND {_priced('name')} AND regexp_matches(name, '{L._MENU}') THEN regexp_replace(trim(regexp_extract(name, '{L._MENU}', 1)), '[:\s]+$', '') END AS m_said, regexp_extract(name, '{L._MENU}', 2) AS m_blob FROM c3),
  c5 AS (SELECT *, CASE WHEN regexp_matches(m_said, '[A-Za-z]') AND len(list_filter(regexp_split_to_array(m_blob, '\s*/\s*'), lambda t: regexp_matches(trim(t), '^(19|20)[0-9]{{2}}$'))) = 0 THEN m_said END AS m_title FROM c4),
  c6 AS (SELECT *, CASE WHEN m_title IS NOT NULL THEN {L._dollars(L._largest('m_blob'))} END AS m_price, regexp_replace(coalesce(m_title, name), '\s+-\s+', ' - ', 'g') AS of FROM c5),
  c7 AS (SELECT *, CASE WHEN regexp_matches(of, '{L._INLINE}') THEN trim(regexp_extract(of, '{L._INLINE}', 1)) WHEN regexp_matches(of, '{L._BARE}') AND {L._likely(f"regexp_extract(of, '{L._BARE}', 2)")} THEN trim(regexp_extract(of, '{L._BARE}', 1)) ELSE trim(of) END AS txt,
    CASE WHEN regexp_matches(of, '{L._INLINE}') THEN TRY_CAST(regexp_extract(of, '{L._INLINE}', 2) AS DOUBLE) WHEN regexp_matches(of, '{L._BARE}') AND {L._likely(f"regexp_extract(of, '{L._BARE}', 2)")} THEN TRY_CAST(regexp_replace(regexp_extract(of, '{L._BARE}', 2), '^\$', '') AS DOUBLE) END AS i_amount FROM c6),
  c8 AS (SELECT *, {_TIDY.format('txt')} AS tidied, {_vintage('txt')} AS own_year, regexp_split_to_array(txt, '\s+-\s+') AS sides FROM c7),
  {_regions('tr', f"SELECT nullif(regexp_extract(tidied, '{_STYLED}', 2), '') AS t FROM c8")},
  c9 AS (SELECT c8.*, trim(sides[2]) AS side, CASE WHEN regexp_matches(tr.region, '[A-Za-z]') AND regexp_matches(txt, '(?i)^\W*(?:chilled|red|white|orange|sparkling|ros)') THEN lower(trim(regexp_extract(tidied, '{_STYLED}', 1))) END AS style, tr.region AS style_region FROM c8 LEFT JOIN tr ON tr.t = nullif(regexp_extract(tidied, '{_STYLED}', 2), '')),
  d1 AS (SELECT *, coalesce(regexp_matches(side, '{_QUOTED}') OR ({_vintage('side')}) IS NOT NULL OR {_hint('side', VARIETALS)} IS NOT NULL, false) AS label_right, pipes IS NULL AND coalesce(fragments[1], false) AS alone FROM c9),
  d2 AS (SELECT *, CASE WHEN label_right THEN sides[1] || ' ' || side ELSE sides[1] END AS identity, CASE WHEN alone THEN {_region_price('notes[2]', 'region')} END AS a_region, CASE WHEN alone THEN {_region_price('notes[2]', 'price')} END AS a_price FROM d1),
  d3 AS (SELECT *, regexp_replace(trim(CASE WHEN own_year IS NOT NULL THEN regexp_replace(identity, '^(.*?)' || own_year, '\1') ELSE identity END), '{_NV}\s+', '') AS who, CASE WHEN alone THEN coalesce(a_region, nullif({L._UNMARKED.format('notes[2]')}, '')) END AS alone_region, coalesce(CASE WHEN alone THEN least(2, len(notes)) ELSE 0 END, 0) AS skip, pipes IS NOT NULL OR style IS NOT NULL AS over FROM d2),
  d4 AS (SELECT *, more[skip + 1].v AS v1, more[skip + 1].r AS r1, more[skip + 2].v AS v2, more[skip + 2].r AS r2 FROM d3),
  d5 AS (SELECT *, NOT over AND v1 IS NOT NULL AND own_year IS NULL AS year1, NOT over AND r1 IS NOT NULL AND alone_region IS NULL AS region1 FROM d4),
  d6 AS (SELECT *, (year1 OR region1) AND v2 IS NOT NULL AND own_year IS NULL AND NOT year1 AS year2, (year1 OR region1) AND r2 IS NOT NULL AND alone_region IS NULL AND NOT region1 AS region2 FROM d5),
  e1 AS (SELECT *, skip + CAST(year1 OR region1 AS INT) + CAST(year2 OR region2 AS INT) AS used, coalesce(own_year, CASE WHEN year1 THEN v1 WHEN year2 THEN v2 END) AS vintage, coalesce(pipes[1], txt) AS shown,
    coalesce(CASE WHEN NOT (len(pipes) < 3 AND tail_region IS NOT NULL) THEN nullif({L._UNMARKED.format('pipes[2]')}, '') END, CASE WHEN alone THEN notes[1] END) AS grape,
    coalesce(CASE WHEN style IS NOT NULL THEN style_region END, tail_region, CASE WHEN len(pipes) >= 3 THEN nullif({L._UNMARKED.format('tail')}, '') END, alone_region, CASE WHEN region1 THEN r1 WHEN region2 THEN r2 END, CASE WHEN NOT label_right THEN nullif(side, '') END) AS placed,
    CASE WHEN style IS NULL THEN nullif(CASE WHEN regexp_matches(who, '{_SAID_LABEL}') THEN regexp_replace(trim(regexp_extract(who, '{_SAID_LABEL}', 1)), '\s+-\s*$', '') {_BY_GRAPE(1)} WHEN len({_PLACED}) >= 2 THEN {_PLACED}[1] ELSE array_to_string({_TWO}[1:2], ' ') END, '') END AS producer,
    CASE WHEN style IS NOT NULL THEN style ELSE nullif(CASE WHEN regexp_matches(who, '{_SAID_LABEL}') THEN CASE WHEN contains({_LABEL_TAIL}, ',') OR regexp_matches({_LABEL_TAIL}, '{_YEAR}') OR {_LABEL_TAIL} = '' THEN {_LABEL_SAID} ELSE {_LABEL_SAID} || ' ' || {_LABEL_TAIL} END {_BY_GRAPE(2)} WHEN len({_PLACED}) >= 2 THEN trim(array_to_string({_PLACED}[2:], ' ')) ELSE trim(array_to_string({_TWO}[3:], ' ')) END, '') END AS label FROM d6),
  e2 AS (SELECT *, nullif(trim(array_to_string(coalesce(notes, [])[used + 1:], ' ')), '') AS told, coalesce(lower(grape), {_hint("concat_ws(' ', txt, array_to_string(coalesce(notes, []), ' '))", VARIETALS)}) AS varietal, coalesce(placed, {_hint('txt', REGIONS)}) AS region,
    coalesce({L._dollars('cost')}, tail_price, a_price, m_price, {L._dollars('i_amount')}) AS price, CASE WHEN style IS NOT NULL THEN style || ' - ' || style_region ELSE concat_ws(', ', shown, {_EXTRA.format('grape')}, {_EXTRA.format('placed')}) END AS raw_text,
    coalesce({_hint('style', ['red', 'white', 'orange', 'sparkling', 'rose', 'rosé'])}, color) AS colour FROM e1)"""
_SCORED = rf"""texts AS (SELECT DISTINCT line FROM (SELECT txt AS line FROM e2 UNION ALL SELECT label FROM e2 UNION ALL SELECT region FROM e2 UNION ALL SELECT told FROM e2) WHERE line IS NOT NULL),
  q1 AS (SELECT line, {L._quality('line')} AS q FROM texts), q2 AS (SELECT *, lower(q) AS low, list_filter(string_split(lower(q), ' '), lambda w: regexp_matches(w, '[a-z]')) AS tokens FROM q1),
  q3 AS (SELECT *, CASE WHEN len(tokens) > 0 THEN {L._unit(L._text_score('q', 'line'))} ELSE 0.0e0 END AS quality, CASE WHEN len(tokens) > 0 THEN {L._unit(L._text_score('q', 'low'))} ELSE 0.0e0 END AS plain FROM q2),
  marked AS (SELECT line, quality, CASE WHEN low <> '' THEN {L._unit(f"(plain * 0.8e0 + CASE WHEN contains(low, ',') THEN 0.05e0 ELSE 0 END + CASE WHEN {_hint('low', VARIETALS)} IS NOT NULL THEN 0.08e0 ELSE 0 END + CASE WHEN {_hint('low', REGIONS)} IS NOT NULL THEN 0.08e0 ELSE 0 END + CASE WHEN {_hint('low', COLOURS)} IS NOT NULL THEN 0.05e0 ELSE 0 END + CASE WHEN regexp_matches(low, '{_YEAR}') THEN 0.04e0 ELSE 0 END)")} ELSE 0.0e0 END AS told FROM q3),
  h1 AS (SELECT e2.*, coalesce(a.quality, 0) AS tq, coalesce(b.quality, 0) AS lq, coalesce(c.quality, 0) AS rq, coalesce(d.told, 0) AS nq FROM e2 LEFT JOIN marked a ON a.line = txt LEFT JOIN marked b ON b.line = label LEFT JOIN marked c ON c.line = region LEFT JOIN marked d ON d.line = e2.told),
  h2 AS (SELECT *, CAST(lq >= 0.4e0 AS INT) + CAST(rq >= 0.4e0 AS INT) + CAST(coalesce(price <> '', false) AS INT) + CAST(coalesce(varietal <> '', false) AS INT) + CAST(coalesce(colour <> '', false) AS INT) + CAST(vintage IS NOT NULL AS INT) + CAST(nq >= 0.45e0 AS INT) AS signals FROM h1),
  h3 AS (SELECT *, tq * 0.42e0 + lq * 0.12e0 + rq * 0.1e0 + nq * 0.18e0 + least(signals, 4) * 0.05e0 + CASE WHEN coalesce(price <> '', false) THEN 0.08e0 ELSE 0 END + CASE WHEN coalesce(varietal <> '', false) THEN 0.06e0 ELSE 0 END + CASE WHEN vintage IS NOT NULL THEN 0.05e0 ELSE 0 END + CASE WHEN coalesce(colour <> '', false) THEN 0.03e0 ELSE 0 END - CASE WHEN tq < 0.32e0 AND nq < 0.28e0 AND signals < 2 THEN 0.25e0 ELSE 0 END AS sum FROM h2),
  h4 AS (SELECT *, {L._unit('sum')} AS confidence FROM h3)"""


@query("menu_candidates", f"""WITH RECURSIVE {_ALL}, {_FACTS}, {_BLOCKS}, {_FIELDS}, {_SCORED}
  SELECT doc AS doc_id, CAST(since AS INTEGER) AS line_number, raw_text, price, tab AS menu_tab, section AS menu_section, producer, label, CAST(vintage AS INTEGER) AS vintage, colour AS color, varietal, region, told AS notes, confidence AS extraction_confidence
  FROM h4 WHERE regexp_matches(t, '\\pL') AND NOT (tq < 0.28e0 AND nq < 0.3e0 AND signals < 2) AND confidence >= {quality.ACCEPTED}""")
def menu_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Menus written from the parts, read back to candidates."""
    return menu.parse_menus(menus(spark, sf_dir), as_of_year=AS_OF).drop("candidate_id")


_HEADING = "CASE p_partkey % 7 WHEN 0 THEN 'RED wines by the glass' WHEN 1 THEN 'Sparkling & White 2' WHEN 2 THEN 'Rosé' WHEN 3 THEN concat('red ', p_name) WHEN 4 THEN concat(p_name, ' list') WHEN 5 THEN concat(' The - ORANGE! ', CAST(p_size AS STRING)) ELSE 'glasses by the bottle' END"
_DATED = "concat('Clos ', CASE o_orderkey % 7 WHEN 0 THEN CAST(year(o_orderdate) AS STRING) WHEN 1 THEN concat(chr(39), lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')) WHEN 2 THEN concat('’', lpad(CAST(o_orderkey % 100 AS STRING), 2, '0'), ' ', CAST(1900 + o_orderkey % 100 AS STRING)) WHEN 3 THEN concat(CAST(2000 + o_orderkey % 100 AS STRING), '0') WHEN 4 THEN concat('x', CAST(year(o_orderdate) AS STRING)) WHEN 5 THEN concat('`', CAST(o_orderkey AS STRING)) ELSE '12345' END, ' x')"


@query("section_headers", f"SELECT p_partkey, {_header('line')} AS header FROM (SELECT p_partkey, {_HEADING} AS line FROM part)")
def section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.section_header(F.expr(_HEADING)).alias("header"))


@query("vintage_parse", f"SELECT o_orderkey, {_vintage('line')} AS vintage FROM (SELECT o_orderkey, {_DATED} AS line FROM orders)")
def vintage_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", prices.vintage(F.expr(_DATED), AS_OF).alias("vintage"))
