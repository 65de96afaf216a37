"""The registered queries over the driver's tables, each with the SQL that must give the same rows.

The tables hold no menus. Where an operator needs menu text, lines are made from columns in the query; where it needs tastes,
``part`` is the catalogue and its dimensions follow from its columns by arithmetic. All queries run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import prices, taste, text, tokens
from ..operators import html, jobs, keyed, layout, menu, ranking
from ..operators.ranking import recommended_order, top_in_each

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt over the session's shuffle partitions: a small file of many rows is few tasks, however much is computed a row."""
    return df.repartition(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


# A synthetic mapping of parts to recommendations, in both languages.
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    fifth = F.floor(k / 5).cast("int")
    seen = F.filter(F.array(F.lit("body"), F.lit("acidity"), F.lit("tannin"), F.when(k % 7 != 0, F.lit("sweetness"))), lambda d: d.isNotNull())
    vector = F.struct((1 + size % 5).alias("body"), (1 + k % 5).alias("acidity"), (1 + fifth % 5).alias("tannin"), (1 + (size + k) % 5).alias("sweetness"), F.when(k % 3 == 0, "inferred").when(k % 3 == 1, "direct").otherwise("mapped").alias("source_mode"), F.when(k % 11 == 0, 0.0).otherwise(0.5).alias("confidence"), seen.alias("observed"))
    recs = p.select(k.alias("candidate_id"), k.alias("pos"), "p_brand", "p_type", "p_name", F.when(k % 9 != 0, F.concat(F.lit("$"), F.floor("p_retailprice").cast("string"))).alias("price"), F.col("p_brand").alias("menu_tab"), F.col("p_type").alias("menu_section"), "p_retailprice", (F.floor(F.pmod(k * 37, F.lit(100))) / 100).alias("match_confidence"), F.when(k % 4 == 0, "low-confidence").otherwise("matched").alias("status"), vector.alias("taste"))
    from .api import scored

    return scored(recs)


RECS = """recs AS (
  SELECT p_partkey AS candidate_id, p_partkey AS pos, p_brand, p_type, p_name, p_retailprice,
    CASE WHEN p_partkey % 9 <> 0 THEN '$' || CAST(floor(p_retailprice) AS BIGINT) END AS price,
    (p_partkey * 37 % 100) / 100.0e0 AS match_confidence,
    CASE WHEN p_partkey % 4 = 0 THEN 'low-confidence' ELSE 'matched' END AS status,
    CASE p_partkey % 3 WHEN 0 THEN 'inferred' WHEN 1 THEN 'direct' ELSE 'mapped' END AS source_mode,
    (p_partkey % 11 <> 0) AND (p_partkey % 3 = 0 OR (p_partkey % 7 <> 0 AND p_partkey % 4 <> 0)) AS eligible,
    abs(3 - (1 + p_size % 5)) * 0.1e0 + abs(5 - (1 + p_partkey % 5)) * 0.4e0 + abs(3 - (1 + (p_partkey // 5) % 5)) * 0.1e0 + abs(1 - (1 + (p_size + p_partkey) % 5)) * 0.4e0 AS away
  FROM part),
fits AS (SELECT *, CASE WHEN eligible THEN CAST(greatest(0, least(100, floor((1 - away / 4.0e0) * 100 + 0.5e0))) AS INTEGER) ELSE 0 END AS fit_score,
    CAST(nullif(regexp_extract(price, '[0-9]+(\\.[0-9]{1,2})?'), '') AS DOUBLE) AS amount FROM recs)"""
ORDER = "eligible DESC, CASE WHEN eligible THEN fit_score END DESC NULLS LAST, match_confidence DESC, pos"


def order() -> list:
    return recommended_order(F.col("eligible"), F.col("fit_score"), F.col("match_confidence"), F.col("pos"))


@query("menu_ranking", f"""WITH {RECS} SELECT p_brand || ':::' || p_type AS section_id, p_brand || ' · ' || p_type AS label, min(pos) AS first_pos, count(*) AS n,
  count(*) FILTER (eligible) AS eligible, max(CASE WHEN eligible THEN fit_score END) AS best_fit FROM fits WHERE amount <= 1500 GROUP BY p_brand, p_type""")
def menu_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit, eligibility, join to candidates, budget, sections in order of appearance: the flagship."""
    recs = recommendations(spark, sf_dir)
    candidates = recs.select("candidate_id", "pos", "price", "menu_tab", "menu_section")
    joined = ranking.with_candidates(recs.drop("pos", "price", "menu_tab", "menu_section"), candidates)
    best = F.max(F.when(F.col("eligible"), F.col("fit_score"))).alias("best_fit")
    return ranking.sections(ranking.in_budget(joined, 1500.0, False), F.count_if("eligible").alias("eligible"), best).orderBy("first_pos")


@query("ranked_topk", f"WITH {RECS} SELECT p_brand, candidate_id, fit_score, match_confidence, eligible FROM fits QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY {ORDER}) <= 3")
def ranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_in_each(recommendations(spark, sf_dir), ["p_brand"], order(), 3).select("p_brand", "candidate_id", "fit_score", "match_confidence", "eligible")


@query("discovered_order", f"WITH {RECS} SELECT candidate_id, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN candidate_id % 5 <> 0 THEN pos END NULLS LAST, fit_score, candidate_id) AS place FROM fits")
def discovered_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    known = F.when(F.col("candidate_id") % 5 != 0, F.col("pos"))
    w = Window.partitionBy("p_brand").orderBy(*ranking.discovered_order(known, F.col("fit_score")), "candidate_id")
    return recommendations(spark, sf_dir).select("candidate_id", "p_brand", F.row_number().over(w).alias("place"))


@query("price_filter", f"WITH {RECS} SELECT candidate_id, price FROM fits WHERE amount IS NULL OR amount <= 1000")
def price_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.in_budget(recommendations(spark, sf_dir), 1000.0, True).select("candidate_id", "price")


@query("price_bounds", f"WITH {RECS} SELECT CAST(greatest(0, floor(min(amount))) AS BIGINT) AS low, CAST(ceil(max(amount)) AS BIGINT) AS high, count(amount) AS priced, count(*) - count(amount) AS unpriced FROM fits HAVING count(amount) > 0")
def price_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.price_bounds(recommendations(spark, sf_dir))


@query("profile_filter_counts", f"WITH {RECS} SELECT count(*) AS n, count(*) FILTER (source_mode <> 'inferred') AS own, count(*) FILTER (source_mode = 'inferred') AS inferred, count(*) FILTER (eligible) AS eligible FROM fits")
def profile_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ranking.has_own_profile(F.col("taste"))
    return recommendations(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("own"), F.count_if(~own).alias("inferred"), F.count_if("eligible").alias("eligible"))


@query("section_rollup", f"WITH {RECS} SELECT p_type, count(*) FILTER (status = 'matched') AS matched, count(*) FILTER (status = 'low-confidence') AS low, count(*) FILTER (status = 'unmatched') AS unmatched FROM fits GROUP BY p_type")
def section_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.count_if(F.col("status") == s)
    return recommendations(spark, sf_dir).groupBy("p_type").agg(of("matched").alias("matched"), of("low-confidence").alias("low"), of("unmatched").alias("unmatched"))


@query("price_benchmark", """SELECT p_brand, CASE WHEN r <= 2.5e0 THEN 'fair' WHEN r <= 3.5e0 THEN 'average' ELSE 'steep' END AS tier, count(*) AS n
  FROM (SELECT p_brand, l_extendedprice * (1 + l_linenumber % 5) / l_quantity / p_retailprice AS r FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 AND l_extendedprice > 0 AND p_retailprice > 0) GROUP BY 1, 2""")
def price_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").where("l_quantity > 0").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    amount = F.col("l_extendedprice") * (1 + F.col("l_linenumber") % 5) / F.col("l_quantity")
    tier = prices.benchmark_tier(amount, F.col("p_retailprice"))
    return both.groupBy("p_brand", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n")).where("tier is not null")


@query("section_forward_fill", """SELECT event_id, user_id, last_value(CASE WHEN event_type IN ('view', 'signup') THEN {'v': CASE WHEN event_type = 'view' THEN props END} END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING).v AS section FROM events""")
def section_forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    filled = keyed.carried_forward(table(spark, sf_dir, "events"), ["user_id"], F.col("event_id"), kind.isin("view", "signup"), F.when(kind == "view", F.col("props")), "section")
    return filled.select("event_id", "user_id", "section")


@query("conversation_carry", """SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations""")
def conversation_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.col("role") == "user"
    df = keyed.carried_forward(table(spark, sf_dir, "conversations"), ["conv_id"], F.col("turn"), asked & F.col("text").isNotNull(), F.length("text").cast("long"), "asked")
    return df.select("conv_id", "turn", "asked")


_SANE = "string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))"


@query("next_nonempty_line", f"""WITH l AS (SELECT doc_id, unnest({_SANE}) AS line, generate_subscripts({_SANE}, 1) - 1 AS pos FROM documents)
  SELECT doc_id, pos, md5(lead(line) OVER (PARTITION BY doc_id ORDER BY pos)) AS next_md5 FROM l WHERE line <> ''""")
def next_nonempty_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))
    return keyed.next_nonempty(lines, ["doc_id"], "pos", "line", "next").select("doc_id", F.col("pos").cast("long"), F.md5(F.col("next").cast("binary")).alias("next_md5"))


@query("split_lines", rf"""WITH l AS (SELECT doc_id, unnest({_SANE}) AS line, generate_subscripts({_SANE}, 1) - 1 AS pos FROM documents),
  s AS (SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^[*•|¢]+\s*', ''), '\s+[|«»]+$', ''), '\s*[*†‡§¶#]+\s*$', ''), '\s+@\s*[A-Za-z0-9''’.+-]+$', ''), '^\s+|\s+$', '', 'g'), '^[a-z]\s+([A-Z])', '\1') AS line FROM l)
  SELECT doc_id, pos AS line_number, md5(line) AS line_md5 FROM s""")
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = menu.split_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", F.col("line_number").cast("long"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query("dedupe_keep_last", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def dedupe_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.keep_last(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], F.col("event_id"))


@query("dedupe_keep_first", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.keep_first(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], F.col("event_id"))


@query("dedupe_priceless", """WITH i AS (SELECT l_suppkey, l_partkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_extendedprice END AS price FROM lineitem)
  SELECT * FROM i WHERE price IS NOT NULL OR NOT EXISTS (SELECT 1 FROM i AS o WHERE o.price IS NOT NULL AND o.l_suppkey = i.l_suppkey AND o.l_partkey = i.l_partkey)""")
def dedupe_priceless(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice")).alias("price"))
    return keyed.without_priceless_twins(items, ["l_suppkey", "l_partkey"], "price")


@query("best_per_key", """WITH r AS (SELECT l_orderkey, list(struct_pack(pos := l_linenumber, rank := l_partkey % 4, score := l_discount, payload := l_partkey) ORDER BY l_linenumber, l_partkey % 4, l_discount, l_partkey) AS a FROM lineitem GROUP BY l_orderkey),
  k AS (SELECT l_orderkey, list_reduce(a, lambda k, x: CASE WHEN x.rank > k.rank OR (x.rank = k.rank AND x.score > k.score) THEN struct_pack(pos := x.pos, rank := x.rank, score := greatest(x.score, k.score), payload := x.payload) ELSE k END) AS b FROM r)
  SELECT l_orderkey, b.payload AS payload, b.rank AS rank, b.score AS score FROM k""")
def best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.ordered_fold_best(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_linenumber"), F.col("l_partkey") % 4, F.col("l_discount"), F.col("l_partkey"))


@query("best_of_ties", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC, event_id) = 1")
def best_of_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return keyed.best_per_key(df, ["user_id"], F.struct(F.floor("value"), -F.col("event_id")), True)


@query("title_preview", r"""SELECT page_id, replace(replace(replace(replace(replace(nullif(trim(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1)), ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&') AS title, nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '') AS domain FROM pages""")
def title_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.title_preview(table(spark, sf_dir, "pages"))


@query("link_extract", r"""SELECT page_id, href FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)href="([^"#]+)"', 1))) AS href FROM pages)""")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("href"))


@query("inline_prices", """SELECT p_partkey, CASE WHEN p_size >= 5 THEN p_name ELSE p_name || ' ' || p_size END AS title, CASE WHEN p_size BETWEEN 5 AND 400 THEN '$' || p_size END AS price FROM part""")
def inline_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", prices.inline_price(row).alias("x")).select("p_partkey", "x.title", "x.price")


_LEADERS = "lead AS (SELECT p_brand, arg_min(p_name, p_partkey) AS first_name FROM part GROUP BY p_brand), n AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(first_name), ' ') AS b FROM part JOIN lead USING (p_brand))"


def _with_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part beside the first of its brand."""
    p = table(spark, sf_dir, "part")
    return p.join(p.groupBy("p_brand").agg(F.min_by("p_name", "p_partkey").alias("first_name")), "p_brand")


@query("token_jaccard", f"WITH {_LEADERS} SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS share FROM n")
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_leaders(spark, sf_dir).select("p_partkey", tokens.jaccard(F.array_distinct(tokens.tokens(F.col("p_name"))), F.array_distinct(tokens.tokens(F.col("first_name")))).alias("share"))


_FUZZY = "list_sum(list_transform({0}, lambda t: CASE WHEN list_contains({1}, t) THEN 1.0e0 WHEN length(t) >= 4 AND len(list_filter({1}, lambda u: length(u) >= 4 AND levenshtein(t, u) <= 1)) > 0 THEN 0.8e0 ELSE 0.0e0 END)) / len({0})"


@query("fuzzy_token_match", f"WITH {_LEADERS} SELECT p_partkey, {_FUZZY.format('a', 'b')} AS overlap FROM n")
def fuzzy_token_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_leaders(spark, sf_dir).select("p_partkey", tokens.fuzzy_overlap(tokens.tokens(F.col("p_name")), tokens.tokens(F.col("first_name"))).alias("overlap"))


@query("pooled_f1", f"WITH {_LEADERS}, f AS (SELECT p_partkey, {_FUZZY.format('a', 'b')} AS p, {_FUZZY.format('b', 'a')} AS r FROM n) SELECT p_partkey, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0e0 END AS f1 FROM f")
def pooled_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_leaders(spark, sf_dir).select("p_partkey", tokens.pooled_f1(tokens.tokens(F.col("p_name")), tokens.tokens(F.col("first_name"))).alias("f1"))


_CORE_OUT = ", ".join(repr(w) for w in [*tokens.STOPWORDS, *tokens.COUNTRIES, *tokens.CONCEPTS, *tokens.VARIETAL_TOKENS])
_PLAIN = r"trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_CORE = f"list_filter(string_split({_PLAIN}, ' '), lambda t: length(t) > 1 AND t NOT IN ({_CORE_OUT}) AND NOT regexp_matches(t, '^(19|20)[0-9]{{{{2}}}}$') AND NOT regexp_matches(t, '^[0-9]+(l|ml)$'))"
_OVERLAP = "CASE WHEN len({0}) > 0 AND len({1}) > 0 THEN " + _FUZZY + " ELSE 0.0e0 END"
_CONCEPTS_OF = "list_distinct(list_filter(list_transform(string_split({0}, ' '), lambda t: CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tokens.CONCEPTS.items()) + " END), lambda c: c IS NOT NULL))"
_EXACT = "list_filter(string_split({0}, ' '), lambda t: t IN (" + ", ".join(repr(w) for w in tokens.EXACT_CONCEPTS) + "))"
_MISSED = "list_sum(list_transform(list_filter({1}, lambda c: NOT list_contains({0}, c)), lambda c: CASE c " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in tokens.CONCEPT_PENALTY.items()) + " ELSE 0 END))"


@query("match_scores", f"""WITH lead AS (SELECT p_brand, arg_min(p_name, p_partkey) AS first_name FROM part GROUP BY p_brand),
  w AS (SELECT p_partkey, p_size, {_PLAIN.format('p_brand')} AS brand, {_PLAIN.format("concat_ws(' ', p_name, p_type)")} AS mine_text, {_PLAIN.format("concat_ws(' ', first_name, p_type)")} AS their_text, {_CORE.format('p_brand')} AS producer, {_CORE.format('p_name')} AS label, {_CORE.format('p_type')} AS region, {_CORE.format("concat_ws(' ', p_brand, p_name)")} AS raw, {_CORE.format('first_name')} AS theirs FROM part JOIN lead USING (p_brand)),
  s AS (SELECT *, list_distinct(list_concat(producer, label, region, raw)) AS mine_all, list_distinct(list_concat(producer, theirs, region)) AS their_all, list_distinct(theirs) AS their_label, list_filter(label, lambda t: NOT list_contains(theirs, t)) AS rest, list_filter(label, lambda t: NOT list_contains(theirs, t) AND NOT list_contains(producer, t)) AS rest2, list_filter(region, lambda t: NOT list_contains(label, t)) AS region_only FROM w),
  f AS (SELECT *, {_OVERLAP.format('mine_all', 'their_all')} AS p, {_OVERLAP.format('their_all', 'mine_all')} AS r, {_OVERLAP.format('label', 'their_label')} AS covered, {_OVERLAP.format('raw', 'their_all')} AS raw_covered,
    CASE WHEN len(rest) > 0 AND len(producer) > 0 THEN len(list_filter(rest, lambda t: list_contains(producer, t))) / len(rest) ELSE 0.0e0 END AS in_producer, CASE WHEN len(rest2) > 0 AND len(region) > 0 THEN len(list_filter(rest2, lambda t: list_contains(region, t))) / len(rest2) ELSE 0.0e0 END AS in_region,
    CASE WHEN len(region_only) > 0 THEN 1.0e0 ELSE 0.0e0 END AS novel, {_CONCEPTS_OF.format("(brand || ' ' || mine_text)")} AS own_concepts, {_CONCEPTS_OF.format('their_text')} AS their_concepts FROM s),
  x AS (SELECT p_partkey, greatest(0.0e0, least(1.0e0, 0.5e0 * CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END + 0.18e0 * CASE WHEN brand = '' THEN 0 ELSE 1 END + 0.18e0 * covered * CASE WHEN len(label) = 1 THEN 0.6e0 ELSE 1 END + 0.03e0 * in_producer + 0.03e0 * in_region + 0.03e0 * novel + CASE WHEN p_size = 11 THEN 0.1e0 ELSE 0 END + 0.02e0 * raw_covered
    + CASE WHEN list_has_any({_EXACT.format('mine_text')}, {_EXACT.format('their_text')}) THEN 0.03e0 ELSE 0 END - least(0.3e0, coalesce({_MISSED.format('own_concepts', 'their_concepts')}, 0))
    - CASE WHEN brand <> '' AND len(theirs) > 0 AND len(mine_all) > 0 AND len(list_filter(theirs, lambda t: list_contains(mine_all, t) OR (length(t) >= 4 AND len(list_filter(mine_all, lambda u: length(u) >= 4 AND levenshtein(t, u) <= 1)) > 0))) = 0 THEN 0.3e0 ELSE 0 END)) AS score FROM f)
  SELECT p_partkey, score, CASE WHEN score >= 0.82e0 THEN 'matched' WHEN score >= 0.65e0 THEN 'low-confidence' ELSE 'unmatched' END AS status FROM x""")
def match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole match score of parts against the first of their brand; tests hold its terms against worked cases."""
    none = F.lit(None).cast("string")
    mine = {"producer": F.col("p_brand"), "label": F.col("p_name"), "varietal": none, "region": F.col("p_type"), "raw_text": F.concat_ws(" ", "p_brand", "p_name"), "color": none, "vintage": F.col("p_size")}
    theirs = {"producer": F.col("p_brand"), "label": F.col("first_name"), "varietal": none, "region": F.col("p_type"), "vintage": F.lit(11)}
    df = spread(_with_leaders(spark, sf_dir), "p_partkey").withColumn("score", tokens.match_score(mine, theirs))
    return df.select("p_partkey", "score", taste.status_of(F.col("score")).alias("status"))


@query("sibling_cap", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type) > 10 THEN least((p_partkey * 37 % 100) / 100.0e0, 0.58e0) ELSE (p_partkey * 37 % 100) / 100.0e0 END AS identity FROM part")
def sibling_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.pmod(F.col("p_partkey") * 37, F.lit(100)) / 100
    p = table(spark, sf_dir, "part")
    many = p.groupBy("p_brand", "p_type").agg((F.count(F.lit(1)) > 10).alias("many"))
    return p.join(many, ["p_brand", "p_type"]).select("p_partkey", F.when(F.col("many"), F.least(score, F.lit(0.58))).otherwise(score).alias("identity"))


@query("folded_names", "SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(strip_accents(c_name)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS folded FROM customer")
def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.normal_field(F.col("c_name")).alias("folded"))


@query("median_upper", "SELECT l_suppkey, l_quantity AS median FROM (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem WHERE l_quantity IS NOT NULL) WHERE r = n // 2 + 1")
def median_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.upper_median(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity")


_FIT = "SELECT l_suppkey, round(s, 9) AS slope, round(mx - s * my, 6) AS intercept FROM (SELECT l_suppkey, coalesce(greatest(-0.1e0, least(0.1e0, regr_slope(l_discount, l_quantity))), 0e0) AS s, avg(l_discount) AS mx, avg(l_quantity) AS my FROM lineitem GROUP BY 1)"


@query("gutter_fit", _FIT)
def gutter_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = layout.clamped_fit(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount")
    return fit.select("l_suppkey", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("price_bands", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type <> 'error' AS wanted FROM events),
  b AS (SELECT *, CASE WHEN wanted AND coalesce(lag(wanted) OVER w AND t - lag(t) OVER w <= 43200000000, false) THEN 0 ELSE 1 END AS brk FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))
  SELECT event_id, user_id, CAST(CASE WHEN wanted THEN sum(brk) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) END AS BIGINT) AS band FROM b""")
def price_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("event_id", "user_id", t.alias("t"), (F.col("event_type") != "error").alias("wanted"))
    return keyed.gap_bands(e, ["user_id"], F.col("t"), F.col("t"), F.col("wanted"), 43_200_000_000, "band", [F.col("t"), F.col("event_id")]).select("event_id", "user_id", "band")


_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'processing' END"


def _job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("status", F.expr(_STATUS)).withColumn("job", F.floor(F.col("event_id") / 4))


@query("terminal_status", f"""WITH e AS (SELECT event_id // 4 AS job, event_id, {_STATUS} AS status FROM events)
  SELECT job, coalesce(arg_min(status, event_id) FILTER (status IN ('completed', 'failed', 'canceled')), arg_max(status, event_id)) AS status, count(*) AS n_events FROM e GROUP BY job""")
def terminal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.final_status(_job_events(spark, sf_dir), "job", F.col("status"), F.col("event_id"))


@query("job_rollup", f"""WITH e AS (SELECT event_id // 4 AS job, {_STATUS} AS status FROM events)
  SELECT job, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN count(*) FILTER (status = 'completed') >= 4 THEN 'completed' ELSE 'processing' END AS status, least(count(*) FILTER (status = 'completed'), 4) AS processed, 4 AS total FROM e GROUP BY job""")
def job_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.rollup(_job_events(spark, sf_dir), "job", F.col("status"), F.lit(4))


@query("lease_claims", """WITH RECURSIVE e AS (SELECT user_id AS job, event_id % 8 AS item, event_type AS owner, epoch_us(ts) // 1000 AS ms, event_id AS seq, row_number() OVER (PARTITION BY user_id, event_id % 8 ORDER BY event_id) AS n FROM events),
  r AS (SELECT job, item, seq, ms, owner, n, true AS granted, 1 AS attempt, ms + 3600000 AS expires, owner AS held FROM e WHERE n = 1
    UNION ALL SELECT e.job, e.item, e.seq, e.ms, e.owner, e.n, r.held = e.owner OR r.expires <= e.ms, r.attempt + CAST(r.held = e.owner OR r.expires <= e.ms AS INTEGER), CASE WHEN r.held = e.owner OR r.expires <= e.ms THEN e.ms + 3600000 ELSE r.expires END, CASE WHEN r.held = e.owner OR r.expires <= e.ms THEN e.owner ELSE r.held END FROM r JOIN e ON e.job = r.job AND e.item = r.item AND e.n = r.n + 1)
  SELECT job, item, seq, ms, owner, granted, attempt, expires FROM r""")
def lease_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims are a fold over time; tests hold it against a plain replay."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), (F.col("event_id") % 8).alias("item"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.col("event_id").alias("seq"))
    return jobs.claims(e, "job", "item", "event_type", "ms", "seq", 3_600_000)


@query("publish_budget", """WITH f AS (SELECT event_id, user_id, event_type, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) = 1)
  SELECT event_id, user_id FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 6""")
def publish_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type", "props"))
    return jobs.admitted(e, "key", "user_id", [F.col("event_id")], 6).select("event_id", "user_id")


@query("publish_deadline", """WITH d AS (SELECT event_id, user_id, event_type, props FROM events WHERE ts < min_ts + INTERVAL 5 DAY), f AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) = 1)
  SELECT event_id, user_id FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 6""".replace("FROM events", "FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS min_ts FROM events)"))
def publish_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``publish_budget``, with a deadline five days after a user's first event."""
    e = table(spark, sf_dir, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type", "props"))
    opened = e.groupBy("user_id").agg((F.min("ts") + F.expr("INTERVAL 5 DAYS")).alias("deadline"))
    return jobs.admitted(e.join(opened, "user_id"), "key", "user_id", [F.col("event_id")], 6, "ts", F.col("deadline")).select("event_id", "user_id")


@query("paced_requests", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events)
  SELECT event_id, user_id, CAST(max(t - i * 3600000) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) + i * 3600000 AS BIGINT) AS start_ms FROM e""")
def paced_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"))
    return jobs.paced(e, ["user_id"], "t", 3_600_000, "start_ms").select("event_id", "user_id", "start_ms")


@query("resume_anti_join", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 30)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return keyed.not_done(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), done, ["o_orderkey"])


@query("provider_chain", """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_partkey, l_discount >= 0.09e0 AS matched FROM lineitem), s AS (SELECT l_orderkey, min(l_linenumber) AS stop FROM r WHERE matched GROUP BY 1)
  SELECT l_orderkey, l_linenumber, l_quantity, l_partkey FROM r LEFT JOIN s USING (l_orderkey) WHERE stop IS NULL OR l_linenumber <= stop QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey DESC) = 1""")
def provider_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_discount")
    out = keyed.first_accepted(r, ["l_orderkey"], F.col("l_linenumber"), F.col("l_quantity"), F.col("l_discount") >= 0.09, F.col("l_partkey"), F.col("l_discount"))
    return out.drop("l_discount")


@query("memo_join", """WITH k AS (SELECT p_partkey, sha256(concat_ws(chr(31), 'v1', lower(p_name), p_type, CAST(p_size AS VARCHAR))) AS key, p_retailprice FROM part), m AS (SELECT key, min(p_retailprice) AS known FROM k WHERE p_partkey % 2 = 0 GROUP BY key)
  SELECT p_partkey, key, coalesce(known, p_retailprice) AS price FROM k LEFT JOIN m USING (key)""")
def memo_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("key", keyed.memory_key(F.lit("v1"), F.lower("p_name"), F.col("p_type"), F.col("p_size")))
    memory = p.where("p_partkey % 2 = 0").groupBy("key").agg(F.min("p_retailprice").alias("known"))
    return keyed.remembered(p, memory, "key", "known", F.col("p_retailprice"), "price").select("p_partkey", "key", "price")


@query("stored_weights", "SELECT c_custkey, CAST(floor(coalesce(nullif((c_custkey % 11) / 10.0e0, 0), 0.4e0) * 1000 + 0.5e0) AS BIGINT) AS weight FROM customer")
def stored_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = (F.col("c_custkey") % 11) / 10
    weight = F.coalesce(F.when(own != 0, own), F.lit(taste.DEFAULT_WEIGHTS["acidity"]))
    return table(spark, sf_dir, "customer").select("c_custkey", text.rounded(weight * 1000).alias("weight"))


@query("vector_fit", """WITH v AS (SELECT vec_id, list_transform(embedding[1:4], lambda x: greatest(1, least(5, floor(abs(CAST(x AS DOUBLE)) * 20 + 0.5e0)))) AS t FROM embeddings)
  SELECT vec_id, CAST(greatest(0, least(100, floor((1 - (abs(3 - t[1]) * 0.1e0 + abs(5 - t[2]) * 0.4e0 + abs(3 - t[3]) * 0.1e0 + abs(1 - t[4]) * 0.4e0) / 4.0e0) * 100 + 0.5e0))) AS INTEGER) AS fit FROM v""")
def vector_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: taste.clamped(F.abs(F.get("embedding", F.lit(i)).cast("double")) * 20)
    return table(spark, sf_dir, "embeddings").select("vec_id", taste.fit_score({d: at(i) for i, d in enumerate(taste.DIMENSIONS)}).alias("fit"))


@query("price_extremes", f"WITH {RECS} SELECT p_brand, arg_min(candidate_id, amount * 1000000 + candidate_id) AS cheapest, arg_max(candidate_id, amount * 1000000 - candidate_id) AS dearest FROM fits WHERE amount IS NOT NULL GROUP BY p_brand")
def price_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = recommendations(spark, sf_dir).withColumn("amount", prices.number_in(F.col("price"))).where("amount is not null")
    return priced.groupBy("p_brand").agg(F.min_by("candidate_id", F.struct("amount", "candidate_id")).alias("cheapest"), F.max_by("candidate_id", F.struct("amount", -F.col("candidate_id"))).alias("dearest"))
