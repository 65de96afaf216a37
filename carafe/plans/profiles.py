"""Queries over profiles, preferences, evidence and progress. Inputs are made from the parts by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, profile, taste
from ..operators import jobs, keyed
from .queries import query, table

_K = "p_partkey"


def _parts(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(_K, "p_size", "p_name", "p_type", "p_brand", "p_retailprice", *[F.expr(e).alias(n) for n, e in columns.items()])


def _made(**columns: str) -> str:
    return "m AS (SELECT p_partkey, p_size, p_name, p_type, p_brand, p_retailprice, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM part)"


_FIELDS = {
    "own": "CASE WHEN p_partkey % 3 = 0 THEN p_brand END",
    "theirs": "CASE WHEN p_partkey % 4 = 0 THEN concat('Maker ', p_brand) END",
    "label": "CASE p_partkey % 6 WHEN 0 THEN ' Red' WHEN 1 THEN 'Chilled Red ' WHEN 2 THEN 'red wine' WHEN 3 THEN 'Rosé' WHEN 4 THEN p_name END",
    "shown": "CASE WHEN p_partkey % 10 = 0 THEN p_name END",
    "raw": "CASE WHEN p_partkey % 7 <> 0 THEN concat(p_name, ' raw') END",
    "region": "CASE WHEN p_partkey % 5 <> 0 THEN p_type END",
    "named": "concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' 2018' WHEN 1 THEN ' N.V.' WHEN 2 THEN ' nv ' WHEN 3 THEN ' 20181' ELSE ' 1918x' END)",
    "confidence": "(p_partkey * 13 % 100) / 100",
    "image": "CASE p_partkey % 4 WHEN 0 THEN '//img.example/a.png' WHEN 1 THEN ' https://img.example/fallback_1.png' WHEN 2 THEN '' END",
}
_LISTING = f"(coalesce(own, '') = '' AND coalesce(region, '') <> '' AND coalesce(lower(trim(label)) IN ({', '.join(repr(x) for x in profile.STYLE_LABELS)}), false))"
_URL = "CASE WHEN starts_with(trim({0}), '//') THEN 'https:' || trim({0}) WHEN trim({0}) <> '' THEN trim({0}) END"


@query("profile_fields", f"""WITH {_made(**_FIELDS)}
  SELECT p_partkey, coalesce(shown, raw, concat_ws(' ', nullif(coalesce(theirs, own), ''), nullif(label, ''))) AS name, coalesce(theirs, own) AS producer, label, region, {_URL.format('image')} AS image, CASE p_partkey % 3 WHEN 0 THEN 'Direct' WHEN 1 THEN 'Mapped' ELSE 'Inferred' END AS provenance,
    {_LISTING} AS listing, NOT {_LISTING} AND (confidence >= 0.68e0 OR (confidence >= 0.55e0 AND p_size % 2 = 0)) AS by_rule, CASE WHEN p_size % 3 = 0 THEN named ELSE trim(regexp_replace(named, '(?i)\\s+(?:(?:19|20)[0-9]{{2}}|N\\.?V\\.?)\\s*$', '')) END AS name_shown,
    coalesce(CASE WHEN {_URL.format('image')} NOT LIKE '%fallback%' THEN {_URL.format('image')} END, 'https://img.example/z.png') AS picked FROM m""")
def profile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = profile.filled(_parts(spark, sf_dir, **_FIELDS))
    none, c = F.lit(None).cast("string"), F.col
    external = {"name": c("shown"), "producer": c("theirs"), "label": none, "vintage": none, "region": none, "varietal": none, "image": c("image")}
    own = {"producer": c("own"), "label": c("label"), "vintage": c("vintage"), "region": c("region"), "varietal": c("varietal"), "raw_text": c("raw")}
    mode = F.when(c(_K) % 3 == 0, "direct").when(c(_K) % 3 == 1, "mapped").otherwise("inferred")
    listing = profile.is_style_listing(c("own"), c("region"), c("label"))
    df = df.select(_K, profile.profile_fields(external, own, mode).alias("f"), listing.alias("listing"), profile.admits_rules(c("confidence"), c("p_size") % 2 == 0, listing).alias("by_rule"), profile.name_for(c("named"), c("p_size") % 3 == 0).alias("name_shown"), profile.first_image(c("image"), F.lit("https://img.example/z.png"), placeholder="fallback").alias("picked"))
    return df.select(_K, "f.name", "f.producer", "f.label", "f.region", "f.image", "f.provenance", "listing", "by_rule", "name_shown", "picked")


_SEEN = {
    "status": "CASE p_size % 4 WHEN 0 THEN 'matched' WHEN 1 THEN 'low-confidence' WHEN 2 THEN 'unmatched' END",
    "mode": "CASE p_partkey % 3 WHEN 0 THEN 'inferred' WHEN 1 THEN 'direct' ELSE 'mapped' END",
    "sure": "CASE WHEN p_partkey % 4 = 0 THEN 0.0 ELSE 0.5 END",
    "state": "CASE p_partkey % 7 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'queued' WHEN 2 THEN 'processing' WHEN 3 THEN 'failed' WHEN 4 THEN 'canceled' WHEN 5 THEN 'completed' ELSE 'processing' END",
    "n_items": "CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END",
    "n_done": "p_partkey % 30",
}
_OBSERVED = "array_distinct(filter(array(IF(p_size % 2 = 0, 'body', NULL), IF(p_size % 3 = 0, 'tannin', NULL), 'acidity', 'acidity'), x -> x IS NOT NULL))"


@query("evidence_progress", f"""WITH {_made(**_SEEN)}, n AS (SELECT *, 1 + CAST(p_size % 2 = 0 AS INTEGER) + CAST(p_size % 3 = 0 AS INTEGER) AS seen, CASE WHEN state IN ('uploaded', 'queued') THEN 0 ELSE n_items END AS total FROM m)
  SELECT p_partkey, CASE WHEN mode = 'inferred' THEN 'Estimated fit' ELSE 'Taste fit' END AS fit, CASE WHEN mode = 'inferred' THEN 'Estimated style; bottle identity unverified' WHEN status = 'matched' THEN 'Bottle match' WHEN status = 'low-confidence' THEN 'Possible bottle match; verify label and vintage' ELSE 'No reliable bottle match' END AS identity,
    CASE WHEN mode = 'inferred' AND sure > 0 THEN 'Estimated from menu details' WHEN mode = 'inferred' THEN 'Insufficient style information' ELSE seen || '/4 taste dimensions available' END AS told, sure > 0 AND (mode = 'inferred' OR p_size % 2 = 0) AS body_usable,
    CASE WHEN state IN ('uploaded', 'queued') THEN 'Queued for processing' WHEN state = 'processing' AND total = 0 THEN 'Running OCR' WHEN state = 'processing' THEN 'Analyzing ' || least(n_done, total) || ' of ' || total || ' wines' WHEN state = 'failed' THEN 'Analysis failed'
      WHEN state = 'canceled' AND total > 0 THEN 'Analysis stopped at ' || least(n_done, total) || ' of ' || total || ' wines' WHEN state = 'canceled' THEN 'Analysis stopped' END AS title,
    CASE WHEN state <> 'completed' THEN least(n_done, total) END AS processed, CASE WHEN state <> 'completed' AND total > 0 THEN least(n_done, total) / total END AS fraction,
    CASE WHEN p_size % 4 = 0 AND n_items > 0 THEN CASE WHEN p_retailprice / n_items <= 2.5e0 THEN 'fair' WHEN p_retailprice / n_items <= 3.5e0 THEN 'average' ELSE 'steep' END END AS tier FROM n""")
def evidence_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = F.struct(F.col("mode").alias("source_mode"), F.col("sure").cast("double").alias("confidence"), F.expr(_OBSERVED).alias("observed"))
    df = _parts(spark, sf_dir, **_SEEN).withColumn("taste", seen)
    df = df.select(_K, profile.evidence(F.col("taste"), F.col("status")).alias("e"), profile.usable_dimension(F.col("taste"), "body").alias("body_usable"), profile.progress(F.col("state"), F.col("n_done"), F.col("n_items")).alias("p"), profile.undisputed_tier(F.col("p_retailprice"), F.col("n_items"), F.col("p_size") % 4).alias("tier"))
    return df.select(_K, "e.fit", "e.identity", F.col("e.taste").alias("told"), "body_usable", "p.title", "p.processed", "p.fraction", "tier")


_PAGE = {
    "code": "CASE p_size % 6 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 403 WHEN 3 THEN 404 END",
    "action": "CASE WHEN p_partkey % 9 = 0 THEN 'Challenge' END",
    "heading": "CASE p_partkey % 8 WHEN 0 THEN 'Access  Denied' WHEN 1 THEN 'Security check' WHEN 2 THEN 'Verify you are human' WHEN 3 THEN 'Accessdenied wines' ELSE p_name END",
    "body": "CASE p_partkey % 7 WHEN 0 THEN '<script src=\"https://a.token.awswaf.com/challenge.js\">' WHEN 1 THEN '<script async src=\"https://b.edge.sdk.awswaf.com/x/challenge.js\">' WHEN 2 THEN 'window.gokuProps = 1' ELSE '<p>ok</p>' END",
    "url": "CASE p_partkey % 4 WHEN 0 THEN ' example.org/a' WHEN 1 THEN 'HTTPS://example.org/explore?q=1' WHEN 2 THEN '' ELSE 'https://example.org/explored' END",
    "sources": "concat('a/', p_name, '.png 1x, b.png 2x,,  c.png')",
    "line": "CASE p_partkey % 6 WHEN 0 THEN 'a 1 b 2' WHEN 1 THEN 'xq zt 12' WHEN 2 THEN 'xq' WHEN 3 THEN '  ' WHEN 4 THEN 'xq why' ELSE p_name END",
    "average": "CASE p_size % 5 WHEN 0 THEN CAST(NULL AS DOUBLE) WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN CAST(-1 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) / 7 END",
    "n_ratings": "CASE p_size % 3 WHEN 0 THEN CAST(0 AS DOUBLE) ELSE CAST(p_size AS DOUBLE) + 0.5 END",
}
_RATED = "(average IS NOT NULL AND NOT isnan(average) AND average > 0 AND n_ratings > 0)"


@query("page_evidence", f"""WITH {_made(**_PAGE)}
  SELECT p_partkey, coalesce(code IN (401, 403), false) OR coalesce(action ILIKE '%challenge%', false) OR regexp_matches(heading, '(?i)\\b(?:access\\s+denied|captcha|security\\s+check|verify\\s+(?:that\\s+)?you\\s+are\\s+human)\\b') OR contains(body, 'gokuProps') OR (contains(body, 'challenge.js') AND NOT contains(body, '.edge.sdk.awswaf.com/')) AS blocked,
    CASE WHEN trim(url) = '' OR regexp_matches(trim(url), '(?i)^https?://') THEN trim(url) ELSE 'https://' || trim(url) END AS address, p_size % 2 = 0 AND p_size % 3 = 0 AND p_size % 5 <> 0 AS suspicious, p_size % 2 = 0 AND p_size % 3 = 0 AND p_size % 5 = 0 AND url ILIKE '%/explore?%' AS retry,
    array_to_string(list_reverse(list_filter(list_transform(string_split(sources, ','), lambda c: regexp_split_to_array(trim(c), '\\s+')[1]), lambda c: c <> '')), '|') AS images,
    len(regexp_extract_all(line, '[A-Za-z]{{2,}}')) = 0 OR (len(regexp_extract_all(line, '[A-Za-z]{{2,}}')) >= 2 AND len(list_filter(regexp_extract_all(line, '[A-Za-z]{{2,}}'), lambda t: regexp_matches(t, '(?i)[aeiouy]'))) = 0) AS noise,
    CASE WHEN {_RATED} THEN average WHEN p_size > 20 THEN p_size / 10.0e0 END AS rating, CASE WHEN {_RATED} THEN 'wine' WHEN p_size > 20 THEN 'vintage' END AS rating_source, CASE WHEN average IS NOT NULL AND NOT isnan(average) THEN CAST(greatest(1, least(5, floor(average + 0.5e0))) AS INTEGER) END AS scaled,
    CASE WHEN average IS NOT NULL AND NOT isnan(average) AND average >= 0 THEN CAST(floor(average + 0.5e0) AS BIGINT) END AS n_reviews, array_to_string(list_filter(string_split(p_name, ' '), lambda t: length(t) >= 4)[1:5], ' ') AS hint, 'v1:' || p_brand AS scoped,
    CASE p_size % 3 WHEN 0 THEN p_partkey WHEN 1 THEN NULL ELSE p_partkey + 2 END AS reviewed FROM m""")
def page_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    links, hits, none = c("p_size") % 2, c("p_size") % 3, c("p_size") % 5 == 0
    k = c(_K)
    reviews = F.array(F.struct((k + 1).alias("item_id")), F.struct(F.when(c("p_size") % 3 == 0, k).when(c("p_size") % 3 == 1, F.lit(None)).otherwise(k + 2).alias("item_id")), F.struct(k.alias("item_id")))
    own = profile.review_meta(reviews, F.when(c("p_size") % 3 == 2, k + 2).otherwise(k))
    df = _parts(spark, sf_dir, **_PAGE).select(
        _K, profile.access_blocked(c("code"), c("action"), c("heading"), c("body")).alias("blocked"), profile.with_scheme(c("url")).alias("address"), profile.suspicious_empty(links, hits, none).alias("suspicious"), profile.retry_zero_result(links, hits, none, c("url")).alias("retry"),
        F.array_join(profile.image_candidates(c("sources")), "|").alias("images"), profile.is_noise_line(c("line")).alias("noise"), profile.best_rating((c("average"), c("n_ratings")), (F.when(c("p_size") > 20, c("p_size") / 10), F.lit(3))).alias("r"),
        profile.structure_scale(c("average")).alias("scaled"), profile.review_count(c("average")).alias("n_reviews"), profile.note_hint(c("p_name")).alias("hint"), profile.scoped_key(F.lit("v1"), c("p_brand")).alias("scoped"), own["item_id"].alias("reviewed"),
    )
    return df.select(_K, "blocked", "address", "suspicious", "retry", "images", "noise", "r.rating", F.col("r.source").alias("rating_source"), "scaled", "n_reviews", "hint", "scoped", "reviewed")


_SCALE = "CAST(CASE WHEN {0} > 5 AND {0} = floor({0}) THEN greatest(1, least(5, floor(floor({0} / 2.0e0 + 0.5e0) + 0.5e0))) ELSE greatest(1, least(5, floor({0} + 0.5e0))) END AS INTEGER)"
_STORED = {"body": "p_size % 12", "acidity": "(p_partkey % 25) / 2.0e0", "tannin": "3", "sweetness": "1 + p_partkey % 5"}


@query("preference_state", f"""WITH {_made(**_STORED)}, s AS (SELECT *, {_SCALE.format('body')} AS b, {_SCALE.format('acidity')} AS a FROM m)
  SELECT p_partkey, b AS body, a AS acidity, b <> body OR a <> acidity AS migrated, p_size / 1000.0e0 AS weight, p_size % 2 = 0 AND p_partkey % 4 <> 0 AS same, CASE WHEN p_size % 3 = 0 THEN b ELSE 4 END AS merged,
    CASE WHEN p_size % 4 <> 0 THEN CAST({_SCALE.format('acidity')} AS INTEGER) ELSE 3 END AS seen_acidity, CASE WHEN p_size % 4 <> 0 AND p_size % 5 <> 0 THEN 'direct' ELSE 'mapped' END AS seen_mode, 0.8e0 * (4 - CAST(p_size % 4 = 0 AS INTEGER) - CAST(p_size % 5 = 0 AS INTEGER)) / 4 AS seen_confidence,
    (greatest(1, least(5, acidity)) - 1) / 4.0e0 AS ratio, greatest(0.0e0, least(1.0e0, acidity - 2)) AS third_star, CASE WHEN (p_size % 10) / 10.0e0 >= 0.75e0 THEN least(1.0e0, 0.82e0 + ((p_size % 10) / 10.0e0 - 0.75e0) * 0.72e0) ELSE greatest(0.0e0, 0.65e0 + ((p_size % 10) / 10.0e0 - 0.6e0) * (0.16e0 / (0.75e0 - 0.6e0))) END AS scaled,
    CASE WHEN (p_size % 10) / 10.0e0 >= 0.82e0 THEN 'matched' WHEN (p_size % 10) / 10.0e0 >= 0.65e0 THEN 'low-confidence' ELSE 'unmatched' END AS status, '$' || CASE WHEN p_retailprice = floor(p_retailprice) THEN format('{{:,}}', CAST(p_retailprice AS BIGINT)) ELSE printf('%,.2f', p_retailprice) END AS amount FROM s""")
def preference_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    df = _parts(spark, sf_dir, **_STORED)
    row = {d: c(d) for d in taste.DIMENSIONS} | {f"weight_{d}": c("p_size") for d in taste.DIMENSIONS}
    df = df.withColumn("s", profile.stored_preference(row))
    weights = F.struct(*[F.when(c(_K) % 4 != 0, F.lit(0.5)).alias(d) for d in taste.DIMENSIONS])
    mine = F.struct(*[F.when(c("p_size") % 2 == 0, F.lit(3)).alias(d) for d in taste.DIMENSIONS], weights.alias("weights"))
    other = F.struct(*[F.lit(3).alias(d) for d in taste.DIMENSIONS], F.struct(*[F.lit(0.5).alias(d) for d in taste.DIMENSIONS]).alias("weights"))
    merged = profile.merged_preference({d: F.when(c("p_size") % 3 == 0, c("s")[d]) for d in taste.DIMENSIONS}, {d: F.lit(4) for d in taste.DIMENSIONS})
    seen = taste.observed_taste({"body": F.lit(2), "acidity": F.when(c("p_size") % 4 != 0, c("acidity")), "tannin": F.when(c("p_size") % 5 != 0, F.lit(2)), "sweetness": F.lit(1)}, F.lit("direct"), F.lit(0.8))
    share = c("p_size") % 10 / 10
    return df.select(
        _K, c("s.body").alias("body"), c("s.acidity").alias("acidity"), c("s.migrated").alias("migrated"), c("s.weights.body").alias("weight"), profile.same_preference(mine, other).alias("same"), merged["body"].alias("merged"),
        seen["acidity"].alias("seen_acidity"), seen["source_mode"].alias("seen_mode"), seen["confidence"].alias("seen_confidence"), display.indicator_ratio(c("acidity")).alias("ratio"), display.star_fill(c("acidity"), 3).alias("third_star"),
        taste.match_scale(share).alias("scaled"), taste.status_of(share).alias("status"), display.money(c("p_retailprice")).alias("amount"),
    )


@query("cue_order", """WITH m AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a' END AS i0, CASE WHEN p_size % 3 = 0 THEN 'b' END AS i1, CASE WHEN p_size % 5 = 0 THEN 'c' END AS i2, p_partkey % 4 AS n, CASE p_size % 6 WHEN 0 THEN 'Red-Fruit' WHEN 1 THEN 'dried-fruit' WHEN 2 THEN 'yeast' WHEN 3 THEN 'green-herbs' WHEN 4 THEN 'oak-spice' ELSE 'other' END AS key FROM part),
  f AS (SELECT *, CASE WHEN n < 3 OR i1 IS NOT NULL OR (i0 IS NULL AND i2 IS NULL) THEN ['x', 'y', 'z'] WHEN i0 IS NOT NULL THEN ['y', 'x', 'z'] ELSE ['x', 'z', 'y'] END AS o FROM m)
  SELECT p_partkey, array_to_string(o[1:n], '') AS cues, CASE lower(key) WHEN 'red-fruit' THEN 'red-fruit' WHEN 'dried-fruit' THEN 'tree-fruit' WHEN 'yeast' THEN 'yeasty' WHEN 'green-herbs' THEN 'earth' WHEN 'oak-spice' THEN 'spices' END AS family FROM f""")
def cue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    cue = lambda name, every, image: F.struct(F.lit(name).alias("keyword"), F.when(size % every == 0, F.lit(image)).alias("image"))
    cues = F.slice(F.array(cue("x", 2, "a"), cue("y", 3, "b"), cue("z", 5, "c")), F.lit(1), (F.col(_K) % 4).cast("int"))
    key = F.when(size % 6 == 0, "Red-Fruit").when(size % 6 == 1, "dried-fruit").when(size % 6 == 2, "yeast").when(size % 6 == 3, "green-herbs").when(size % 6 == 4, "oak-spice").otherwise("other")
    return table(spark, sf_dir, "part").select(_K, F.array_join(F.transform(profile.centred_cues(cues), lambda x: x["keyword"]), "").alias("cues"), profile.family(key).alias("family"))


@query("retry_plans", """SELECT event_id, 2000 * CAST(power(2, event_id % 5) AS BIGINT) AS backoff_ms, 5 + least(20, 5 * (event_id % 8)) AS delay_s, event_id % 4 AS slot, least(event_id % 25, 10) AS workers, event_id % 6 < 2 AS hands_off,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'already terminal' WHEN event_id % 2 = 0 THEN 'still running' WHEN event_id % 3 > 0 THEN 'delivered' WHEN value < 50 THEN 'too recent' ELSE 'stalled' END AS reason FROM events""")
def retry_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    status = F.when(c("event_type") == "purchase", "completed").when(c("event_type") == "error", "failed").otherwise("processing")
    plan = jobs.recovery_plan(status, c("event_id") % 3, c("event_id") % 2 == 1, c("value"), 50)
    return table(spark, sf_dir, "events").select("event_id", jobs.backoff_ms(c("event_id") % 5).alias("backoff_ms"), jobs.retry_delay_s(c("event_id") % 8).alias("delay_s"), jobs.pool_slot(c("event_id"), 4).alias("slot"), jobs.worker_count(c("event_id") % 25).alias("workers"), jobs.hands_off(c("event_id") % 6).alias("hands_off"), plan["reason"].alias("reason"))


@query("candidates_with_recommendations", "SELECT o_orderkey, o_orderdate, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity > 45 GROUP BY ALL")
def candidates_with_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.with_results(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), done, ["o_orderkey"], F.col("o_orderkey"))
