"""Queries over stored records, memory and sections. JSON texts are made from the tables once; each engine reads them by its own means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, records, taste
from ..operators import keyed, matching, ranking
from .queries import RECS, query, recommendations, table

# The same text in both dialects: older records lack fields, every 13th can't be read.
_STORED = {
    "cands": """CASE WHEN p_partkey % 13 = 0 THEN '{not json' WHEN p_partkey % 5 = 0 THEN NULL ELSE concat('[{"id":"c', p_partkey, '","rawText":"', p_name, '","confidence":0.5', CASE WHEN p_partkey % 2 = 0 THEN concat(',"price":"$', p_size, '","menuTab":"', p_brand, '"') ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN ',"vintage":2018,"region":null,"later":[1]' ELSE '' END, '}]') END""",
    "recs": """concat('[{"candidateId":"c', p_partkey, '","fitScore":', p_size, ',"matchConfidence":0.7', CASE WHEN p_partkey % 4 = 0 THEN ',"profile":null' ELSE concat(',"profile":{"name":"', p_name, '","taste":{"body":', p_size % 11, ',"acidity":', p_partkey % 11, ',"tannin":', p_size % 9, '.5,"sweetness":2,"sourceMode":"mapped"}}') END, '}]')""",
    "side": """CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'oops' WHEN 2 THEN '{}' ELSE concat('{"mimeType":"image/png","sourceUrl":"https://example.org/', p_partkey, '","more":1}') END""",
}
_AT = "CASE WHEN json_valid({0}) THEN json_extract_string({0}, '{1}') END"
_SCALED = "CAST(CASE WHEN {0} > 5 AND {0} = floor({0}) THEN greatest(1, least(5, floor(floor({0} / 2 + 0.5e0) + 0.5e0))) ELSE greatest(1, least(5, floor({0} + 0.5e0))) END AS INTEGER)"
_DIMENSION = {d: _SCALED.format(f"CAST(json_extract_string(recs, '$[0].profile.taste.{d}') AS DOUBLE)") for d in taste.DIMENSIONS}


@query("stored_analyses", f"""WITH m AS (SELECT p_partkey, {", ".join(f"{e} AS {n}" for n, e in _STORED.items())} FROM part)
  SELECT p_partkey, {", ".join(f"{_AT.format('cands', '$[0].' + k)} AS {n}" for k, n in (("id", "id"), ("rawText", "raw_text"), ("price", "price"), ("menuTab", "menu_tab"), ("region", "region"), ("notes", "notes")))}, CAST({_AT.format('cands', '$[0].vintage')} AS INTEGER) AS vintage,
    json_extract_string(recs, '$[0].candidateId') AS candidate_id, CAST(json_extract_string(recs, '$[0].fitScore') AS DOUBLE) AS fit_score, json_extract_string(recs, '$[0].profile.name') AS profile, {", ".join(f"CASE WHEN json_extract_string(recs, '$[0].profile.name') IS NOT NULL THEN {e} END AS {d}" for d, e in _DIMENSION.items())}, {_AT.format('side', '$.mimeType')} AS mime_type, {_AT.format('side', '$.sourceUrl')} AS source_url FROM m""")
def stored_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(e).alias(n) for n, e in _STORED.items()])
    read = made.select("p_partkey", F.get(records.decoded_candidates(F.col("cands")), F.lit(0)).alias("c"), F.get(records.decoded_recommendations(F.col("recs")), F.lit(0)).alias("r"), records.sidecar(F.col("side")).alias("s"))
    return read.select("p_partkey", *[f"c.{f}" for f in ("id", "raw_text", "price", "menu_tab", "region", "notes", "vintage")], "r.candidate_id", "r.fit_score", F.col("r.profile.name").alias("profile"), *[F.col(f"r.profile.taste.{d}").alias(d) for d in taste.DIMENSIONS], "s.mime_type", "s.source_url")


_TEXTS = {
    "label": "CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat(p_name, ' Côtes - du  RHÔNE') END",
    "raw": "CASE p_partkey % 5 WHEN 0 THEN '' ELSE concat(p_name, ', Cotes du Rhone 2018, ', p_type, ' Cotesdu rhone') END",
    "region": "CASE p_partkey % 3 WHEN 0 THEN 'Côtes-du-Rhône' WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN ' -' END END",
}
_PLAIN = "lower(strip_accents(coalesce({0}, '')))"
_PATTERN = "concat('\\b', array_to_string(regexp_extract_all(" + _PLAIN.format("region") + ", '[a-z0-9]+'), '[^a-z0-9]+'), '\\b')"
_BARE = "CASE WHEN len(regexp_extract_all(" + _PLAIN.format("region") + ", '[a-z0-9]+')) = 0 THEN " + _PLAIN + " ELSE regexp_replace(" + _PLAIN + ", " + _PATTERN + ", ' ', 'g') END"


@query("identity_texts", f"""WITH m AS (SELECT p_partkey, {", ".join(f"{e} AS {n}" for n, e in _TEXTS.items())} FROM part)
  SELECT p_partkey, {_BARE.format("concat_ws(' ', nullif(label, ''), nullif(raw, ''))")} AS told, {_BARE.format("coalesce(nullif(raw, ''), nullif(label, ''))")} AS raw_only FROM m""")
def identity_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(e).alias(n) for n, e in _TEXTS.items()])
    told = lambda only: identity.menu_identity_text(F.col("label"), F.col("raw"), F.col("region"), only)
    return made.select("p_partkey", told(False).alias("told"), told(True).alias("raw_only"))


@query("cuvee_producers", """SELECT p_type, count(DISTINCT CASE WHEN regexp_matches(p_name, '(?i)\\bwidget\\b') THEN lower(p_brand) END) AS n_producers FROM part GROUP BY p_type""")
def cuvee_producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "part").withColumn("cuvee", F.array(F.lit("widget")))
    return matching.producers_with_cuvee(hits, ["p_type"], "cuvee", "p_brand", "p_name")


@query("match_memory", """WITH h AS (SELECT user_id, max(ts) AS last FROM events WHERE event_type = 'purchase' GROUP BY user_id)
  SELECT user_id, strftime(last + INTERVAL 30 DAY, '%Y-%m-%d %H:%M:%S') AS held_until FROM h WHERE last + INTERVAL 30 DAY > (SELECT max(ts) FROM events)""")
def match_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    kept = keyed.memories(events, "user_id", F.col("event_type") == "purchase", F.col("ts"))
    return keyed.held(kept, F.col("held_until"), now.scalar()).select("user_id", F.date_format("held_until", "yyyy-MM-dd HH:mm:ss").alias("held_until"))


@query("section_choice", f"""WITH {RECS} SELECT 'there' AS asked, candidate_id FROM fits WHERE p_brand = 'Brand#13' AND p_type = 'PROMO' UNION ALL SELECT 'empty', candidate_id FROM fits""")
def section_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = recommendations(spark, sf_dir)
    pick = lambda asked, chosen: ranking.in_section(recs, chosen).select(F.lit(asked).alias("asked"), "candidate_id")
    return pick("there", "Brand#13:::PROMO").unionByName(pick("empty", "nowhere:::"))


@query("hidden_counts", f"WITH {RECS} SELECT count(*) FILTER (source_mode = 'inferred') AS by_profile, count(*) FILTER (source_mode <> 'inferred' AND amount > 1000) AS by_price, count(*) FILTER (source_mode <> 'inferred' AND (amount IS NULL OR amount <= 1000)) AS shown FROM fits")
def hidden_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.hidden_counts(recommendations(spark, sf_dir), 1000.0, True)
