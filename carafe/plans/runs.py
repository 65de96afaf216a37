"""Queries over recognised texts, reading order, stopped runs and ordered progress; inputs are made from the tables by expressions that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, layout, recognition
from . import lines as L
from . import menus as M
from .queries import query, table

# three recognitions of each menu: as it is, with noise in some lines, without some lines; in some menus all alike, or one of them blank
_VARIANT = f"""CASE WHEN p_partkey div 7 % 6 = 0 THEN {M.LINE} WHEN p_partkey div 7 % 6 = v + 1 THEN '  ' WHEN v = 0 THEN CASE WHEN p_partkey % 8 = 3 THEN concat('xkr ', 'bdf ', {M._W}) ELSE {M.LINE} END WHEN v = 1 THEN CASE WHEN p_partkey % 5 = 0 THEN 'xkr bdf tlmn' ELSE {M.LINE} END
  ELSE CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE {M.LINE} END END"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("v", F.explode(F.array(*map(F.lit, range(3)))))
    rows = p.select(F.expr("p_partkey div 7").alias("page_id"), "v", F.col("p_size").cast("long").alias("s"), F.col("p_partkey").alias("p"), F.expr(_VARIANT).alias("line"))
    told = rows.where("line is not null").groupBy("page_id", F.col("v").alias("variant")).agg(F.array_sort(F.collect_list(F.struct("s", "p", "line"))).alias("l"))
    return told.select("page_id", "variant", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


_RAW = f"raw AS (SELECT p_partkey // 7 * 3 + v AS doc, CAST(p_size AS BIGINT) AS s, p_partkey AS p, {_VARIANT.replace(' div ', ' // ')} AS line FROM part, (VALUES (0), (1), (2)) AS t(v)), "
_NOISE = "(len(regexp_extract_all(line, '[A-Za-z]{2,}')) = 0 OR (len(regexp_extract_all(line, '[A-Za-z]{2,}')) >= 2 AND len(list_filter(regexp_extract_all(line, '[A-Za-z]{2,}'), lambda w: regexp_matches(w, '(?i)[aeiouy]'))) = 0))"


@query("recognition_choice", f"""WITH RECURSIVE {_RAW}{M._ALL[M._ALL.index('clean AS'):]}, {M._FACTS}, {M._BLOCKS}, {M._FIELDS}, {M._SCORED},
  found AS (SELECT doc, CAST(sum(CAST(confidence AS DECIMAL(18, 2))) AS DOUBLE) AS sure, count(*) AS n, count(section) AS headed FROM h4 WHERE regexp_matches(t, '\\pL') AND NOT (tq < 0.28e0 AND nq < 0.3e0 AND signals < 2) AND confidence >= {L.quality.ACCEPTED} GROUP BY doc),
  trimmed AS (SELECT doc, s, p, line AS whole, trim(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) AS line FROM raw WHERE line IS NOT NULL),
  counted AS (SELECT doc, count(*) FILTER (line <> '' AND {_NOISE}) AS noise, count(*) FILTER (line <> '' AND regexp_matches(line, '(?:^|[\\s:/])\\$?[0-9]{{1,3}}(?:\\.[0-9]{{2}})?\\s*$')) AS priced, count(*) FILTER (line <> '') AS n_lines, string_agg(whole, chr(10) ORDER BY s, p, whole) AS text FROM trimmed GROUP BY doc),
  worth AS (SELECT doc // 3 AS page_id, CAST(doc % 3 AS INTEGER) AS variant, text, CASE WHEN n_lines > 0 THEN round(coalesce(sure, 0.0e0) + coalesce(n, 0) * 0.35e0 + priced * 0.2e0 + coalesce(headed, 0) / greatest(coalesce(n, 0), 1) * 0.01e0 - noise * 0.18e0, 9) ELSE CAST('-inf' AS DOUBLE) END AS score FROM counted LEFT JOIN found USING (doc))
  SELECT page_id, variant, md5(text) AS text_md5, round(CASE WHEN isinf(score) THEN NULL ELSE score END, 6) AS score, (SELECT md5(string_agg(o.text, chr(30) ORDER BY o.variant)) FROM worth o WHERE o.page_id = worth.page_id AND o.variant <> worth.variant) AS alternates_md5 FROM worth QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, variant) = 1""")
def recognition_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of three recognitions of each written menu."""
    best = recognition.best_variants(variants(spark, sf_dir), as_of_year=M.AS_OF)
    return best.select("page_id", "variant", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.round(F.when(F.col("score") > float("-inf"), F.col("score")), 6).alias("score"), F.when(F.size("alternates") > 0, F.md5(F.array_join("alternates", "\x1e").cast("binary"))).alias("alternates_md5"))


# words of a tilted photograph: lines 0.02 apart, and up to 0.012 lower from left to right
_Y, _X = "1.0D - 0.02D * l_linenumber - 0.012D * (l_suppkey % 50) / 50", "(l_suppkey % 50) / 50.0D"


@query("reading_order", f"""WITH w AS (SELECT l_orderkey, l_partkey, l_linenumber, {_Y.replace('D', 'e0')} AS y, {_X.replace('D', 'e0')} AS x, l_quantity FROM lineitem),
  d AS (SELECT *, CASE WHEN lag(y) OVER down - y <= 0.015e0 THEN 0 ELSE 1 END AS fresh FROM w WINDOW down AS (PARTITION BY l_orderkey ORDER BY y DESC, x, l_partkey, l_quantity)),
  l AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY y DESC, x, l_partkey, l_quantity ROWS UNBOUNDED PRECEDING) - 1 AS line FROM d)
  SELECT l_orderkey, l_partkey, l_quantity, CAST(line AS BIGINT) AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY line, x, y DESC, l_partkey, l_quantity) - 1 AS place FROM l""")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of written photographs in reading order."""
    words = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", F.expr(_Y).alias("y"), F.expr(_X).alias("x"))
    return layout.reading_lines(words, ["l_orderkey"], "y", "x", 0.015, "l_partkey", "l_quantity").select("l_orderkey", "l_partkey", "l_quantity", F.col("line").cast("long"), F.col("place").cast("long"))


_JOB = {"job_id": "o_orderkey", "status": "CASE WHEN o_orderkey % 31 = 0 THEN 'completed' WHEN o_orderkey % 31 = 1 THEN 'failed' WHEN o_orderkey % 31 = 2 THEN 'processing' ELSE 'queued' END", "worker_count": "o_orderkey % 3", "message_id": "concat('j', o_orderkey)", "updated_at": "o_orderdate"}
_ASKED = "CASE o_orderkey % 9 WHEN 0 THEN concat('w', o_orderkey, '-1') WHEN 1 THEN 'other' ELSE concat('j', o_orderkey) END"
_WORKER = {"job_id": "o_orderkey", "status": "CASE WHEN o_orderkey % 17 = 3 AND i = 1 THEN 'processing' ELSE 'queued' END", "message_id": "concat('w', o_orderkey, '-', i)"}
_WORK = {"job_id": "l_orderkey", "status": "CASE WHEN l_orderkey % 16 = 3 AND l_returnflag = 'A' THEN 'completed' WHEN l_orderkey % 16 = 4 AND l_returnflag = 'R' THEN 'failed' WHEN l_orderkey % 16 = 5 THEN 'processing' ELSE 'queued' END", "attempts": "CASE WHEN l_orderkey % 14 = 2 THEN l_linenumber - 1 ELSE 0 END", "owner": "CASE WHEN l_orderkey % 23 = 4 AND l_linenumber = 1 THEN 'w1' END"}


def _columns(of: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in of.items())


@query("stopped_runs", f"""WITH job AS (SELECT {_columns(_JOB)} FROM orders WHERE o_orderkey % 37 <> 5), asked AS (SELECT o_orderkey AS job_id, {_ASKED} AS message_id FROM orders), worker AS (SELECT {_columns(_WORKER)} FROM orders, unnest(range(1, o_orderkey % 3 + 1)) AS u(i) WHERE NOT (o_orderkey % 19 = 5 AND i = 2)),
  work AS (SELECT {_columns(_WORK)} FROM lineitem), letter AS (SELECT {_ASKED} AS message_id, CASE WHEN o_orderkey % 29 = 7 THEN o_orderkey + 1 ELSE o_orderkey END AS job_id FROM orders WHERE o_orderkey % 8 <> 3),
  w AS (SELECT job_id, count(*) AS n_worker, count(*) FILTER (status <> 'queued') AS n_worker_started, list(message_id) AS messages FROM worker GROUP BY job_id), k AS (SELECT job_id, count(*) FILTER (status <> 'queued' OR attempts > 0 OR owner IS NOT NULL) AS n_started, count(owner) AS n_leased, count(*) FILTER (status IN ('completed', 'failed')) AS n_done FROM work GROUP BY job_id),
  r AS (SELECT l_orderkey AS job_id, count(*) AS n_result FROM lineitem WHERE l_orderkey % 21 = 0 AND l_quantity > 40 GROUP BY ALL), ids AS (SELECT job_id FROM asked UNION SELECT job_id FROM work),
  e AS (SELECT i.job_id, j.job_id IS NOT NULL AS known, j.status, j.updated_at, j.worker_count, a.message_id, coalesce(n_worker, 0) AS n_worker, coalesce(n_worker_started, 0) AS n_worker_started, coalesce(n_started, 0) AS n_started, coalesce(n_leased, 0) AS n_leased, coalesce(n_done, 0) AS n_done, coalesce(n_result, 0) AS n_result,
    coalesce(a.message_id = j.message_id OR list_contains(messages, a.message_id), false) AS message_known, EXISTS (SELECT 1 FROM letter WHERE letter.message_id = a.message_id) AS lettered, EXISTS (SELECT 1 FROM letter WHERE letter.message_id = a.message_id AND letter.job_id = i.job_id) AS fits
    FROM ids i LEFT JOIN job j ON j.job_id = i.job_id LEFT JOIN asked a ON a.job_id = i.job_id LEFT JOIN w ON w.job_id = i.job_id LEFT JOIN k ON k.job_id = i.job_id LEFT JOIN r ON r.job_id = i.job_id)
  SELECT CAST(job_id AS VARCHAR) AS job_id, n_worker, n_worker_started, n_started, n_leased, n_done, n_result, message_known, coalesce(NOT coalesce(status IN ('completed', 'failed', 'canceled'), false) AND epoch(TIMESTAMP '2001-08-01 00:00:00') - epoch(updated_at) >= 86400, false) AS paused,
    CASE WHEN NOT known THEN 'no record' WHEN status NOT IN ('queued', 'processing') THEN 'already ended' WHEN n_result > 0 THEN 'has results' WHEN n_leased > 0 THEN 'leased' WHEN n_done > 0 THEN 'has progress' WHEN n_worker <> worker_count THEN 'workers missing' WHEN n_worker_started > 0 THEN 'worker started' WHEN n_started > 0 THEN 'work started' WHEN NOT message_known THEN 'other message' WHEN NOT lettered THEN 'may still be delivered' WHEN NOT fits THEN 'letter of another job' END AS reason FROM e""")
def stopped_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence about runs made from orders and their lines, and whether they may be recovered."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    of = lambda df, columns: df.select(*[F.expr(e).alias(n) for n, e in columns.items()])
    workers = o.withColumn("i", F.explode(F.expr("case when o_orderkey % 3 > 0 then sequence(1L, o_orderkey % 3) else array() end"))).where("not (o_orderkey % 19 = 5 and i = 2)")
    asked = o.select(F.col("o_orderkey").alias("job_id"), F.expr(_ASKED).alias("message_id"))
    letters = o.where("o_orderkey % 8 <> 3").select(F.expr(_ASKED).alias("message_id"), F.expr("case when o_orderkey % 29 = 7 then o_orderkey + 1 else o_orderkey end").alias("job_id"))
    results = line.where("l_orderkey % 21 = 0 and l_quantity > 40").select(F.col("l_orderkey").alias("job_id"))
    found = evidence.recovery(evidence.stopped_evidence(asked, of(o.where("o_orderkey % 37 <> 5"), _JOB), of(workers, _WORKER), of(line, _WORK), results, letters))
    paused = evidence.polling_paused(F.col("status"), F.col("updated_at"), F.lit("2001-08-01 00:00:00").cast("timestamp"), 86_400)
    return found.select("job_id", "n_worker", "n_worker_started", "n_started", "n_leased", "n_done", "n_result", "message_known", paused.alias("paused"), "reason")


@query("ordered_progress", """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place, event_id * 7919 % 10007 AS arrival, event_id FROM events),
  f AS (SELECT user_id, place, arrival FROM e WHERE event_id % 1009 <> 5 AND user_id IS NOT NULL)
  SELECT user_id, place, arrival, count(*) OVER (PARTITION BY user_id ORDER BY arrival RANGE UNBOUNDED PRECEDING) AS done, CASE WHEN count(*) OVER (PARTITION BY user_id ORDER BY place ROWS UNBOUNDED PRECEDING) = place + 1 THEN max(arrival) OVER (PARTITION BY user_id ORDER BY place ROWS UNBOUNDED PRECEDING) END AS released FROM f""")
def ordered_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each of a user's events can be given out in order, if they arrive in another order and some never do."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long") - 1).withColumn("arrival", F.col("event_id") * 7919 % 10007)
    return evidence.released_in_order(e.where("event_id % 1009 <> 5"), "user_id", "place", "arrival")
