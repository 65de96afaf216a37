"""Dedupe, carrying forward, chains and memory: operators over keyed, ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed value: days for which a match is remembered.
MEMORY_DAYS = 30


def best_per_key(df: DataFrame, keys: list[str], order: Column, most: bool) -> DataFrame:
    """The row of each key with the largest (or least) order; an aggregation, so that a hot key is reduced before the shuffle."""
    pick = F.max_by if most else F.min_by
    whole = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    return df.groupBy(*keys).agg(pick(whole, order).alias("_row")).select(*keys, "_row.*").select(*df.columns)


def keep_last(df: DataFrame, keys: list[str], pos: Column) -> DataFrame:
    return best_per_key(df, keys, pos, True)


def keep_first(df: DataFrame, keys: list[str], pos: Column) -> DataFrame:
    return best_per_key(df, keys, pos, False)


def without_priceless_twins(items: DataFrame, keys: list[str], price_col: str) -> DataFrame:
    """Unpriced rows go if a priced row has the same keys (nulls equal nulls)."""
    priced = items.where(F.col(price_col).isNotNull()).select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)]).distinct()
    same = F.col(price_col).isNull()
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_p{i}"))
    return items.join(priced, same, "left_anti")


def carried_forward(df: DataFrame, keys: list[str], pos: Column, marker: Column, value: Column, out: str) -> DataFrame:
    """The value at the latest row where ``marker`` holds, which may be null: a reset."""
    seen = F.last(F.when(marker, F.struct(value.alias("v"))), ignorenulls=True)
    return df.withColumn(out, seen.over(Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0))["v"])


def next_nonempty(lines: DataFrame, keys: list[str], pos: str, line: str, out: str) -> DataFrame:
    """Non-empty lines with the line after each."""
    return lines.where(F.col(line) != "").withColumn(out, F.lead(line).over(Window.partitionBy(*keys).orderBy(pos)))


def gap_bands(df: DataFrame, keys: list[str], start: Column, end: Column, wanted: Column, most: float, out: str, order: list[Column]) -> DataFrame:
    """Numbers runs of wanted rows whose gap to the row before is at most ``most``; other rows get null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    breaks = F.when(wanted & F.coalesce(F.lag(wanted).over(w) & (start - F.lag(end).over(w) <= most), F.lit(False)), 0).otherwise(1)
    cut = df.withColumn("_break", breaks)
    return cut.withColumn(out, F.when(wanted, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_break")


def first_accepted(results: DataFrame, keys: list[str], provider_rank: Column, score: Column, matched: Column, *ties: Column) -> DataFrame:
    """A chain of providers: of those up to the first match, the best score, the earlier provider on ties, then the largest ``ties``."""
    stop = results.where(matched).groupBy(*keys).agg(F.min(provider_rank).alias("_stop"))
    tried = results.join(stop, keys, "left").where(F.col("_stop").isNull() | (provider_rank <= F.col("_stop"))).drop("_stop")
    return best_per_key(tried, keys, F.struct(score, -provider_rank, *ties), True)


def ordered_fold_best(df: DataFrame, keys: list[str], pos: Column, rank: Column, score: Column, payload: Column) -> DataFrame:
    """The kept row of an order-dependent choice: a later row replaces the kept one if its rank is higher, or equal with a higher score;
    it then keeps the larger of both scores. Gives keys, payload, rank, score. Rows of one key are gathered: use it on bounded keys."""
    item = F.struct(pos.alias("pos"), rank.alias("rank"), score.cast("double").alias("score"), payload.alias("payload"))
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_rows"))

    def step(kept: Column, x: Column) -> Column:
        better = kept.isNull() | (x["rank"] > kept["rank"]) | ((x["rank"] == kept["rank"]) & (x["score"] > kept["score"]))
        return F.when(better, F.struct(x["pos"].alias("pos"), x["rank"].alias("rank"), F.greatest(x["score"], kept["score"]).alias("score"), x["payload"].alias("payload"))).otherwise(kept)

    kept = F.aggregate(F.slice("_rows", 2, F.greatest(F.size("_rows"), F.lit(1))), F.get("_rows", F.lit(0)), step)
    return rows.select(*keys, kept.alias("_k")).select(*keys, "_k.payload", "_k.rank", "_k.score")


def memory_key(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), 256)


def remembered(df: DataFrame, memory: DataFrame, key: str, value: str, fresh: Column, out: str) -> DataFrame:
    """A memo read: the remembered value of the key, else the fresh one."""
    known = memory.select(F.col(key).alias("_key"), F.col(value).alias("_known"))
    return df.join(known, F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce("_known", fresh)).drop("_key", "_known")


def memories(matches: DataFrame, key: str, matched: Column, at: Column, days: int = MEMORY_DAYS) -> DataFrame:
    """A memo write: the latest hit of each key with the time until which it holds; misses are never kept."""
    hits = matches.where(matched).withColumn("held_until", at + F.make_dt_interval(F.lit(days)))
    return best_per_key(hits, [key], F.col("held_until"), True)


def held(rows: DataFrame, until: Column, now: Column) -> DataFrame:
    """Rows that haven't expired; those without an end stay."""
    return rows.where(until.isNull() | (until > now))


def not_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(done.select(*keys), keys, "left_anti")


def with_results(candidates: DataFrame, results: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Candidates that have a result, in their own order."""
    return candidates.join(results, keys).orderBy(order)
