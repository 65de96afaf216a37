"""Session helpers: durable lineage cuts, shuffle width, size-checked broadcasts, distributed ranks and components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the cluster sizes to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, else the context's checkpoint folder; one of our own if neither is set in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="carafe-checkpoint-"))
    return named or sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; the files survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder. Unlike a checkpoint it forgets how its rows are dealt, so a join over it has an
    exchange that adaptive execution can split, and Spark knows its size when it picks the join."""
    path = f"{shared_folder(df.sparkSession)}/carafe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def one_row_per_document(df: DataFrame, id_col: str) -> DataFrame:
    """Rows with a usable id. Null ids can't be carried in results and are left out by contract."""
    return df.where(F.col(id_col).isNotNull())


def rows_by_id(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Rows of ``docs``, all columns whatever their names, whose id is ("left_semi") or isn't ("left_anti") in the one column of ``ids``."""
    wide = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    ident = F.col(f"c{docs.columns.index(id_col)}").cast("long")
    return wide.join(ids.toDF("wanted"), ident == F.col("wanted"), how).toDF(*docs.columns)


def bucket_rank(df: DataFrame, keys: list[str], salt: Column, order: list[Column], out: str) -> DataFrame:
    """Gapless 0-based rank of rows in each key, without ever sorting one key in one task.

    Counts by (key, salt) give each salt its first rank and a window in (key, salt) the rest, so the rows of one salt bound a task. The
    order is by salt, then by ``order``.
    """
    salted = df.withColumn("_salt", salt)
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(starts, [*keys, "_salt"]).withColumn(out, (F.col("_from") + F.col("_rank")).cast("long")).drop("_salt", "_from", "_rank")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row (id, component) for every id in an edge, component the least id.

    Alternating large-star and small-star steps (Kiveris et al., 2014) as joins and partial aggregations. Nothing is
    gathered on the driver but two numbers a round. Both sides of each join are written tables, so that adaptive execution can split the rows of
    an id with very many links, or broadcast a side it knows to be small. Self links and repeated links are harmless. Empty input gives an
    empty result.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = written(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
