"""Readers of uploads, pages, texts and recognition output; everything goes through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SCHEMA = "level int, page int, block int, paragraph int, line int, word int, left int, top int, width int, height int, conf double, text string"


def source_type(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".pdf"), "upload-pdf").when(low.endswith(".txt"), "client-ocr-text").otherwise("upload-image")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """path, source_type, content: files as they are."""
    return spark.read.format("binaryFile").load(path).select("path", source_type(F.col("path")).alias("source_type"), "content")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text: one row per file; files without text are left out."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("text"))
    return read.where("text <> ''")


def pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html of web addresses that can be read as pages."""
    from ..operators.html import fetchable

    return spark.read.parquet(path).where(fetchable(F.col("url")))


def recognised_words(spark: SparkSession, path: str) -> DataFrame:
    """Words with places from tab-separated recognition output, with or without a heading row."""
    read = spark.read.csv(path, sep="\t", schema=WORD_SCHEMA, quote="", mode="PERMISSIVE")
    return read.where("level is not null")
