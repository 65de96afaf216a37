"""Line dedup with a log-template tree, in DataFrame operations only.

A line is parsed to a fixed depth: token count, then ``lead`` leading tokens, then the other tokens in ``SEGMENTS`` equal runs.
Tokens with a digit are variable fields (``<*>``). A leaf is the whole path; in lines of ``MIN_WILD`` tokens or more each
path also has one variant for each run with that run as ``<*>``, so lines that differ in one field region (a
quarter of the tokens at most) meet in one template. In shorter lines only fields with a digit are generalised. Templates in ``min_docs`` or more documents recur (documents with equal
texts count once, so that copies are left to document-level dedup); all their lines but the first (least id, then place)
are dropped from the text, or all with ``keep_first=False``.

Scale. Lines become 64-bit template keys; a partial aggregation by key leaves those that occur often enough, so a line in a third
of all documents is one row a task. Only their places are kept (in joins over written tables, which adaptive execution can split), and the
exact count of documents and the first place are taken from these, by key and text before by key. The text itself is shuffled once, to meet its dropped places.

Defined results: a null text stays null, an empty one empty. Lines with fewer than ``min_tokens`` tokens stay. White space around and runs
of it inside lines don't count for templates; kept lines stay as they are. Rows equal in id and text are one document to the
counts, and each comes out. Null ids take part as an id of their own, before all others. An empty table gives an empty result.
All other
columns pass through, whatever their names; one called ``n_lines_dropped`` is replaced by the count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import written

COUNT = "n_lines_dropped"
SEGMENTS = 4
MIN_WILD = 8
WILD = "<*>"
_VARIABLE = r"(?<!\S)[^\s\d]*+\d\S*"


def with_template_keys(lines: DataFrame, line: str, lead: int, min_tokens: int) -> DataFrame:
    """Adds ``_n`` (tokens) and ``_keys``: the line's own path, and the variants with one wildcard run (null if too short).

    Each step is a column of its own, so that a line is masked and split once.
    """
    raw, n = F.col(line), F.col("_n")
    tidy = F.when(raw.rlike(r"\s\s|[\t\x0B\f\r]|^\s|\s$"), F.trim(F.regexp_replace(raw, r"\s+", " "))).otherwise(raw)
    out = lines.withColumn("_tidy", tidy)
    out = out.withColumn("_masked", F.when(F.col("_tidy").rlike(r"\d"), F.regexp_replace("_tidy", _VARIABLE, WILD)).otherwise(F.col("_tidy")))
    out = out.withColumn("_tokens", F.split("_masked", " ")).withColumn("_n", F.size("_tokens"))
    out = out.withColumn("_width", F.greatest(F.ceil((n - lead) / F.lit(SEGMENTS)).cast("int"), F.lit(0)))
    run = [F.xxhash64(F.array_join(F.slice("_tokens", F.lit(lead + 1) + F.col("_width") * i, F.greatest("_width", F.lit(1))), " ")) for i in range(SEGMENTS)]
    out = out.withColumn("_path", F.xxhash64("_n", F.array_join(F.slice("_tokens", 1, lead), " "))).withColumns({f"_run{i}": r for i, r in enumerate(run)})
    runs = [F.col(f"_run{i}") for i in range(SEGMENTS)]
    own = F.xxhash64("_path", *runs)
    wild = [F.xxhash64("_path", *[F.lit(i) if i == j else r for i, r in enumerate(runs)]) for j in range(SEGMENTS)]
    return out.withColumn("_keys", F.when(n >= max(MIN_WILD, min_tokens), F.array(own, *wild)).when(n >= min_tokens, F.array(own)))


def drop_recurring(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lead: int = 2, min_tokens: int = 3, min_docs: int = 2, keep_first: bool = True) -> DataFrame:
    """``docs`` with recurring lines taken out of the text, and a last column ``n_lines_dropped`` (long)."""
    wide = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    ident, text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    as_string = text.cast("string")
    # the hash first, or it would be taken of the whole text for each of its lines
    hashed = wide.where(text.isNotNull()).select(ident.alias("_id"), F.xxhash64(as_string).alias("_t"), as_string.alias("_whole"))
    places = hashed.select("_id", "_t", F.posexplode(F.split("_whole", "\n")).alias("_pos", "_line"))
    # a document is its id and text, so that nothing depends on the order in which rows are read
    parsed = with_template_keys(places, "_line", lead, min_tokens)
    # the outer form, because a filter on the keys would be pushed below and parse each line again
    keyed = parsed.select("_id", "_t", "_pos", F.explode_outer("_keys").alias("_key")).where("_key is not null")
    often = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    often = written(often.where((F.col("_n") >= min_docs) & ((F.col("_low") < F.col("_high")) | F.lit(min_docs < 2))).select("_key"))
    again = written(keyed.join(often, "_key"))
    place = F.struct("_id", "_t", "_pos")
    # by key and text first, so that the rows of one key are spread over many tasks
    by_text = again.groupBy("_key", "_t").agg(F.min(place).alias("_first"))
    recurring = by_text.groupBy("_key").agg(F.count(F.lit(1)).alias("_docs"), F.min("_first").alias("_first")).where(F.col("_docs") >= min_docs)
    again = again.join(written(recurring.select("_key", "_first")), "_key")
    if keep_first:
        again = again.where(~place.eqNullSafe(F.col("_first")))
    dropped = again.groupBy("_id", "_t").agg(F.collect_set("_pos").alias("_gone"))
    both = wide.withColumn("_t", F.xxhash64(as_string)).join(dropped.withColumnRenamed("_t", "_text"), ident.eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_text")), "left")
    # places left over, by hash, then their lines; the lines are bound once
    left = F.array_except(F.sequence(F.lit(0), F.col("_size") - 1), F.col("_gone"))
    kept = F.transform(F.array(F.split(as_string, "\n")), lambda lines: F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))[0]
    both = both.withColumn("_size", F.when(F.col("_gone").isNotNull(), F.size(F.split(as_string, "\n"))))
    new = F.when(F.col("_gone").isNull(), text).otherwise(kept)
    n_dropped = F.coalesce(F.when(F.col("_gone").isNotNull(), F.size("_gone")), F.lit(0)).cast("long").alias(COUNT)
    named = [(new if c == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns) if c != COUNT]
    return both.select(*named, n_dropped)
