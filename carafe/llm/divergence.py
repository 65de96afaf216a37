"""Source divergence audit: term counts by language and source, compared in shards by DuckDB and merged by Spark.

First, each task counts the terms of its rows in DuckDB, by (lang, source, term), with the number of rows that hold each. The counts are dealt into shards
by (lang, term); in a shard, DuckDB adds them up and keeps a language's terms that enough of its rows hold. Totals of the groups give each kept count
its frequency ``p``. The kept counts are dealt into shards again, where DuckDB adds up, for each two sources of a language, what the terms add that
both have, and ranks each group's terms; Spark merges the shards' sums and rankings.

A pair's value is a sum over all kept terms of the language, most of which a group lacks. A lacking term has the group's lowest frequency ``zero``, so
with f the summand, a and b the groups and Z the frequency of a lacking term,
sum = [both: f(a, b) - f(a, Zb) - f(Za, b)] + [a's terms: f(a, Zb)] + [b's terms: f(Za, b)] + (V - terms of a - terms of b + both) * f(Za, Zb).
The first bracket is summed in the shards; the next two come from the number of terms by frequency, which the shards count too. So a term costs as many
pairs as sources have it, in one shard, and no pair of rows leaves a shard.

Scale. Counts are added up before they are shuffled, so a frequent term costs a row a task and group, and a hot source or language no more than
others. A task's tables in DuckDB are flushed by ``FLUSH`` rows before the first shuffle; in a shard they hold that shard's different terms, and
DuckDB spills beyond ``MEMORY``. Shards are as many as shuffle partitions. Texts are read by pieces, cut between terms. The
totals of the groups are broadcast up to ``FEW_GROUPS`` groups, and joined from written tables beyond. Pairs of sources are the result itself.

All arithmetic is in integers: counts are long, products with 10 ** 9 are decimals or divided exactly.

Defined results: null texts, langs and sources are ''. Repeated rows count each. Terms are runs of A-Z, a-z and characters beyond ASCII, A-Z lower-cased.
A group without terms still has its rows; where a language keeps no term, its pairs are 0 and it has no terms. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import shuffle_width, written
from .wordhash import slices, utf8

LEAST_DOCS = 10
TOP = 10
FLUSH = 400_000
MEMORY = "400MB"
FEW_GROUPS = 20_000
PIECE = 1 << 20
#: Each byte as DuckDB shall see it: A-Z in lower case, a space for all ASCII but letters.
_SEEN = np.arange(256, dtype=np.uint8)
_SEEN[:128] = [ord(chr(b).lower()) if chr(b).isalpha() else 0x20 for b in range(128)]


class _Shard:
    """A database in memory for one task, with a folder for what it spills; both go at the end."""

    def __enter__(self) -> duckdb.DuckDBPyConnection:
        self.folder = tempfile.mkdtemp(prefix="carafe-shard-")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": os.path.join(self.folder, "spill"), "preserve_insertion_order": False})
        return self.con

    def __exit__(self, *_: object) -> None:
        self.con.close()
        shutil.rmtree(self.folder, ignore_errors=True)


def _query(con: duckdb.DuckDBPyConnection, sql: str) -> Iterator[pa.RecordBatch]:
    reader = con.sql(sql).to_arrow_reader(50_000)
    yield from (b for b in reader if b.num_rows)


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Runs of whole rows as (row numbers, texts of terms parted by spaces); long texts are cut between terms."""
    data, limits = utf8(column)
    for a, b in slices(limits, 4 * PIECE):
        part, ends = _SEEN[data[limits[a] : limits[b]]], limits[a : b + 1] - limits[a]
        wanted = np.arange(PIECE, len(part), PIECE)
        gaps = np.flatnonzero(part == 0x20)
        if len(wanted) and len(gaps):
            cuts = gaps[np.minimum(np.searchsorted(gaps, wanted), len(gaps) - 1)]
            ends = np.unique(np.concatenate([ends, cuts]))  # rows without any byte hold no term
        rows = a + np.searchsorted(limits[a : b + 1] - limits[a], ends[:-1], side="right") - 1
        yield rows, pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(part.tobytes()))


_COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs of a task's rows; the term '' marks a group."""
    with _Shard() as con:
        con.execute("CREATE TABLE counts (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
        merged = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM counts GROUP BY ALL"
        for batch in batches:
            groups = pa.table({"row": np.arange(batch.num_rows), "lang": batch.column(0), "source": batch.column(1)})
            con.register("groups", groups)
            con.execute("INSERT INTO counts SELECT DISTINCT lang, source, '', 0, 0 FROM groups")
            for rows, texts in pieces(batch.column(2)):
                con.register("pieces", pa.table({"row": rows, "text": texts}))
                con.execute("""INSERT INTO counts SELECT lang, source, term, sum(n), count(*) FROM (
                    SELECT row, term, count(*) AS n FROM (SELECT row, unnest(string_split(text, ' ')) AS term FROM pieces) WHERE term <> '' GROUP BY row, term
                    ) JOIN groups USING (row) GROUP BY lang, source, term""")
                con.unregister("pieces")
                if con.execute("SELECT count(*) FROM counts").fetchall()[0][0] > FLUSH:
                    con.execute(f"CREATE TABLE fewer AS {merged}; DROP TABLE counts; ALTER TABLE fewer RENAME TO counts")
                    if con.execute("SELECT count(*) FROM counts").fetchall()[0][0] > FLUSH // 2:
                        yield from _query(con, "SELECT * FROM counts")
                        con.execute("DELETE FROM counts")
            con.unregister("groups")
        yield from _query(con, merged)


def _loaded(con: duckdb.DuckDBPyConnection, batches: Iterator[pa.RecordBatch], merge: str | None = None) -> bool:
    """Puts all rows of a shard into table r, merged as it grows; whether there were any."""
    made, size = False, 0
    for batch in batches:
        if batch.num_rows:
            con.register("more", pa.Table.from_batches([batch]))
            con.execute("INSERT INTO r SELECT * FROM more" if made else "CREATE TABLE r AS SELECT * FROM more")
            con.unregister("more")
            made, size = True, size + batch.num_rows
            if merge and size > 4 * FLUSH:
                con.execute(f"CREATE TABLE fewer AS {merge}; DROP TABLE r; ALTER TABLE fewer RENAME TO r")
                size = 0
    return made


def _keep(batches: Iterator[pa.RecordBatch], least_docs: int) -> Iterator[pa.RecordBatch]:
    """One shard: its counts added up; terms that too few rows of the language hold go."""
    merge = "SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n, CAST(sum(docs) AS BIGINT) AS docs FROM r GROUP BY ALL"
    with _Shard() as con:
        if _loaded(con, batches, merge):
            yield from _query(con, f"WITH t AS ({merge}), k AS (SELECT lang, term FROM t GROUP BY ALL HAVING sum(docs) >= {least_docs} OR term = '') SELECT lang, source, term, n FROM t JOIN k USING (lang, term)")


def _compare(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """One shard: kind 0: partial sum v and number n of the terms that two sources have; 1: number n of a group's terms of
    frequency v; 2: a group's first terms with their values v."""
    f = "(({0} - {1}) * ({0} - {1}) // ({0} + {1}))"
    with _Shard() as con:
        if not _loaded(con, batches):
            return
        yield from _query(con, f"""SELECT 0 AS kind, a.lang, a.source, b.source AS item, CAST(sum({f.format('a.p', 'b.p')} - {f.format('a.p', 'b.zero')} - {f.format('a.zero', 'b.p')}) AS BIGINT) AS v, count(*) AS n
            FROM r a JOIN r b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL""")
        yield from _query(con, "SELECT 1 AS kind, lang, source, '' AS item, p AS v, count(*) AS n FROM r GROUP BY ALL")
        yield from _query(con, f"""WITH q AS (SELECT lang, term, 1 + CAST(1000000000 * (CAST(sum(n) AS HUGEINT) + 2) // any_value(lang_weight) AS BIGINT) AS q FROM r GROUP BY lang, term)
            SELECT 2 AS kind, lang, source, term AS item, {f.format('p', 'q')} AS v, CAST(1 AS BIGINT) AS n FROM r JOIN q USING (lang, term) WHERE n > 0 AND p > q
            QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY v DESC, item) <= {top}""")


def _f(a: str, b: str) -> str:
    return f"(({a} - {b}) * ({a} - {b}) div ({a} + {b}))"


def _p(n: str, weight: str) -> str:
    return f"1 + (cast({n} + 2 as decimal(20, 0)) * 1000000000) div {weight}"


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source's terms are from each other source's of its language (part "pair"), and which
    terms it has more often than its language (part "term", the first ``top``)."""
    width = shuffle_width(docs.sparkSession)
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counts = texts.mapInArrow(_count, _COUNTS).repartition(width, "lang", "term")
    kept = written(counts.mapInArrow(lambda it: _keep(it, least_docs), "lang string, source string, term string, n long"))

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum((F.col("term") != "").cast("long")).alias("terms"))
    by_lang = kept.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("kept_terms"), F.sum("n").alias("lang_total"))
    totals = sums.join(by_lang, "lang", "left").na.fill(0, ["kept_terms", "lang_total"])
    totals = totals.selectExpr("lang", "source", "terms", "kept_terms", "total + 2 * kept_terms as weight", "lang_total + 2 * kept_terms as lang_weight")
    totals = written(totals.withColumn("zero", F.when(F.col("kept_terms") > 0, F.expr(_p("0", "weight")))))
    few = totals.count() <= FEW_GROUPS
    near = F.broadcast if few else lambda df: df

    rated = kept.where("term <> ''").join(near(totals.select("lang", "source", "weight", "lang_weight", "zero")), ["lang", "source"])
    rated = rated.selectExpr("lang", "source", "term", "n", f"{_p('n', 'weight')} as p", "zero", "lang_weight").repartition(width, "lang", "term")
    found = written(rated.mapInArrow(lambda it: _compare(it, top), "kind int, lang string, source string, item string, v long, n long"))

    both = found.where("kind = 0").groupBy("lang", "source", "item").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    both = both.unionByName(both.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "v", "n"))
    others = totals.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("terms").alias("other_terms"))
    numbers = found.where("kind = 1").groupBy("lang", "source", "v").agg(F.sum("n").alias("n"))
    own = numbers.join(near(others), "lang").where("source <> item").groupBy("lang", "source", "item").agg(F.expr(f"sum(n * {_f('v', 'other_zero')})").alias("own"))
    pairs = totals.join(near(others), "lang").where("source <> item").join(both, ["lang", "source", "item"], "left")
    pairs = pairs.join(own, ["lang", "source", "item"], "left").join(own.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("own").alias("others_own")), ["lang", "source", "item"], "left")
    value = f"coalesce(v, 0) + coalesce(own, 0) + coalesce(others_own, 0) + (kept_terms - terms - other_terms + coalesce(n, 0)) * {_f('zero', 'other_zero')}"
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.when(F.col("kept_terms") > 0, F.expr(value)).otherwise(F.lit(0)).cast("long").alias("value"))
    terms = found.where("kind = 2").select("lang", "source", F.lit("term").alias("part"), "item", F.col("v").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    first = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(first)
