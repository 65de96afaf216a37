"""Vector code compression: four codebooks of 256 entries in integers, nearest entries found by VA-file filtering.

Components become ``floor(1024 * x)`` and a vector four equal consecutive parts. Each part has a codebook, which starts as that part of the 256
smallest ids and is moved in rounds to the mean (floored) of the parts assigned to each entry. To find the nearest entry, the coordinates of the
entries are quantised into ``2 ** BITS`` cells a position. For a part that looks for its entry, a table by position and cell holds the least and
the greatest squared distance to what lies in the cell; sums over the tables bound the distance to every entry from below and above. Only entries
whose lower bound doesn't exceed the least upper bound are candidates, and those are compared by exact distances in integers.

Scale. Kept vectors are written once as integers and read once a round; a task gives one row of sums for each entry it met, so a shuffle moves at most
256 x the vector's length numbers a task, and the driver gets the codebooks (256 x the vector's length numbers) and nothing else.
Sums by label are reduced before their shuffle, and joined from written tables, so that the rows of a hot label can be split.

Defined results: vectors that are null or hold null or non-finite components are dropped, and so are rows with a null id. A
vector can be coded if its length is a positive multiple of four and the same as that of the smallest id that has such a length, and its integers lie below
2 ** 24 in size; others are dropped too. With fewer than 256 vectors the codebooks have as many entries. Repeated rows
are coded each, and each counts in the means; among rows of one id the smaller integers come first. Null labels are one label. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import one_row_per_document, written

PARTS = 4
ENTRIES = 256
ROUNDS = 4
BITS = 4
GREATEST = 1 << 24
ROWS = 1024

Table = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label and the integers as bytes, big-endian and shifted, so that their order is that of the integers; kept vectors only."""
    for batch in batches:
        column = batch.column(2)
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        limits = np.concatenate([[0], np.cumsum(sizes)])
        with np.errstate(over="ignore", invalid="ignore"):
            values = np.floor(1024.0 * column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
            bad = np.concatenate([[0], np.cumsum(~(np.abs(values) < GREATEST))])
        keep = np.flatnonzero((sizes > 0) & (sizes % PARTS == 0) & (bad[limits[1:]] == bad[limits[:-1]]))
        raw = [(values[limits[i] : limits[i + 1]].astype(np.int64) + GREATEST).astype(">u4").tobytes() for i in keep]
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(raw, pa.binary())], names=["vec_id", "label", "raw"])


def parts_of(raw: list[bytes]) -> np.ndarray:
    """(vectors, parts, positions) in 64-bit integers."""
    x = np.frombuffer(b"".join(raw), ">u4").astype(np.int64) - GREATEST
    return x.reshape(len(raw), PARTS, -1)


def cells(entries: np.ndarray, bits: int = BITS) -> Table:
    """The entries, the marks of their cells (position and cell by entry), and the least and greatest coordinate in each cell.

    Cells of a position hold about as many entries each; equal coordinates share a cell. Empty cells get no mark.
    """
    n, size = entries.shape
    many = 1 << bits
    low, high = np.zeros((size, many)), np.zeros((size, many))
    marks = np.zeros((size * many, n))
    for p in range(size):
        x = entries[:, p]
        bounds = np.sort(x)[(np.arange(1, many) * n) // many]
        cell = np.searchsorted(bounds, x, side="right")
        marks[p * many + cell, np.arange(n)] = 1
        for c in np.unique(cell):
            low[p, c], high[p, c] = x[cell == c].min(), x[cell == c].max()
    return entries, marks, low, high


def bounds(x: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(rows, entries): not more and not less than the squared distance. Rounding is met by a slack far above it."""
    _, marks, low, high = table
    below, above = low - x[:, :, None], x[:, :, None] - high
    least = np.maximum(np.maximum(below, above), 0.0) ** 2
    most = np.maximum(np.abs(below), np.abs(above)) ** 2
    return (least.reshape(len(x), -1) @ marks) * (1 - 1e-9), (most.reshape(len(x), -1) @ marks) * (1 + 1e-9)


def nearest(x: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest entry (ties: the lower index), the squared distance, and how many candidates were compared in all."""
    index, distance, compared = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
    for at in range(0, len(x), ROWS):
        part = x[at : at + ROWS]
        least, most = bounds(part, table)
        row, entry = np.nonzero(least <= most.min(axis=1, keepdims=True))
        exact = np.concatenate([((part[row[c : c + 65536]] - table[0][entry[c : c + 65536]]) ** 2).sum(axis=1) for c in range(0, len(row), 65536)])
        first = np.searchsorted(row, np.arange(len(part)))
        best = np.minimum.reduceat(exact, first)
        hits = np.flatnonzero(exact == best[row])
        hits = hits[np.unique(row[hits], return_index=True)[1]]
        index[at : at + ROWS], distance[at : at + ROWS] = entry[hits], best
        compared += len(row)
    return index, distance, compared


def _sums(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each part and entry that the task has met: how many parts, and the sums by position."""
    tables = [cells(b) for b in books]
    count = np.zeros((PARTS, len(books[0])), np.int64)
    total = np.zeros((PARTS, *books[0].shape), np.int64)
    for batch in batches:
        if batch.num_rows:
            x = parts_of(batch.column(0).to_pylist())
            for p in range(PARTS):
                index = nearest(x[:, p], tables[p])[0]
                count[p] += np.bincount(index, minlength=count.shape[1])
                np.add.at(total[p], index, x[:, p])
    p, entry = np.nonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(entry), pa.array(count[p, entry]), pa.array(list(total[p, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])


def _codes(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    tables = [cells(b) for b in books]
    for batch in batches:
        if not batch.num_rows:
            continue
        x = parts_of(batch.column(2).to_pylist())
        found = [nearest(x[:, p], tables[p])[:2] for p in range(PARTS)]
        code = [bytes(c).hex() for c in np.stack([f[0] for f in found], axis=1).astype(np.uint8)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code), pa.array(sum(f[1] for f in found)), batch.column(1)], names=["vec_id", "code", "error", "label"])


def kept_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | Column = "label") -> DataFrame:
    """vec_id, label, raw: the vectors that can be coded, as integers, in a table of their own."""
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    picked = one_row_per_document(vectors, id_col).where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), F.col(vector_col).alias("embedding"))
    return written(picked.mapInArrow(_integers, f"vec_id long, label {picked.schema['label'].dataType.simpleString()}, raw binary"))


def fit(kept: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks of ``kept_vectors`` of one length, one (entries, positions) a part; none if there are no vectors."""
    start = kept.orderBy("vec_id", "raw").limit(ENTRIES).select("raw").collect()
    if not start:
        return []
    books = list(parts_of([bytes(r.raw) for r in start]).transpose(1, 0, 2))
    for _ in range(rounds):
        sent = kept.sparkSession.sparkContext.broadcast(books)
        sums = kept.select("raw").mapInArrow(lambda it, sent=sent: _sums(it, sent.value), "part long, entry long, n long, sums array<long>")
        moved = sums.select("part", "entry", "n", F.posexplode("sums").alias("pos", "x")).groupBy("part", "entry", "pos").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        books = [b.copy() for b in books]
        for part, entry, pos, n, x in moved.collect():
            books[part][entry, pos] = x // n
    return books


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label: one row per vector that can be coded."""
    kept = kept_vectors(vectors, id_col, vector_col, label_col)
    first = kept.orderBy("vec_id", "raw").select(F.length("raw").alias("n")).first()
    kept = kept.where(F.length("raw") == (first.n if first else 0))
    books = fit(kept)
    digest = sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    sent = kept.sparkSession.sparkContext.broadcast(books)
    label = kept.schema["label"].dataType.simpleString()
    coded = written(kept.select("vec_id", "label", "raw").mapInArrow(lambda it: _codes(it, sent.value), f"vec_id long, code string, error long, label {label}"))
    by_label = written(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"), "label")
