"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are spread over a bounded sample. Each distinct vector is described by its ``prefix`` nearest pivots in
order and posted to the inverted list of each. Within a list, pairs that share ``min_shared`` = 2 pivots or more are candidates, and a
candidate is verified by cosine in double precision. A pair is judged only in the list of its least shared pivot.

Scale. The number of pivots follows the number of distinct vectors up to ``MAX_PIVOTS``, so that lists keep a steady length. Beyond that
vectors are posted under each two of their nearest pivots (``together`` = 2): who shares two pivots shares such a list, so the candidates are the
same, and lists are shorter by the number of pivots that come along with one. Equal vectors
collapse first and count with their multiplicity. A long list is dealt into blocks of ``BLOCK`` vectors and every pair of its
blocks is one task's work, in matrices; pairs never become rows: a tile gives link counts and spanning links only. The
pivots are the only broadcast data. Fitting reads at most 4 * MAX_PIVOTS sampled vectors.

Defined results: null vectors, zero vectors and those with null or non-finite components link with nothing. Vectors of different lengths
never link. Repeated rows come out each, and count as links of each other. A null id is left out. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import components, durable, one_row_per_document, written

BLOCK = 1024
VECTORS_PER_PIVOT = 64
MAX_PIVOTS = 4096
MIN_PIVOTS = 32
_NO_PIVOT = np.iinfo(np.int32).max


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id and the vector's doubles as bytes; null if it can't link."""
    for batch in batches:
        column = batch.column(1)
        values = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
        limits = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        raw: list[bytes | None] = []
        for a, b in zip(limits[:-1], limits[1:]):
            x = values[a:b]
            size = float(np.abs(x).max(initial=0.0))  # nan if a component is
            raw.append((x + 0.0).tobytes() if np.isfinite(size) and size > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])


def _units(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, np.float64) for r in raw])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(units: np.ndarray, n: int, apart: float = 0.9) -> np.ndarray:
    """Up to n of the given unit vectors, first come, none within cosine ``apart`` of an earlier one."""
    chosen: list[int] = []
    for i in range(len(units)):
        if not chosen or (units[chosen] @ units[i]).max() < apart:
            chosen.append(i)
            if len(chosen) == n:
                break
    return units[chosen]


def fit_pivots(distinct: DataFrame, n_pivots: int) -> dict[int, tuple[int, np.ndarray]]:
    """By vector length in bytes: the first pivot's number and the pivots. From at most 4 * n_pivots rows, least hashes first."""
    sample = distinct.orderBy(F.xxhash64("raw")).limit(4 * n_pivots).select("raw").collect()
    by_length: dict[int, list[bytes]] = {}
    for (raw,) in sample:
        by_length.setdefault(len(raw), []).append(bytes(raw))
    out, at = {}, 0
    for length, raws in sorted(by_length.items()):
        pivots = spread(_units(raws), n_pivots)
        out[length] = (at, pivots)
        at += len(pivots)
    return out


def _post(batches: Iterator[pa.RecordBatch], pivots: dict, prefix: int, together: int) -> Iterator[pa.RecordBatch]:
    """Each vector under each ``together`` of its nearest pivots. A length that the sample lacks is posted under a number of its own."""
    for batch in batches:
        rep, n, raw = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
        lengths = np.array([len(r) for r in raw])
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            if length in pivots:
                at, points = pivots[length]
                k = min(prefix, len(points))
                near = _units([raw[i] for i in rows]) @ points.T
                top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < near.shape[1] else np.tile(np.arange(k), (len(rows), 1))
                top = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1) + at
            else:
                top = np.full((len(rows), 1), -length)
            keys = _list_keys(top, together)
            k = keys.shape[1]
            back = np.repeat(rows, k)
            perm = [r.astype("<i4").tobytes() for r in top]
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(rep[back]), pa.array(n[back]), pa.array([raw[i] for i in back], pa.binary()), pa.array([p for p in perm for _ in range(k)], pa.binary())], names=["pivot", "rep", "n", "raw", "perm"])


def _list_keys(top: np.ndarray, together: int) -> np.ndarray:
    """The lists of each row of pivots: the pivots, or each two of them, the lesser first, in one number."""
    if together == 1 or top.shape[1] == 1:
        return top.astype(np.int64)
    i, j = np.triu_indices(top.shape[1], 1)
    a, b = top[:, i].astype(np.int64), top[:, j].astype(np.int64)
    return np.minimum(a, b) << 32 | np.maximum(a, b)


_TILE = "kind int, a long, b long"
_TILE_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])


def _verify(table: pa.Table, threshold: float, min_shared: int, together: int) -> pa.Table:
    """One pair of blocks of one list: kind 0: vector a has b more links; kind 1: a and b are linked (spanning links)."""
    pivot, ti, tj = (table.column(c)[0].as_py() for c in ("pivot", "ti", "tj"))
    block, rep, n = (table.column(c).to_numpy() for c in ("block", "rep", "n"))
    raw = table.column("raw").to_pylist()
    perm = np.stack([np.frombuffer(p, "<i4") for p in table.column("perm").to_pylist()])
    left, right = np.flatnonzero(block == ti), np.flatnonzero(block == tj)
    if not len(left) or not len(right):
        return pa.Table.from_pylist([], schema=_TILE_ARROW)
    units = _units(raw)
    need = min(min_shared, perm.shape[1])
    found_i, found_j = [], []
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        # the cosine is the cheaper of the two tests in a matrix; the pivots are tallied for the pairs it leaves
        i, j = np.nonzero(units[rows] @ units[right].T >= threshold)
        i, j = rows[i], right[j]
        if ti == tj:
            i, j = i[i < j], j[i < j]
        for c in range(0, len(i), 65536):
            p, q = perm[i[c : c + 65536]], perm[j[c : c + 65536]]
            both = np.sort(np.where((p[:, :, None] == q[:, None, :]).any(axis=2), p, _NO_PIVOT), axis=1)
            # the pair belongs to the list of its least shared pivots
            least = both[:, 0].astype(np.int64) if together == 1 or perm.shape[1] == 1 else both[:, 0].astype(np.int64) << 32 | both[:, 1]
            mine = ((both != _NO_PIVOT).sum(axis=1) >= need) & (least == pivot)
            found_i.append(i[c : c + 65536][mine])
            found_j.append(j[c : c + 65536][mine])
    i, j = (np.concatenate(x) if x else np.zeros(0, int) for x in (found_i, found_j))
    if not len(i):
        return pa.Table.from_pylist([], schema=_TILE_ARROW)
    counts = np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
    root = np.arange(len(rep))
    while True:  # least label over links, with shortcuts
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    some, tied = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(rep)))
    kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(tied), np.int32)])
    return pa.Table.from_arrays([pa.array(kind), pa.array(np.concatenate([rep[some], rep[tied]])), pa.array(np.concatenate([counts[some].astype(np.int64), rep[root[tied]]]))], schema=_TILE_ARROW)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, prefix: int = 8, min_shared: int = 2, together: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` with an id. No link lies below ``threshold``.

    ``together`` (1 or 2 pivots a list) follows the number of distinct vectors unless given.
    """
    parsed = one_row_per_document(vectors, id_col).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    parsed = written(parsed.mapInArrow(_parse, "vec_id long, raw binary"))
    distinct = written(parsed.where("raw is not null").groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    size = distinct.count()
    n_pivots = max(MIN_PIVOTS, min(MAX_PIVOTS, size // VECTORS_PER_PIVOT))
    together = together or (2 if min_shared > 1 and size > MAX_PIVOTS * VECTORS_PER_PIVOT else 1)
    if together > min_shared:
        raise ValueError("vectors that share fewer pivots than a list has would be missed")
    pivots = vectors.sparkSession.sparkContext.broadcast(fit_pivots(distinct, n_pivots))
    posted = durable(distinct.select("rep", "n", "raw").mapInArrow(lambda it: _post(it, pivots.value, prefix, together), "pivot long, rep long, n long, raw binary, perm binary"))
    blocks = posted.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks"))
    dealt = posted.join(blocks, "pivot").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("pivot", F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"), "block", "rep", "n", "raw", "perm")
    judged = durable(dealt.groupBy("pivot", "ti", "tj").applyInArrow(lambda t: _verify(t, threshold, min_shared, together), _TILE))
    counts = judged.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    grouped = components(judged.where("kind = 1").select("a", "b")).select(F.col("id").alias("rep"), "component")
    by_vector = distinct.join(counts, "rep", "left").join(grouped, "rep", "left").select("raw", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    # both sides are written, so that the rows of one vector that very many share can be split
    out = parsed.join(written(by_vector), "raw", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
