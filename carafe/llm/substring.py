"""Exact substring dedup with fixed-block anchors.

Every document is cut into non-overlapping blocks of ``window // 2`` words; these are the index. Every rolling window of as
many words probes it. A repeat of ``window`` words holds a whole block of each of its occurrences wherever the blocks happen to
lie, so both occurrences get a hit from the other. Hits are extended on both sides to all windows of ``window`` words around
them; those that occur earlier in the corpus are covered, and overlapping ones join into maximal exact repeats.

Scale. The text is shuffled once, by chunks of documents (by a hash of the id), and the three passes reuse that exchange. A chunk sends each
of its distinct hashes once, packed by hash bucket, so a passage in a third of all rows costs one entry a chunk and no group
grows with its count; pairs of occurrences are never formed. The numbers of chunks and buckets follow the bytes of text, which are summed
first: a task holds one chunk (``CHUNK_BYTES`` or the longest text) or the hashes of ``BUCKET_BYTES`` of text at a time.

Block hits use 30 bits and a bucket (a false hit only costs a look); window equality uses 96 bits of two independent hashes.

Defined results: null and empty texts have no words. Rows with one id count as documents in the order of a hash of their texts, each gets
its own result. A null id is left out. An empty table gives an empty result. Only the id and the text are read; other columns are
not in the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import one_row_per_document, shuffle_width
from .wordhash import gram_hashes, utf8, word_hashes, word_spans

CHUNK_BYTES = 1 << 18
BUCKET_BYTES = 1 << 25
#: Bytes of text in a chunk for each bucket, so that a chunk has some tens of hashes for each.
CHUNK_BYTES_A_BUCKET = 400
_KEY_BITS = 30
_KEY = np.uint64((1 << _KEY_BITS) - 1)
_PACKED = "bucket int, chunk long, kind int, a binary, b binary, c binary, d binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
_RESULT = "doc_id long, text string, n_words long, n_removed long, removed array<struct<start:long,end:long>>"
_RESULT_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


class _Chunk:
    """The documents of one chunk in (id, row) order as one sequence of word hashes."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        self.data, self.limits = utf8(self.table.column("text"))
        self.starts, self.ends, self.first = word_spans(self.data, self.limits)
        self.words = word_hashes(self.data, self.starts, self.ends)
        self.doc_ids = self.table.column("doc_id").to_numpy()

    def doc_of(self) -> np.ndarray:
        """The document (its place in the chunk) of every word."""
        return np.repeat(np.arange(len(self.doc_ids)), np.diff(self.first))

    def inside(self, n: int) -> np.ndarray:
        """Whether n words from here on lie in one document, for each place with n words left in the chunk."""
        doc = self.doc_of()
        return doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :]


def _packed(keys: np.ndarray) -> bytes:
    """Numbers below 2**32 in four bytes each."""
    return keys.astype("<u4").tobytes()


def _unpacked(a: bytes) -> np.ndarray:
    return np.frombuffer(a, "<u4").astype(np.uint64)


def _by_bucket(bucket: np.ndarray, buckets: int):
    """The places of each bucket that occurs, in order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return ((k, order[edges[k] : edges[k + 1]]) for k in np.flatnonzero(np.diff(edges)).tolist())


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _probe(table: pa.Table, block: int, buckets: int) -> pa.Table:
    """Distinct rolling hashes of a chunk, with two flags: is a reference block here; occurs more than once here."""
    chunk = _Chunk(table)
    codes = gram_hashes(chunk.words, block)
    inside = chunk.inside(block)
    within = np.arange(len(chunk.words)) - np.repeat(chunk.first[:-1], np.diff(chunk.first))
    is_block = (within[: len(codes)] % block == 0)[inside]
    codes = codes[inside]
    bucket, key = _code(codes, buckets)
    joint = bucket << np.uint64(_KEY_BITS) | key
    order = np.argsort(joint, kind="stable")
    joint, is_block = joint[order], is_block[order]
    edge = np.flatnonzero(np.concatenate([[True], joint[1:] != joint[:-1]])) if len(joint) else np.zeros(0, int)
    some_block = np.logical_or.reduceat(is_block, edge) if len(edge) else np.zeros(0, bool)
    many = np.diff(np.concatenate([edge, [len(joint)]])) > 1
    joint = joint[edge]
    flagged = (joint & _KEY) << np.uint64(2) | some_block.astype(np.uint64) << np.uint64(1) | many.astype(np.uint64)
    at = table.column("chunk")[0].as_py()
    rows = [(k, at, 0, _packed(flagged[i]), None, None, None) for k, i in _by_bucket((joint >> np.uint64(_KEY_BITS)).astype(np.int64), buckets)]
    return _table(rows, _PACKED_ARROW)


def _code(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (codes >> np.uint64(40)) % np.uint64(buckets), codes & _KEY


def _meet(table: pa.Table) -> pa.Table:
    """In one bucket: the hashes with a reference block and another occurrence, given back to each chunk that has them."""
    cells = [_unpacked(a.as_py()) for a in table.column("a")]
    flagged = np.concatenate(cells)
    keys = flagged >> np.uint64(2)
    order = np.argsort(keys, kind="stable")
    edge = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
    sizes = np.diff(np.concatenate([edge, [len(keys)]]))
    some_block = np.bitwise_or.reduceat(flagged[order], edge)
    hit = (some_block & np.uint64(2) > 0) & ((sizes > 1) | (some_block & np.uint64(1) > 0))
    hits = np.zeros(len(keys), bool)
    hits[order] = np.repeat(hit, sizes)
    bucket, at, rows = table.column("bucket")[0].as_py(), 0, []
    for chunk, cell in zip(table.column("chunk").to_pylist(), cells):
        mine = keys[at : at + len(cell)][hits[at : at + len(cell)]]
        at += len(cell)
        if len(mine):
            rows.append((bucket, chunk, 0, _packed(mine), None, None, None))
    return _table(rows, _PACKED_ARROW)


def _extend(table: pa.Table, hits: pa.Table, block: int, window: int, buckets: int) -> pa.Table:
    """Windows around hits. Those that repeat an earlier one of the chunk go straight on (kind 1), the others to their bucket (0)."""
    if not table.num_rows or not hits.num_rows:
        return _table([], _PACKED_ARROW)
    chunk = _Chunk(table)
    bucket, key = _code(gram_hashes(chunk.words, block), buckets)
    known = np.sort(np.concatenate([np.uint64(k) << np.uint64(_KEY_BITS) | _unpacked(a.as_py()) for k, a in zip(hits.column("bucket").to_pylist(), hits.column("a"))]))
    mine = bucket << np.uint64(_KEY_BITS) | key
    place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
    hit = np.flatnonzero((known[place] == mine) & chunk.inside(block))
    inside = chunk.inside(window)
    near = np.zeros(len(chunk.words) + 1, np.int64)
    np.add.at(near, np.maximum(hit - (window - block), 0), 1)
    np.add.at(near, hit + 1, -1)
    at = np.flatnonzero((np.cumsum(near)[: len(inside)] > 0) & inside)
    if not len(at):
        return _table([], _PACKED_ARROW)
    h1, h2 = gram_hashes(chunk.words, window, 3)[at], gram_hashes(chunk.words, window, 7)[at] & np.uint64(0xFFFFFFFF)
    order = np.lexsort((h2, h1))
    new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
    doc = chunk.doc_of()[at]
    start = at - chunk.first[doc]
    here = table.column("chunk")[0].as_py()
    again = np.sort(order[~new])
    rows = [(here % buckets, here, 1, doc[again].astype("<i4").tobytes(), start[again].astype("<i4").tobytes(), None, None)] if len(again) else []
    first = np.sort(order[new])
    for k, i in _by_bucket((h1[first] % np.uint64(buckets)).astype(np.int64), buckets):
        i = first[i]
        rows.append((k, here, 0, h1[i].tobytes() + h2[i].astype("<u4").tobytes(), chunk.doc_ids[doc[i]].astype("<i8").tobytes(), doc[i].astype("<i4").tobytes(), start[i].astype("<i4").tobytes()))
    return _table(rows, _PACKED_ARROW)


def _first(table: pa.Table) -> pa.Table:
    """In one bucket: every window but the earliest of its words goes back to its chunk."""
    rows = [tuple(x) for x in table.filter(pa.compute.equal(table.column("kind"), 1)).select(["bucket", "chunk", "kind", "a", "b", "c", "d"]).to_pydict().values()]
    out = list(zip(*rows)) if rows and rows[0] else []
    packed = table.filter(pa.compute.equal(table.column("kind"), 0))
    if packed.num_rows:
        n = [len(x.as_py()) // 4 for x in packed.column("d")]
        h1 = np.concatenate([np.frombuffer(x.as_py(), "<u8", k) for x, k in zip(packed.column("a"), n)])
        h2 = np.concatenate([np.frombuffer(x.as_py(), "<u4", k, 8 * k) for x, k in zip(packed.column("a"), n)])
        ids = np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in packed.column("b")])
        doc = np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in packed.column("c")])
        start = np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in packed.column("d")])
        chunk = np.repeat(packed.column("chunk").to_numpy(), n)
        order = np.lexsort((start, doc, chunk, ids, h2, h1))
        new = np.concatenate([[True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])])
        later = order[~new]
        later = later[np.argsort(chunk[later], kind="stable")]
        edge = np.flatnonzero(np.concatenate([[True], chunk[later][1:] != chunk[later][:-1], [True]])) if len(later) else [0]
        bucket = packed.column("bucket")[0].as_py()
        out += [(bucket, int(chunk[later[i]]), 1, doc[later[i:j]].tobytes(), start[later[i:j]].tobytes(), None, None) for i, j in zip(edge[:-1], edge[1:])]
    return _table(out, _PACKED_ARROW)


def _remove(table: pa.Table, flagged: pa.Table, window: int) -> pa.Table:
    """Each document without the words that its flagged windows cover."""
    if not table.num_rows:
        return _table([], _RESULT_ARROW)
    chunk = _Chunk(table)
    cover = np.zeros(len(chunk.words) + 1, np.int64)
    for a, b in zip(flagged.column("a"), flagged.column("b")):
        at = chunk.first[np.frombuffer(a.as_py(), "<i4")] + np.frombuffer(b.as_py(), "<i4")
        np.add.at(cover, at, 1)
        np.add.at(cover, at + window, -1)
    gone = np.cumsum(cover)[:-1] > 0
    # kept words joined by one space, document after document
    keep = np.flatnonzero(~gone)
    lengths = chunk.ends[keep] - chunk.starts[keep]
    to = np.cumsum(lengths + 1)
    joined = np.full(int(to[-1]) if len(to) else 0, 0x20, np.uint8)
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    joined[np.repeat(to - lengths - 1, lengths) + within] = chunk.data[np.repeat(chunk.starts[keep], lengths) + within]
    raw = joined.tobytes()
    first_kept = np.searchsorted(keep, chunk.first)
    limits = np.concatenate([[0], to])[first_kept]
    texts = [raw[i : max(i, j - 1)].decode() for i, j in zip(limits[:-1].tolist(), limits[1:].tolist())]
    step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    doc = chunk.doc_of()
    opens = np.flatnonzero((gone & np.concatenate([[True], ~gone[:-1] | (doc[1:] != doc[:-1])])) if len(gone) else step[:0])
    closes = np.flatnonzero((gone & np.concatenate([~gone[1:] | (doc[1:] != doc[:-1]), [True]])) if len(gone) else step[:0]) + 1
    spans: list[list[dict]] = [[] for _ in texts]
    for i, j in zip(opens.tolist(), closes.tolist()):
        base = int(chunk.first[doc[i]])
        spans[doc[i]].append({"start": i - base, "end": j - base})
    n_words = np.diff(chunk.first)
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[chunk.first])
    return pa.Table.from_arrays([pa.array(chunk.doc_ids), pa.array(texts, pa.string()), pa.array(n_words), pa.array(removed), pa.array(spans, _RESULT_ARROW.field(4).type)], schema=_RESULT_ARROW)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed, removed (maximal spans of words, end exclusive).

    A word is removed if a window of ``window`` consecutive words that covers it has the same words as a window that starts
    earlier: in a smaller id, or earlier in the same document. Windows are judged on the input.
    """
    picked = one_row_per_document(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = picked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block, buckets = window // 2, max(2 * shuffle_width(docs.sparkSession), -(-total // BUCKET_BYTES))
    n_chunks = max(1, -(-total // max(CHUNK_BYTES, CHUNK_BYTES_A_BUCKET * buckets)))
    # by values, not by row numbers, so that a part which is computed again deals its rows alike
    chunks = picked.withColumn("row", F.xxhash64("text")).withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(n_chunks))).groupBy("chunk")
    hits = chunks.applyInArrow(lambda t: _probe(t, block, buckets), _PACKED).groupBy("bucket").applyInArrow(_meet, _PACKED)
    around = chunks.cogroup(hits.groupBy("chunk")).applyInArrow(lambda t, h: _extend(t, h, block, window, buckets), _PACKED)
    flagged = around.groupBy("bucket").applyInArrow(_first, _PACKED)
    return chunks.cogroup(flagged.groupBy("chunk")).applyInArrow(lambda t, f: _remove(t, f, window), _RESULT)
