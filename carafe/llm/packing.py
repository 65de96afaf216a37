"""Best-fit sequence packing with exact-complement hashing.

Documents become token ids and an end id; only those longer than a sequence are cut, into whole sequences after a first,
shorter piece. The plan works on the histogram of piece lengths. From the longest down, the gap a piece leaves is looked up among single
lengths, sums of pairs and sums of triples; combinations that fill it exactly are consumed as long as every length in them is
available. What remains is packed best-fit, longest first.

Scale. Texts are read once and never shuffled. The plan sees at most ``capacity`` numbers whatever the corpus holds, and
a combination is consumed for all its copies at once. Each piece then finds its place by its rank in its length: ranks are counted in
each partition, and a window over (length) sees one row a partition. The interval table that is broadcast is bounded by the lengths.

Defined results: a null text is empty; an empty document is one piece with the end id. Repeated rows are packed each. A null id is
left out. An empty table gives an empty result. Other columns are not read. Ids are those of the tokenizer file's default settings.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import one_row_per_document, written

#: Characters with which both libraries split texts alike for certain: printable ASCII, newline, Latin letters; and no special token.
_OTHER = re.compile(r"[^ -~\n\u00c0-\u024f]|<\|")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes: those of the tokenizer file.

    The same vocabulary as ranks lets another library give the same ids several times faster; it takes texts of plain Latin
    characters, where splitting can't differ. All other texts, and all if there are no ranks, go to the file's own library.
    """

    def __init__(self, path: str, ranks: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        #: the shortest numbers that hold all ids
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        if ranks:
            import tiktoken
            from public_tokenizers import PATTERN

            with open(ranks, "rb") as lines:
                merged = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merged, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.fast is not None and not _OTHER.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _pieces(batches: Iterator[pa.RecordBatch], path: str, ranks: str | None, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encode, end = Encoder(path, ranks), np.array([end_id], "<u4").tobytes()
    part, seen = TaskContext.get().partitionId(), Counter()
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        docs = batch.column(0).to_pylist()
        for at in range(0, len(texts), 256):
            rows = []
            for doc_id, text in zip(docs[at : at + 256], texts[at : at + 256]):
                ids = encode(text) + end
                n = len(ids) // 4
                first = (n - 1) % capacity + 1
                for piece, (a, b) in enumerate([(0, first)] + [(s, s + capacity) for s in range(first, n, capacity)]):
                    cut = ids[4 * a : 4 * b]
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(cut), part, seen[b - a], *([np.frombuffer(cut, "<u4").astype(encode.kind).tobytes()] if with_ids else [])))
                    seen[b - a] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.binary()] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """How to fill sequences: (lengths in one sequence, how many such sequences). Uses every piece once."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out: list[tuple[tuple[int, ...], int]] = []

    def consume(*lengths: int) -> bool:
        times = min(int(left[x]) // k for x, k in Counter(lengths).items())
        if times:
            for x in lengths:
                left[x] -= times
            out.append((lengths, times))
        return times > 0

    def pair(gap: int, most: int) -> tuple[int, int] | None:
        """The pair with the longest first length, at most ``most``, among sums equal to the gap."""
        a = np.arange(min(gap - 1, most), (gap - 1) // 2, -1)
        fits = np.flatnonzero((left[a] > 0) & (left[gap - a] > (a == gap - a)))
        return (int(a[fits[0]]), gap - int(a[fits[0]])) if len(fits) else None

    if left[capacity]:
        consume(capacity)
    for length in range(capacity - 1, 0, -1):
        gap = capacity - length
        while left[length] and consume(length, gap):
            pass
        while left[length] and (found := pair(gap, length)) and consume(length, *found):
            pass
        for a in range(min(gap - 2, length), 0, -1) if left[length] else ():
            while left[length] and left[a] and (found := pair(gap - a, a)) and consume(length, a, *found):
                pass
    return out + best_fit({x: int(left[x]) for x in np.flatnonzero(left)}, capacity)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first; alike sequences are filled together."""
    open_by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            gap = min((g for g, bins in open_by_gap.items() if g >= length and bins), default=None)
            if gap is None:
                each = min(capacity // length, n)
                times = n // each
                open_by_gap[capacity - each * length].append(((length,) * each, times))
                n -= each * times
                continue
            lengths, times = open_by_gap[gap].pop()
            used = min(times, n)
            if times > used:
                open_by_gap[gap].append((lengths, times - used))
            open_by_gap[gap - length].append(((*lengths, length), used))
            n -= used
    return [b for bins in open_by_gap.values() for b in bins]


def intervals(filled: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks, their sequence numbers, their offsets; ranks from one first on go to consecutive sequences."""
    found, next_rank, sequence = defaultdict(list), Counter(), 0
    for lengths, times in filled:
        offset = 0
        for length in lengths:
            found[length].append((next_rank[length], sequence, offset))
            next_rank[length] += times
            offset += length
        sequence += times
    return {length: tuple(np.array(x, np.int64) for x in zip(*rows)) for length, rows in found.items()}


def _place(batches: Iterator[pa.RecordBatch], table: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        for x in np.unique(length).tolist():
            rows = np.flatnonzero(length == x)
            ranks, numbers, offsets = table[x]
            at = np.searchsorted(ranks, rank[rows], side="right") - 1
            sequence[rows], offset[rows] = numbers[at] + rank[rows] - ranks[at], offsets[at]
        columns = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
        if "ids" in columns:
            columns["ids"] = _unpacked(columns["ids"], length)
        yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])


def _unpacked(packed: pa.Array, lengths: np.ndarray) -> pa.Array:
    """Lists of ids from their bytes; how many bytes an id has follows from the lengths."""
    rows = packed.to_pylist()
    if not rows:
        return pa.array([], pa.list_(pa.int32()))
    flat = np.frombuffer(b"".join(rows), f"<u{len(rows[0]) // int(lengths[0])}")
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for."""
    path = tokenizer or tokenizer_path()
    ranks = ranks or (None if tokenizer else tokenizer_path("byte_bpe_50k.tiktoken"))
    picked = one_row_per_document(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ids = ", ids binary" if with_ids else ""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    pieces = written(picked.mapInArrow(lambda it: _pieces(it, path, ranks, capacity, end_id, with_ids), schema + ids))
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(intervals(plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    # written, so that Spark knows its size: broadcast while it is small, else pieces are shuffled to it
    ranked = pieces.join(written(starts), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", *(["ids"] if with_ids else [])]
    placed = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "") + ", sequence_id long, offset long"
    return ranked.select(*columns).mapInArrow(lambda it: _place(it, table.value), placed)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves (``pack`` with ids); a sequence is bounded by the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
