"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is 8 bytes. Two fingerprints at ``max_bits`` = 4 or fewer differing bits share at least 8 - 4 = 4 bytes at the
same positions, and any 4 positions contain one of the ``TRIPLES`` below. So each distinct fingerprint is posted
under its positional byte triples. Pairs of one posting list share three bytes; all their shared positional bytes are tallied, pairs
below the guaranteed minimum of four are discarded, and the rest are verified by Hamming distance. The result is exact.

Scale. Texts are read once. Equal fingerprints collapse before the index (with partial aggregation), so a group of copies
costs one entry. A posting list is walked breadth first: each step compares one fingerprint with those not
reached yet, so a tight group of m takes about m steps and emits at most m - 1 links, never all pairs. Lists arrive sorted and one is
held at a time, so memory is that of the longest list.

``near_classes`` serves near-duplicates at a shingle similarity: the distinct shingles of a text give 256 bits, posted under positional bytes:
two a key while that leaves ``LIST_LENGTH`` texts in a list or less, three or more beyond (lists keep their length as the corpus grows). The bits
are dealt to bytes anew and posted again as often as ``TARGET_RECALL`` takes at the similarity itself (``posting_turns``). A similarity of 0.8 is about 39 differing bits and the threshold lies three standard deviations above, so bits only propose pairs
(about 0.98 of those at 0.8 itself, nearly all from 0.85 up); a link is a pair whose shingle sets, shuffled to it, have that Jaccard similarity.
Equal sets collapse before the index. In a posting list every pair within the threshold is proposed, but a text reached from another at two
standard deviations below 39 bits is not paired again with those reached before it, so a hot group of m texts proposes a few pairs a text, not
m * m. About one pair in fifty at 0.8 is so near without being similar enough; only then, and if no other list or text links it, is a link missed.

Defined results: null and empty texts and texts of white space have fingerprint 0 and link like any other. Repeated rows
each come out. A null id is left out. An empty table gives an empty result. Other columns are not read by ``fingerprints``
and are passed through by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import components, one_row_per_document, rows_by_id, shuffle_width, written
from .wordhash import gram_hashes, mix, slices, utf8, word_hashes, word_spans

BYTES = 8
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def covering_triples() -> list[tuple[int, int, int]]:
    """Position triples such that any four of the eight positions contain one (greedy from the rule itself)."""
    open_sets, chosen = {frozenset(x) for x in combinations(range(BYTES), 4)}, []
    while open_sets:
        best = max(combinations(range(BYTES), 3), key=lambda t: (sum(set(t) <= s for s in open_sets), [-i for i in t]))
        chosen.append(best)
        open_sets = {s for s in open_sets if not set(best) <= s}
    return chosen


TRIPLES = covering_triples()


def fingerprint_of(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of one text, as an unsigned number (the plain definition, also used by the tests)."""
    words = (text or "").encode().translate(_LOWER).replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype=np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, BYTES), axis=1)
    ones = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int.from_bytes(np.packbits(ones).tobytes(), "big")


def _hash_documents(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        data, limits = utf8(batch.column(1))
        out = np.zeros(len(batch), np.uint64)
        for a, b in slices(limits):
            part, lim = data[limits[a] : limits[b]], limits[a : b + 1] - limits[a]
            starts, ends, first = word_spans(part, lim)
            if not len(starts):
                continue
            # words joined by one space, so that a shingle is one slice
            lengths = ends - starts + 1
            to = np.cumsum(lengths)
            joined = np.full(int(to[-1]), 0x20, np.uint8)
            at = np.repeat(to - lengths, lengths - 1) + _within(lengths - 1)
            joined[at] = part[np.repeat(starts, lengths - 1) + _within(lengths - 1)]
            plain = memoryview(joined.tobytes().translate(_LOWER))
            begin, end = (to - lengths).tolist(), (to - 1).tolist()
            for row in range(b - a):
                i, j = int(first[row]), int(first[row + 1])
                if i == j:
                    continue
                n = max(1, j - i - shingle + 1)
                k = min(shingle, j - i) - 1
                out[a + row] = majority(np.array([digest(plain[x:y], 42) for x, y in zip(begin[i : i + n], end[i + k : i + k + n])], dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. inside each run of the given lengths."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a long): one row per row of ``docs`` with an id."""
    picked = one_row_per_document(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lambda it: _hash_documents(it, shingle), "doc_id long, fp long")


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by their first column, cut into batches of whole runs of it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(0).to_numpy()
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and (cut or held[0].column(0)[0].as_py() != keys[0]):
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _near(differ: np.ndarray, max_bits: int) -> np.ndarray:
    """Places of differences that leave the guaranteed number of positional bytes shared, and are of ``max_bits`` or less."""
    shared = (differ.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    some = np.flatnonzero(shared >= BYTES - max_bits)
    return some[np.bitwise_count(differ[some]) <= max_bits]


def _walk(run: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that span the components of one posting list."""
    rest, links = run, []
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = _near(rest ^ x, max_bits)
            if len(near):
                links += [(int(x.view(np.int64)), int(y)) for y in rest[near].view(np.int64)]
                frontier += list(rest[near])
                rest = np.delete(rest, near)
    return links


def _posting_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """The posting lists of one partition, which come in order: those of two at once by numpy, longer ones by ``_walk``."""
    for batch in _whole_lists(batches):
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        sizes = np.diff(edge)
        two = edge[:-1][sizes == 2]
        near = two[_near(fps[two] ^ fps[two + 1], max_bits)]
        a, b = [fps[near].view(np.int64)], [fps[near + 1].view(np.int64)]
        for i, n in zip(edge[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            if links := _walk(fps[i : i + n], max_bits):
                x, y = np.array(links, dtype=np.int64).T
                a.append(x)
                b.append(y)
        a, b = np.concatenate(a), np.concatenate(b)
        if len(a):
            yield from _pair_batches([np.sort(np.stack([a, b], axis=1), axis=1)])


def links(distinct_fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints ``fp`` at ``max_bits`` or fewer differing bits; exact up to 4."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the position triples guarantee a shared list for 4 or fewer differing bits")
    byte = [F.shiftrightunsigned(F.col("fp"), 8 * i).bitwiseAND(F.lit(255)) for i in range(BYTES)]
    keys = [F.lit(n << 24).cast("long").bitwiseOR(F.shiftleft(byte[i], 16)).bitwiseOR(F.shiftleft(byte[j], 8)).bitwiseOR(byte[k]) for n, (i, j, k) in enumerate(TRIPLES)]
    posted = distinct_fps.select(F.explode(F.array(*keys)).alias("posting"), "fp")
    width = shuffle_width(distinct_fps.sparkSession)
    return posted.repartition(width, "posting").sortWithinPartitions("posting").mapInArrow(lambda it: _posting_links(it, max_bits), "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable through links): one row per row of ``docs``."""
    prints = written(fingerprints(docs, id_col, text_col, shingle))
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    return prints.join(_least_ids(distinct, "fp", components(links(distinct.select("fp"), max_bits))), "fp").select("doc_id", "fp", "component_id")


def _least_ids(distinct: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Each key of ``distinct`` with the least document id of its component; keys without links are by themselves.

    Every side of a join is a written table, so that a component with very many texts is split or broadcast.
    """
    linked = written(found.withColumnRenamed("id", key).join(distinct, key))
    smallest = written(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    named = written(linked.join(smallest, "component").select(key, "component_id"))
    return written(distinct.join(named, key, "left").select(key, F.coalesce("component_id", "least").alias("component_id")))


WIDE_WORDS = 4
WIDE_BYTES = 8 * WIDE_WORDS
#: The average posting list of unlike texts is no longer than this.
LIST_LENGTH = 1024
#: Of pairs at the similarity itself, the share that meets in some list.
TARGET_RECALL = 0.99
#: Added to the expected bits for each root of the words, about three standard deviations, so that nearly all pairs at the similarity itself are proposed.
MARGIN = 9.0
#: Taken from the expected bits in the same way, about two standard deviations, for pairs that are hardly ever below the similarity.
TIGHT_MARGIN = 6.0
PAIRS_AT_ONCE = 1_000_000


def _shingle_sets(column: pa.Array, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted distinct shingles (lower-cased) of each text with words; a text of fewer words than a shingle is one shingle."""
    data, limits = utf8(column)
    for a, b in slices(limits):
        part, lim = data[limits[a] : limits[b]], limits[a : b + 1] - limits[a]
        starts, ends, first = word_spans(part, lim)
        words = word_hashes(part, starts, ends, lower=True)
        grams = gram_hashes(words, shingle)
        for row in range(b - a):
            i, j = int(first[row]), int(first[row + 1])
            if i < j:
                yield a + row, np.unique(grams[i : j - shingle + 1] if j - i >= shingle else gram_hashes(words[i:j], j - i))


def _set_key(own: np.ndarray) -> np.uint64:
    """One number for a whole set of shingles."""
    return mix(mix(own, WIDE_WORDS).sum(dtype=np.uint64, keepdims=True), len(own))[0]


def _hash_wide(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The key and the 256-bit fingerprint of each text's set of shingles; zeros for a text without words."""
    for batch in batches:
        keys, out = np.zeros(len(batch), np.uint64), [bytes(WIDE_BYTES)] * len(batch)
        for row, own in _shingle_sets(batch.column(1), shingle):
            bits = np.unpackbits(np.stack([mix(own, s) for s in range(WIDE_WORDS)], axis=1).view(np.uint8), axis=1)
            keys[row], out[row] = _set_key(own), np.packbits(bits.sum(axis=0, dtype=np.int32) * 2 > len(own)).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys.view(np.int64)), pa.array(out, pa.binary())], names=["doc_id", "node", "fp"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The key and the shingles of each text with words."""
    for batch in batches:
        rows = [own for _, own in _shingle_sets(batch.column(0), shingle)]
        for i in range(0, len(rows), 512):
            some = rows[i : i + 512]
            keys = pa.array(np.array([_set_key(own) for own in some], np.uint64).view(np.int64))
            grams = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]), pa.int32()), pa.array(np.concatenate(some).view(np.int64)))
            yield pa.RecordBatch.from_arrays([keys, grams], names=["node", "grams"])


@lru_cache
def posting_turns(n_texts: int, agree: float) -> tuple[int, int]:
    """Bytes of a posting key, and how often all bytes are posted, for so many texts whose like pairs have bits equal by the chance ``agree``.

    As many turns as it takes for ``TARGET_RECALL`` of random pairs with such bits to meet in some list.
    """
    n_bytes = 2
    while n_texts > LIST_LENGTH << 8 * n_bytes:
        n_bytes += 1
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (1000, 8 * WIDE_BYTES), dtype=np.uint8)
    differ = np.packbits(rng.random(bits.shape) > agree, axis=1)
    apart, turns = np.ones(len(bits), bool), 0
    while apart.mean() > 1 - TARGET_RECALL:
        octets = _dealt(differ[apart], turns)
        equal = octets == 0
        for k in range(1, n_bytes):
            equal = equal & (np.roll(octets, -k, axis=1) == 0)
        apart[np.flatnonzero(apart)[equal.any(axis=1)]] = False
        turns += 1
    return n_bytes, turns


def _dealt(octets: np.ndarray, turn: int) -> np.ndarray:
    """The fingerprints' bits dealt anew to bytes, in an order of the turn's own."""
    order = np.random.default_rng(turn).permutation(8 * WIDE_BYTES) if turn else np.arange(8 * WIDE_BYTES)
    return np.packbits(np.unpackbits(octets, axis=1)[:, order], axis=1)


def _post_wide(batches: Iterator[pa.RecordBatch], n_bytes: int, turns: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint under its positional bytes (turn, place and bytes in one number): each byte with those that follow it, in turns."""
    n = turns * WIDE_BYTES
    for whole in batches:
        for batch in (whole.slice(i, 1024) for i in range(0, len(whole), 1024)):
            node = batch.column(0).to_numpy()
            prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, WIDE_BYTES)
            octets = np.stack([_dealt(prints, t) for t in range(turns)], axis=1).astype(np.int64)
            keys = np.arange(n, dtype=np.int64).reshape(1, turns, WIDE_BYTES)
            for k in range(n_bytes):
                keys = keys << 8 | np.roll(octets, -k, axis=2)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(node, n)), batch.column(1).take(pa.array(np.repeat(np.arange(len(node)), n)))], names=["posting", "node", "fp"])


def _wide_pairs(batches: Iterator[pa.RecordBatch], max_bits: int, tight_bits: int) -> Iterator[pa.RecordBatch]:
    """Pairs to verify of each posting list of a partition: all within ``max_bits``, but of tight groups only a spanning part."""
    pairs, waiting = [np.zeros((0, 2), np.int64)], 0
    for batch in _whole_lists(batches):
        keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        prints = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(-1, WIDE_WORDS)
        order = np.lexsort([ids, keys])  # the same texts come first in all lists, so that lists propose the same pairs
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        for i, j in zip(edge[:-1][np.diff(edge) > 1].tolist(), edge[1:][np.diff(edge) > 1].tolist()):
            rest = order[i:j]
            while len(rest) > 1:
                frontier, rest = [rest[0]], rest[1:]
                while frontier and len(rest):
                    x = frontier.pop()
                    bits = np.bitwise_count(prints[rest] ^ prints[x]).sum(axis=1)
                    near = rest[bits <= max_bits]
                    if not len(near):
                        continue
                    pairs.append(np.sort(np.stack([np.full(len(near), ids[x]), ids[near]], axis=1), axis=1))
                    waiting += len(near)
                    # those not tight stay, to be paired with the rest of the group too: x's link to them may fail where another's holds
                    tight = bits <= tight_bits
                    if tight.any():
                        frontier += list(rest[tight])
                        rest = rest[~tight]
                    if waiting >= PAIRS_AT_ONCE:
                        yield from _pair_batches(pairs)
                        pairs, waiting = [np.zeros((0, 2), np.int64)], 0
    yield from _pair_batches(pairs)


def _pair_batches(pairs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    out = np.unique(np.concatenate(pairs), axis=0)
    for i in range(0, len(out), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(out[i : i + 65536, 0]), pa.array(out[i : i + 65536, 1])], names=["a", "b"])


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, component_id over links of ``similarity`` (exact Jaccard of the sets of shingles) or more."""
    cosine = 2 * similarity / (1 + similarity)
    expected, root = 64 * WIDE_WORDS * np.arccos(cosine) / np.pi, WIDE_WORDS**0.5
    max_bits, tight_bits = int(expected + MARGIN * root), int(expected - TIGHT_MARGIN * root)
    picked = one_row_per_document(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = written(picked.mapInArrow(lambda it: _hash_wide(it, shingle), "doc_id long, node long, fp binary"))
    distinct = written(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp")))
    n_bytes, turns = posting_turns(distinct.count(), 1 - np.arccos(cosine) / np.pi)
    posted = distinct.select("node", "fp").mapInArrow(lambda it: _post_wide(it, n_bytes, turns), "posting long, node long, fp binary")
    lists = posted.repartition(shuffle_width(docs.sparkSession), "posting").sortWithinPartitions("posting")
    proposed = written(lists.mapInArrow(lambda it: _wide_pairs(it, max_bits, tight_bits), "a long, b long").distinct())
    found = components(_verified(picked, distinct, proposed, shingle, similarity))
    return prints.join(_least_ids(distinct.select("node", "least"), "node", found), "node").select("doc_id", "component_id")


def _verified(picked: DataFrame, distinct: DataFrame, proposed: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The proposed pairs (a, b) whose sets of shingles have the Jaccard ``similarity`` or more."""
    wanted = proposed.select(F.col("a").alias("node")).unionByName(proposed.select(F.col("b").alias("node"))).distinct()
    readers = distinct.join(wanted, "node", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    # one set a key, though rows with the same id may repeat
    sets = picked.join(readers, "doc_id", "left_semi").select("text").mapInArrow(lambda it: _sets(it, shingle), "node long, grams array<long>")
    sets = written(sets.groupBy("node").agg(F.first("grams").alias("grams")))
    both = proposed.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("_b")), "b")
    shared = both.withColumn("_shared", F.size(F.array_intersect("_a", "_b")))
    return shared.where(F.col("_shared") / (F.size("_a") + F.size("_b") - F.col("_shared")) >= similarity).select("a", "b")


def keep_one_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows of ``docs``, all columns, that are the least id of their class by ``near_classes``, and rows without an id."""
    gone = near_classes(docs, id_col, text_col, shingle, similarity).where("doc_id <> component_id").select("doc_id").distinct()
    return rows_by_id(docs, gone, id_col, "left_anti")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """Rows of ``docs``, all columns, that are the least id of their class; of rows with the same id all stay."""
    chosen = classes(docs, id_col, text_col, shingle, max_bits).where("doc_id = component_id").select("doc_id").distinct()
    return rows_by_id(docs, chosen, id_col, "left_semi")
