"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit verification.

Texts are sequences of lower-cased terms. Windows start at content-defined places (the least-hashed of every ``ANCHOR`` successive
words), so a passage has the same starts in an item and in a document. From a start, CGK random walks (Chakraborty, Goldenberg,
Koucky, 2016) write a bit a step and move on or stay by a random bit of the word there; few edits leave few differing bits.
``SAMPLES`` random samples of the first bits, from all walks, and the very first bits whole, are looked up among the items'; pairs whose known bits differ in
``MAX_DIFFER`` or less are candidates. The item-sized window around each candidate is verified by exact word-level edit distance
(bit-parallel, any place and length in the window): a hit has at most (1 - ``similarity``) edits per item word.

Items of fewer than ``BLOCKED_BELOW`` words are too short for walks to be sure and are found by blocks, without loss: an item with e edits
allowed is cut into e + 1 blocks, of which e edits leave one as it is. A place with a block of an item is a candidate if all but e of the
item's words lie within e words of where the block puts them (which e edits can't prevent), and is verified in the same way.

Scale. Documents are read once for each ``BLOCKS_PER_PASS`` * ``ITEMS_PER_BLOCK`` = 160,000 items, in numpy over Arrow batches; nothing is
shuffled. Items come to the driver a block at a time and leave it as a broadcast index, so neither the driver nor an executor holds more than
the blocks of a pass, however large the benchmark is.

Defined results: null texts are empty; items without words are not looked for. Items of one to four words allow no edit. Repeated document rows come out
each. Null document or item ids are left out of ``matches``; ``drop_contaminated`` keeps rows without an id. Empty tables give
an empty result, or all documents. Extra columns pass through ``drop_contaminated``.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import one_row_per_document, rows_by_id, union_all
from .wordhash import gram_hashes, slices, utf8, word_hashes, word_spans

U = np.uint64
ANCHOR = 4  # a power of two
WALKS = 3
STEPS = 32
SAMPLED_STEPS = 16
TARGET_RECALL = 0.99
MOST_SAMPLES = 64
SAMPLE_BITS = 18
MAX_DIFFER = 0.25
SHORT_STEPS = 8
BLOCKED_BELOW = 30
PLACES_AT_ONCE = 20_000
LEADING_BITS = 20
ITEMS_PER_BLOCK = 20_000
BLOCKS_PER_PASS = 8
_RNG = random.Random(11)
_STEP = [[U(_RNG.getrandbits(64) | 1) for _ in range(STEPS)] for _ in range(WALKS)]
_MASKS = [U(sum(1 << b for b in _RNG.sample(range(WALKS * SAMPLED_STEPS), SAMPLE_BITS))) for _ in range(MOST_SAMPLES)]
#: The bits of the first steps of all walks: one more sample, which short items have too.
_SHORT = U(sum(1 << (SAMPLED_STEPS * w + j) for w in range(WALKS) for j in range(SHORT_STEPS)))
_ORDER = U(_RNG.getrandbits(64) | 1)


def anchors(words: np.ndarray) -> np.ndarray:
    """Places with the least order hash of some ``ANCHOR`` successive words, in order."""
    if len(words) < ANCHOR:
        return np.zeros(0, np.int64)
    low = U((1 << 26) - 1)
    with np.errstate(over="ignore"):
        key = (words * _ORDER) & ~low | np.arange(len(words), dtype=U)
    size = 1
    while size < ANCHOR:
        key, size = np.minimum(key[:-size], key[size:]), size * 2
    flag = np.zeros(len(words), bool)
    flag[(key & low).astype(np.int64)] = True
    return np.flatnonzero(flag)


def embed(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each start: the bits of each walk (one 32-bit number each), and its place after each step."""
    padded = np.concatenate([words, np.zeros(STEPS + 1, U)])
    bits = np.zeros((WALKS, len(starts)), U)
    reached = np.zeros((WALKS, STEPS, len(starts)), np.int32) if len(starts) < 4096 else None
    with np.errstate(over="ignore"):
        for w in range(WALKS):
            at = starts.copy()
            for j in range(STEPS):
                code = (padded[at] * _STEP[w][j]) >> U(62)
                bits[w] |= (code & U(1)) << U(j)
                at += (code >> U(1)).astype(np.int64)
                if reached is not None:
                    reached[w, j] = at
    return bits, reached


def sampled(bits: np.ndarray) -> np.ndarray:
    """The first bits of all walks in one number."""
    first = U((1 << SAMPLED_STEPS) - 1)
    out = np.zeros(bits.shape[1], U)
    for w in range(WALKS):
        out |= (bits[w] & first) << U(SAMPLED_STEPS * w)
    return out


def best_match(item: list[int], words: list[int], most: int) -> tuple[int, int] | None:
    """The least edit distance of the item to any part of the words, and where that part ends (Myers' bit-parallel search); None above ``most``."""
    n = len(item)
    peq: dict[int, int] = {}
    for i, x in enumerate(item):
        peq[x] = peq.get(x, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, None
    for at, x in enumerate(words):
        eq = peq.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        right = down | ~(diagonal | up) & full
        left = up & diagonal
        score += bool(right & top) - bool(left & top)
        right, left = right << 1 & full, left << 1 & full
        up, down = (left | ~((eq | down) | right)) & full, right & (eq | down)
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


@dataclass
class Index:
    ids: list[int]
    words: np.ndarray  # hashes of all items' words, one after the other
    ends: np.ndarray  # where each item begins, and the end of the last
    item: np.ndarray  # of each entry
    offset: np.ndarray
    bits: np.ndarray  # walks x entries
    known: np.ndarray  # walks x entries: mask of bits written inside the item
    samples: list[tuple[np.uint64, np.ndarray, np.ndarray, np.ndarray]]  # mask, hashes of keys that occur, sorted keys, entries
    blocks: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # words a block, leading bits that occur, sorted keys, entries
    short: np.ndarray  # words of each short item, filled up with zeros (a row of zeros for other items)
    similarity: float

    def of(self, item: int) -> np.ndarray:
        return self.words[self.ends[item] : self.ends[item + 1]]


def edits(n_words: int, similarity: float) -> int:
    return int((1 - similarity) * n_words + 1e-9)


def block_starts(n_words: int, most: int) -> tuple[list[int], int]:
    """Starts and the common length of ``most`` + 1 successive blocks of an item."""
    size = n_words // (most + 1)
    return [size * k for k in range(most + 1)], size


@lru_cache
def samples_needed(similarity: float, target: float = TARGET_RECALL, trials: int = 400) -> int:
    """How many samples find ``target`` of passages that are edited as much as the similarity allows, for the shortest items that walks look for.

    Measured on random items with substitutions, insertions and deletions in equal parts, which is what the rest of the module then does.
    """
    rng = np.random.default_rng(17)
    first = []
    for _ in range(trials):
        own = rng.integers(1, 1 << 63, BLOCKED_BELOW).astype(U)
        put = own.tolist()
        for at in sorted(rng.choice(BLOCKED_BELOW, edits(BLOCKED_BELOW, similarity), replace=False).tolist(), reverse=True):
            new = int(rng.integers(1, 1 << 63))
            put[at : at + 1] = [[new], [], [put[at], new]][rng.integers(3)]
        index = _walks(own)
        there = np.array(put, U)
        bits, _ = embed(there, anchors(there))
        differ = sum(np.bitwise_count((bits[w][:, None] ^ index[1][w]) & index[2][w]) for w in range(WALKS))
        near = differ <= MAX_DIFFER * sum(np.bitwise_count(index[2][w]) for w in range(WALKS))
        mine, its = sampled(bits)[:, None], sampled(index[1])
        whole = (index[2] >> U(SAMPLED_STEPS - 1) & U(1) > 0).all(axis=0)
        met = [bool((near & ((mine ^ its) & _SHORT == 0)).any())] + [bool((near & whole & ((mine ^ its) & m == 0)).any()) for m in _MASKS]
        first.append(met.index(True) if any(met) else MOST_SAMPLES + 1)
    n = int(np.sort(first)[-(-int(target * trials * 100) // 100) - 1])
    if n > MOST_SAMPLES:
        raise ValueError(f"the similarity {similarity} is too low for a recall of {target}")
    return max(1, n)


def _walks(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of an item whose walks write enough bits, the bits, and the masks of those written inside the item."""
    at = anchors(own)
    parts = [embed(own, at[c : c + 4000]) for c in range(0, max(1, len(at)), 4000)]
    bits = np.concatenate([p[0] for p in parts], axis=1)
    steps = np.concatenate([(p[1] < len(own)).sum(axis=1) for p in parts], axis=1)
    steps = np.minimum(steps + 1, STEPS)
    good = (steps >= SHORT_STEPS).all(axis=0)
    return at[good], bits[:, good], (U(1) << steps[:, good].astype(U)) - U(1)


def build_index(items: list[tuple[int, str | None]], similarity: float = 0.8) -> Index:
    data, limits = utf8(pa.array([t for _, t in items], pa.string()))
    starts, ends, first = word_spans(data, limits, terms=True)
    hashes = word_hashes(data, starts, ends, lower=True)
    ids, words, item, offset = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    bits, known = [np.zeros((WALKS, 0), U)], [np.zeros((WALKS, 0), U)]
    by_size: dict[int, list[tuple[np.uint64, int, int]]] = {}
    for k, (ident, _) in enumerate(items):
        own = hashes[first[k] : first[k + 1]]
        if not len(own):
            continue
        ids.append(ident)
        words.append(own)
        if len(own) < BLOCKED_BELOW and (most := edits(len(own), similarity)) < len(own):
            places, size = block_starts(len(own), most)
            grams = gram_hashes(own, size)
            by_size.setdefault(size, []).extend((grams[at], len(ids) - 1, at) for at in places)
            continue
        at, own_bits, own_known = _walks(own)
        item.append(np.full(len(at), len(ids) - 1))
        offset.append(at)
        bits.append(own_bits)
        known.append(own_known)
    bits, known = np.concatenate(bits, axis=1), np.concatenate(known, axis=1)
    keys, samples = sampled(bits), []
    long = np.flatnonzero((known >> U(SAMPLED_STEPS - 1) & U(1) > 0).all(axis=0))
    for mask, some in [(_SHORT, np.arange(len(keys))), *((m, long) for m in _MASKS[: samples_needed(similarity) if len(keys) else 0])] if len(keys) else []:
        order = some[np.argsort(keys[some] & mask, kind="stable")]
        samples.append((mask, _occurring(keys[order] & mask), keys[order] & mask, order))
    blocks, entry = [], len(keys)  # the entries of blocks follow those of walks
    for size, found in sorted(by_size.items()):
        found.sort()
        block_keys = np.array([key for key, _, _ in found], U)
        occurs = np.zeros(1 << LEADING_BITS, bool)
        occurs[block_keys >> U(64 - LEADING_BITS)] = True
        blocks.append((size, occurs, block_keys, np.arange(entry, entry + len(found))))
        item.append(np.array([i for _, i, _ in found]))
        offset.append(np.array([at for _, _, at in found]))
        entry += len(found)
    short = np.zeros((len(ids), BLOCKED_BELOW), U)
    for i, own in enumerate(words):
        if len(own) < BLOCKED_BELOW:
            short[i, : len(own)] = own
    flat, ends = np.concatenate([np.zeros(0, U), *words]), np.cumsum([0, *map(len, words)])
    return Index(ids, flat, ends, np.concatenate(item), np.concatenate(offset), bits, known, samples, blocks, short, similarity)


def _leading(keys: np.ndarray) -> np.ndarray:
    """A short hash of each key."""
    with np.errstate(over="ignore"):
        return (keys * _ORDER) >> U(64 - LEADING_BITS)


def _occurring(keys: np.ndarray) -> np.ndarray:
    """Which short hashes occur; most keys of documents are told apart by this one look."""
    occurs = np.zeros(1 << LEADING_BITS, bool)
    occurs[_leading(keys)] = True
    return occurs


def block_candidates(words: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place of a block, index entry) around which enough of the item's words lie near their places."""
    lengths = np.diff(index.ends)
    for size, occurs, block_keys, block_entries in index.blocks:
        grams = gram_hashes(words, size)
        at = np.flatnonzero(occurs[grams >> U(64 - LEADING_BITS)])
        low, high = np.searchsorted(block_keys, grams[at]), np.searchsorted(block_keys, grams[at], side="right")
        at, low, n = at[high > low], low[high > low], (high - low)[high > low]
        ends = np.cumsum(n)
        done = 0
        while done < len(at):
            # as many places as make PLACES_AT_ONCE pairs, one at least
            to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PLACES_AT_ONCE, side="right")))
            m = n[done:to]
            place = np.repeat(at[done:to], m)
            entry = block_entries[np.repeat(low[done:to] - np.cumsum(m) + m, m) + np.arange(len(place))]
            done = to
            of_length = lengths[index.item[entry]]
            for length in np.unique(of_length).tolist():
                some = np.flatnonzero(of_length == length)
                own, most = index.short[index.item[entry[some]], :length], edits(length, index.similarity)
                expected = (place[some] - index.offset[entry[some]])[:, None] + np.arange(length)
                there = np.zeros(own.shape, bool)
                for shift in range(-most, most + 1):
                    there |= words[np.clip(expected + shift, 0, len(words) - 1)] == own
                some = some[there.sum(axis=1) >= length - most]
                if len(some):
                    yield place[some], entry[some]


def candidates(words: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place, index entry): starts that share a sample and differ in few known bits, and blocks of short items."""
    places, entries = zip(*[walk_candidates(words, index), *block_candidates(words, index)])
    places, entries = np.concatenate(places), np.concatenate(entries)
    if len(places):
        places, entries = np.unique(np.stack([places, entries]), axis=1)
    return places, entries


def walk_candidates(words: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place of a start, index entry) that share a sample and differ in few known bits; a pair may come more than once."""
    starts = anchors(words)
    places, entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if not len(starts) or not index.samples:
        return places[0], entries[0]
    bits, _ = embed(words, starts)
    keys = sampled(bits)
    for mask, occurs, sorted_keys, order in index.samples:
        mine = keys & mask
        some = np.flatnonzero(occurs[_leading(mine)])
        low, high = np.searchsorted(sorted_keys, mine[some]), np.searchsorted(sorted_keys, mine[some], side="right")
        n = high - low
        s = np.repeat(some, n)
        e = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(s))]
        differ = sum(np.bitwise_count((bits[w][s] ^ index.bits[w][e]) & index.known[w][e]).astype(np.int64) for w in range(WALKS))
        total = sum(np.bitwise_count(index.known[w][e]).astype(np.int64) for w in range(WALKS))
        near = differ <= MAX_DIFFER * total
        places.append(starts[s[near]])
        entries.append(e[near])
    return np.concatenate(places), np.concatenate(entries)


_MATCH = "doc_id long, item_id long, distance int, item_words int, end_word long"


def _search(batches: Iterator[pa.RecordBatch], indexes: list, similarity: float) -> Iterator[pa.RecordBatch]:
    opened = [Index(**shared.value) for shared in indexes]
    for batch in batches:
        doc_ids, rows = batch.column(0).to_pylist(), []
        data, limits = utf8(batch.column(1))
        for a, b in slices(limits):
            part, lim = data[limits[a] : limits[b]], limits[a : b + 1] - limits[a]
            starts, ends, first = word_spans(part, lim, terms=True)
            words = word_hashes(part, starts, ends, lower=True)
            for index in opened:
                rows += [(doc_ids[a + doc], index.ids[item], distance, int(index.ends[item + 1] - index.ends[item]), end - int(first[doc])) for (doc, item), (distance, end) in sorted(_best_places(words, first, index, similarity).items())]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=["doc_id", "item_id", "distance", "item_words", "end_word"])


def _best_places(words: np.ndarray, first: np.ndarray, index: Index, similarity: float) -> dict[tuple[int, int], tuple[int, int]]:
    """(document, item): the least distance and where it ends, of the candidates that hold an item."""
    places, entries = candidates(words, index)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    tried: set[tuple[int, int, int]] = set()
    for doc, place, entry in zip((np.searchsorted(first, places, side="right") - 1).tolist(), places.tolist(), entries.tolist()):
        item = int(index.item[entry])
        own = index.of(item).tolist()
        most = edits(len(own), similarity)
        begin = place - int(index.offset[entry])
        if (doc, item, begin) in tried:
            continue
        tried.add((doc, item, begin))
        low = max(begin - 2 * most, int(first[doc]))
        found = best_match(own, words[low : min(begin + len(own) + 2 * most, int(first[doc + 1]))].tolist(), most)
        if found and ((doc, item) not in best or (found[0], low + found[1]) < best[doc, item]):
            best[doc, item] = (found[0], low + found[1])
    return best


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """doc_id, item_id, distance (word edits), item_words, end_word: the best place of each item in each document that holds it."""
    spark = docs.sparkSession
    items = one_row_per_document(benchmark, item_col).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    blocks = max(1, -(-items.count() // ITEMS_PER_BLOCK))
    picked = one_row_per_document(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = []
    for at in range(0, blocks, BLOCKS_PER_PASS):
        shared = []
        for k in range(at, min(at + BLOCKS_PER_PASS, blocks)):
            block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
            # plain arrays: workers need not import this module
            shared.append(spark.sparkContext.broadcast(vars(build_index(sorted((tuple(r) for r in block), key=lambda r: (r[0], r[1] or "")), similarity))))
        found.append(picked.mapInArrow(lambda it, shared=shared: _search(it, shared, similarity), _MATCH))
    return union_all(found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    bad = matches(docs, benchmark, id_col, text_col, similarity=similarity).select("doc_id").distinct()
    return rows_by_id(docs, bad, id_col, "left_anti")
