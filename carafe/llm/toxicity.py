"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i the presence of hashed term i. The factors give pairs of
terms (an insult and a mention of a group) a weight of their own, which additive weights can't.

Fitting takes at most ``SAMPLE`` labelled rows (least hash of the id first; documented bound) and keeps the ``FEATURES`` hashed terms
that best tell the classes apart in them. The model is a fixed size whatever the corpus is. Scoring reads every text whole, in
numpy over Arrow batches, without a shuffle.

Defined results: null and empty texts get the score of the bias. Of several labels of one document the highest counts; null labels and
ids aren't used. Without both classes among the labels the model is its bias,
and without any labels no document is toxic. Repeated rows are scored each. A null id is left
out of ``score``; ``keep_clean`` passes it through, scored like others. An empty table gives an empty result. Labels,
language, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import one_row_per_document
from .wordhash import slices, utf8, word_hashes, word_spans

SAMPLE = 20_000
BUCKET_BITS = 20
FEATURES = 2048
FACTORS = 4
BATCH = 256
THRESHOLD = 0.3


@dataclass
class Machine:
    bias: float
    slots: np.ndarray  # bucket -> feature or -1
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, rows: np.ndarray, features: np.ndarray, n: int) -> np.ndarray:
        """Scores of n rows from distinct (row, feature) pairs."""
        linear = np.bincount(rows, self.weights[features], n)
        v = self.factors[features]
        sums = np.stack([np.bincount(rows, v[:, f], n) for f in range(v.shape[1])], axis=1)
        squares = np.bincount(rows, (v * v).sum(axis=1), n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + ((sums**2).sum(axis=1) - squares) / 2, -30, 30)))


def term_buckets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of rows: the first row, and distinct (row, hashed term) pairs."""
    data, limits = utf8(column)
    for a, b in slices(limits):
        part, lim = data[limits[a] : limits[b]], limits[a : b + 1] - limits[a]
        starts, ends, first = word_spans(part, lim, terms=True)
        bucket = word_hashes(part, starts, ends, lower=True) >> np.uint64(64 - BUCKET_BITS)
        row = np.repeat(np.arange(b - a, dtype=np.uint64), np.diff(first))
        pairs = np.unique(row << np.uint64(BUCKET_BITS) | bucket)
        yield a, (pairs >> np.uint64(BUCKET_BITS)).astype(np.int64), (pairs & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes] = [b""] * len(batch)
        for at, rows, buckets in term_buckets(batch.column(1)):
            edges = np.searchsorted(rows, np.arange(int(rows.max(initial=-1)) + 2))
            for r in range(len(edges) - 1):
                out[at + r] = buckets[edges[r] : edges[r + 1]].astype("<u4").tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["label", "terms"])


def fit_machine(terms: list[np.ndarray], labels: np.ndarray, steps: int = 3000, rate: float = 0.3, decay: float = 1e-5, seed: int = 7) -> Machine:
    """Screens features by their chi-square with the label, then about ``steps`` adaptive gradient steps on the logistic loss."""
    size, rng = 1 << BUCKET_BITS, np.random.default_rng(seed)
    n, positive = len(labels), int(labels.sum())
    bias = float(np.log((positive + 0.5) / (n - positive + 4.5)))  # one in ten if nothing is known
    empty = Machine(bias, np.full(size, -1, np.int32), np.zeros(1), np.zeros((1, FACTORS)))
    if not 0 < positive < n:
        return empty
    rows = np.repeat(np.arange(n), [len(t) for t in terms])
    flat = np.concatenate(terms).astype(np.int64)
    total = np.bincount(flat, minlength=size).astype(np.float64)
    toxic = np.bincount(flat, labels[rows].astype(np.float64), size)
    expected = total * positive / n
    chi = (toxic - expected) ** 2 / np.maximum(expected * (1 - positive / n), 1e-9)
    chosen = np.argsort(-chi, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[chi[chosen] > 20])
    if not len(chosen):
        return empty
    slots = np.full(size, -1, np.int32)
    slots[chosen] = np.arange(len(chosen))
    features = slots[flat]
    rows, features = rows[features >= 0], features[features >= 0]
    edges = np.searchsorted(rows, np.arange(n + 1))
    m = Machine(bias, slots, np.zeros(len(chosen)), rng.normal(0, 0.05, (len(chosen), FACTORS)))
    gw, gv, gb = np.full(len(chosen), 1e-2), np.full((len(chosen), FACTORS), 1e-2), 1e-2
    for _ in range(max(4, min(120, -(-steps * BATCH // n)))):
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            docs = order[at : at + BATCH]
            lengths = edges[docs + 1] - edges[docs]
            r = np.repeat(np.arange(len(docs)), lengths)
            f = features[np.repeat(edges[docs] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
            error = m.scores(r, f, len(docs)) - labels[docs]
            v = m.factors[f]
            sums = np.stack([np.bincount(r, v[:, k], len(docs)) for k in range(FACTORS)], axis=1)
            dw = np.bincount(f, error[r], len(chosen)) / len(docs) + decay * m.weights
            dv = np.stack([np.bincount(f, error[r] * (sums[r, k] - v[:, k]), len(chosen)) for k in range(FACTORS)], axis=1) / len(docs) + decay * m.factors
            db = error.mean()
            gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
            m.weights -= rate * dw / np.sqrt(gw)
            m.factors -= rate * dv / np.sqrt(gv)
            m.bias -= rate * db / np.sqrt(gb)
    return m


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 by 4."""
    return F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Fits on at most ``SAMPLE`` labelled documents that aren't held out."""
    usable = one_row_per_document(labels, id_col).where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = usable.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    # one text an id, so that rows which repeat a labelled id don't come to the driver
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.min("label").alias("label"))
    rows = texts.select("label", "text").mapInArrow(_term_rows, "label int, terms binary").toArrow()
    terms = [np.frombuffer(x, "<u4") for x in rows.column("terms").to_pylist()]
    order = sorted(range(len(terms)), key=lambda i: terms[i].tobytes())  # a fixed order, whatever the partitions are
    label = (rows.column("label").to_numpy() > 0).astype(np.float64)
    return fit_machine([terms[i] for i in order], label[order])


def _score(batches: Iterator[pa.RecordBatch], fields: dict) -> Iterator[pa.RecordBatch]:
    machine = Machine(**fields)
    for batch in batches:
        out = np.full(len(batch), 0.0)
        done = 0
        for at, rows, buckets in term_buckets(batch.column(batch.num_columns - 1)):
            out[done:at] = machine.scores(np.zeros(0, int), np.zeros(0, int), at - done)
            features = machine.slots[buckets]
            n = int(rows.max(initial=-1)) + 1
            out[at : at + n] = machine.scores(rows[features >= 0], features[features >= 0], n)
            done = at + n
        out[done:] = machine.scores(np.zeros(0, int), np.zeros(0, int), len(batch) - done)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(machine))  # plain arrays: workers need not import this module
    picked = one_row_per_document(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = picked.mapInArrow(lambda it: _score(it, shared.value), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold; without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(machine))  # plain arrays: workers need not import this module
    names = [f"c{i}" for i in range(len(docs.columns))]
    wide = docs.toDF(*names)
    text = names[docs.columns.index(text_col)]
    schema = ", ".join(f"{n} {t}" for n, t in wide.dtypes) + ", score double"
    scored = wide.select("*", F.col(text).cast("string").alias("_text")).mapInArrow(lambda it: _score(it, shared.value), schema)
    return scored.where(F.col("score") < THRESHOLD).select(*names).toDF(*docs.columns)
