"""Vector codes against plain integer arithmetic, and on odd rows."""

import math
from hashlib import sha256

import numpy as np
import pytest

from carafe.llm import vector_codes


def plain(rows):
    """{vec_id: (code, error, label_error)} and the digest, by the definition; ids are unique."""
    kept = sorted((i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    size = len(kept[0][2]) // 4
    cut = [[v[p * size : (p + 1) * size] for p in range(4)] for _, _, v in kept]
    books = [[c[p] for c in cut[:256]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(groups[k]) for col in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(4)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for (_, lab, _), e in zip(kept, error):
        by_label[lab] = by_label.get(lab, 0) + e
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{k:02x}" for _, k in f), e, by_label[lab]) for (i, lab, _), f, e in zip(kept, found, error)}, digest


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("n", [3, 300])
def test_codes_equal_the_definition(frame, n):
    r = np.random.default_rng(n)
    base = r.normal(scale=0.3, size=(40, 8))
    # ids not in the order of rows, equal vectors, negative ids, a null label as a group
    rows = [(997 * i % 1009 - 200, [float(x) for x in base[i % 40] + r.normal(scale=(0.0, 0.2)[i % 2], size=8)], (None, 1, 2)[i % 3]) for i in range(n)]
    odd = [(2000, None, 1), (2001, [None] + [1.0] * 7, 1), (2002, [float("inf")] * 8, 1), (2003, [float("nan")] * 8, None)]
    want, digest = plain(rows + odd)
    got = vector_codes.compress(frame(rows + odd, SCHEMA)).collect()
    assert {g.vec_id: (g.code, g.error, g.label_error) for g in got} == want and {g.codebooks_sha256 for g in got} == {digest}


def test_lengths_sizes_repeats_and_other_columns(frame):
    one = [0.5, -0.25, 0.125, 1.0]
    rows = [(None, one, 1, "x"), (1, [1.0] * 3, 1, "x"), (2, [], 1, "x"), (3, one, 1, "x"), (3, one, 1, "y"), (4, [1.0] * 8, 1, "x"), (5, [2.0**40] * 4, 1, "x"), (6, [0.0] * 4, None, "x")]
    got = vector_codes.compress(frame(rows, "vec_id long, embedding array<double>, label int, code string")).collect()
    # the repeated row takes an entry of its own, which no part reaches: ties go to the lower index
    assert sorted((g.vec_id, g.code, g.error) for g in got) == [(3, "00000000", 0), (3, "00000000", 0), (6, "02020202", 0)]
    assert vector_codes.compress(frame([], SCHEMA)).collect() == []
    assert vector_codes.compress(frame([(1, None, 1)], SCHEMA)).collect() == []


def test_bounds_hold_and_few_candidates_are_compared():
    r = np.random.default_rng(7)
    for scale in (2, 300, 1 << 23):
        entries, x = r.integers(-scale, scale, (256, 16)), r.integers(-scale, scale, (500, 16))
        entries[200] = entries[3]
        table = vector_codes.cells(entries)
        exact = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        least, most = vector_codes.bounds(x, table)
        assert (least <= exact).all() and (exact <= most).all()
        index, distance, compared = vector_codes.nearest(x, table)
        assert (index == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
        assert compared < 20 * len(x)
