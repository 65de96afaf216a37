"""The divergence audit against plain arithmetic, and on odd rows."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from carafe.llm import divergence


def plain(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [[w.translate(lower) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for _, _, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        df, count = Counter(), {}
        for (lg, source, _), found in zip(rows, words):
            if lg == lang:
                df.update(set(found))
                count.setdefault(source, Counter()).update(found)
        kept = sorted(t for t in df if df[t] >= least)
        rate = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        p = {s: rate(c) for s, c in count.items()}
        q = rate(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in p if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


SCHEMA = "lang string, source string, text string"
told = lambda df: sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("n", [60, 400])
def test_the_audit_equals_the_definition(frame, n):
    r = random.Random(n)
    vocabulary = ["the", "The", "a", "Été", "été", "don't", "x9y", "日本", "straße", "I", "İx", "K", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = []
    for _ in range(n):
        source = r.choice([None, "", "s1", "s1", "s1", "s2", "é"])
        rows.append((r.choice(["en", "en", "de", None]), source, None if r.random() < 0.1 else r.choice([" ", "-", "1", "\x00 ", "\n"]).join(r.choices(vocabulary, [40 - i for i in range(len(vocabulary))], k=r.randint(0, 30)))))
    rows += [("empty", "s1", None), ("empty", "s2", "few words"), ("alone", "s1", "a b c")] + rows[:20]
    assert told(divergence.audit(frame(rows, SCHEMA))) == plain(rows)


def test_odd_tables(frame):
    assert divergence.audit(frame([], SCHEMA)).collect() == []
    rows = [("en", "a", "x y"), ("en", "b", None)]
    wide = frame([("t", "z", "r", *row, 1, 2, 3) for row in rows], "term string, zero string, rank string, lang string, source string, text string, n int, p int, weight int")
    assert told(divergence.audit(wide)) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_many_groups_and_flushes_give_the_same(frame, monkeypatch):
    r = random.Random(5)
    rows = [("en", f"s{r.randint(0, 5)}", " ".join(r.choices("alpha beta gamma delta eps zeta eta".split(), k=9))) for _ in range(300)]
    monkeypatch.setattr(divergence, "FEW_GROUPS", 0)
    assert told(divergence.audit(frame(rows, SCHEMA))) == plain(rows)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 300, "source": [s for _, s, _ in rows], "text": [t for _, _, t in rows]})
    merged = lambda batches: sorted((k, sum(x[3] for x in v), sum(x[4] for x in v)) for k, v in _grouped(batches).items())
    whole = merged(divergence._count(iter([batch])))
    monkeypatch.setattr(divergence, "FLUSH", 10)
    assert merged(divergence._count(iter([batch.slice(i, 30) for i in range(0, 300, 30)]))) == whole
    kept = lambda: sorted(tuple(x.values()) for b in divergence._keep(iter(list(divergence._count(iter([batch])))), 10) for x in b.to_pylist())
    flushed = kept()
    monkeypatch.setattr(divergence, "FLUSH", 10**6)
    assert kept() == flushed


def _grouped(batches):
    out = {}
    for b in batches:
        for x in b.to_pylist():
            out.setdefault((x["lang"], x["source"], x["term"]), []).append(tuple(x.values()))
    return out


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 16)
    texts = ["", "word " * 40 + "é" * 50 + " end", "x" * 100, None, "a b"]
    found = [(int(i), t) for rows, part in divergence.pieces(pa.array(texts)) for i, t in zip(rows, part.to_pylist())]
    words = [(i, w) for i, t in found for w in t.split(" ") if w]
    assert words == [(i, w) for i, t in enumerate(texts) for w in (t or "").split()] and len(found) > 12
