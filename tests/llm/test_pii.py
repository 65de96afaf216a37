"""Personal data: the patterns against the plain expressions, the field on held-out lines, odd rows."""

import random
import re
from collections import Counter

import pytest

from carafe.llm import pii


@pytest.fixture(scope="module")
def weights():
    return pii.train([e for text, gold in pii.generated() for e in pii.examples_of(text, gold)])


def plain(text):
    """The base spans by the expressions as they are stated."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    check = lambda d: sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(d))) % 10 == 0
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and check(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    found = [(m.start(), list(rules).index(k), m.end(), k) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m[0])]
    return [(a, b, k) for a, _, b, k in sorted(found)]


def test_patterns_equal_the_stated_expressions():
    r = random.Random(3)
    bits = ["a", "b.c", "@", "@@", "x@y.z", ".", "-", "+", "+1", " ", "  ", "(", ")", "1", "12", "255", "256", "00255", "1.2.3.4", "4111111111111111", "5555 5555 5555 4444", "é", "²", "٣", "\n", "%", "_", "+1 (017) 555-7713"]
    for _ in range(6000):
        text = "".join(r.choices(bits, k=r.randint(0, 14)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_time_in_proportion():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1(" * 100_000, "a.b-" * 100_000 + "@", "12 " * 100_000, "@" * 200_000, " " * 300_000 + "dot", "a " * 150_000 + "dot"):
        pii.base_spans(text)
        pii.windows(text)


def test_the_field_on_held_out_lines(weights):
    hit, said, real = Counter(), Counter(), Counter()
    for text, gold in pii.generated(800, seed=1234):
        found = pii.field_spans(text, weights)
        hit.update(k for *_, k in set(found) & set(gold))
        said.update(k for *_, k in found)
        real.update(k for *_, k in gold)
    for kind in pii.KINDS:
        assert hit[kind] >= 0.97 * real[kind] and hit[kind] >= 0.97 * said[kind], (kind, hit, said, real)


def test_what_the_patterns_miss_is_added(weights):
    card, other = "4845168114407329", "7536784127813050"
    for text, want in [
        (f"que elle {other} {card} une", [(other, "card"), (card, "card")]),
        ("Des +1 (826) 555-4081 190.137.223.204 du", [("+1 (826) 555-4081", "phone"), ("190.137.223.204", "ip")]),
        ("write to ander.stin at onthla dot org please", [("ander.stin at onthla dot org", "email")]),
        ("tel: (555) 123-4567, thanks", [("(555) 123-4567", "phone")]),
        ("the order 9807915762804490 of 2024-01-12 at 10:30", []),
        ('token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" and 1.2.3', []),
        ("nothing at all here. dot.", []),
    ]:
        _, spans = pii.scan_text(text, weights)
        assert [(text[a:b], k) for a, b, k in spans] == want, text


def test_base_spans_stay_and_added_ones_do_not_meet_them(weights):
    for text, _ in pii.generated(400, seed=77):
        base, spans = pii.scan_text(text, weights)
        assert base == plain(text) and set(base) <= set(spans)
        more = [s for s in spans if s not in base]
        assert not any(a < d and c < b for a, b, _ in more for c, d, _ in base)


def test_the_best_segmentation_is_found(weights):
    """The dynamic program against every segmentation of short windows."""
    r = random.Random(9)
    for _ in range(25):
        tokens = r.choices(["12", "4845168114407329", " ", "+", "-", "a", "@", ".", "555"], k=7)
        found = pii.segments(tokens)
        score = lambda s, y: weights["emit"][s.features].sum(axis=0)[y]

        def every(at, before):
            if at == len(tokens):
                return 0.0
            return max(weights["move"][before][y] + score(s, y) + every(s.end, y) for s in found if s.start == at for y in (range(1, pii.LABELS) if s.entity else (0,)))

        total, at, before = 0.0, 0, 0
        picked = {i: (j, y) for i, j, y in pii.decode(tokens, weights)}
        while at < len(tokens):
            end, y = picked.get(at, (at + 1, 0))
            s = next(x for x in found if (x.start, x.end, x.entity) == (at, end, y > 0))
            total, at, before = total + weights["move"][before][y] + score(s, y), end, y
        assert abs(total - every(0, 0)) < 1e-6


def test_a_long_table_of_numbers_is_decoded_in_runs(weights, monkeypatch):
    text = ", ".join(f"{n} 4845168114407329" for n in range(1000, 1400))
    whole = pii.field_spans(text, weights)
    monkeypatch.setattr(pii, "LONGEST", 60)
    assert pii.field_spans(text, weights) == whole


def test_odd_rows(frame, weights):
    mail = "ab@cd.example.com"
    rows = [(None, mail, "x"), (1, None, "x"), (2, "", "x"), (3, mail, "x"), (3, mail, "x"), (4, "é" * 50_000 + mail, "x")]
    got = sorted((r.doc_id, r.n_email, r.spans, r.added) for r in pii.scan(frame(rows, "doc_id long, text string, spans string"), weights).collect())
    assert got == [(1, 0, "", 0), (2, 0, "", 0), (3, 1, "email:0:17", 0), (3, 1, "email:0:17", 0), (4, 1, "email:50000:50017", 0)]
    assert pii.scan(frame([], "doc_id long, text string"), weights).collect() == []
    fitted = pii.fit(frame(rows[:3], "doc_id long, text string, _id string"))
    assert fitted["emit"].shape == (1 << pii.FEATURE_BITS, pii.LABELS)
