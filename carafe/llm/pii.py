r"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

A window of text around digits, "@" or a spelt-out address is cut into tokens (runs of digits, runs of letters, single characters). A segmentation of a window
gives each token to an entity of one of four types or to nothing. Candidate segments are scored as wholes: their form with the lengths of their
digit runs, how many digits, whether a check digit or the octets hold, what stands at and beyond their edges, and cue words before them. An entity has
``MOST_TOKENS`` tokens at most; a dynamic program over ends of segments finds the best boundaries and types together. So two numbers that
one pattern runs into each other are told apart, and forms that no pattern knows are found.

The field is trained here on the driver, by gradient steps on the exact conditional likelihood (forward and backward over segments), on generated lines and
on windows of ``SAMPLE`` documents of the corpus (least hash of the id; documented bound), labelled by the patterns; windows in which a
pattern's match was dropped are not used, as their truth is unknown.

Scale. One pass over whole texts in Arrow batches, no shuffle; the weights are a fixed size and are broadcast as plain arrays.

Defined results: a null text is empty and has no spans. Repeated rows are scanned each. A null id is left out. An empty table gives an empty
result. Other columns are not read. Spans count code points, end exclusive. The field's spans have the kinds of the patterns; one
that meets a pattern's span is not added.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import one_row_per_document
from .wordhash import utf8

SAMPLE = 512
FEATURE_BITS = 15
KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 24
REACH = 40
Span = tuple[int, int, str]
Weights = dict[str, np.ndarray]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The lookbehind changes no match: a match from within a run of digits would also start at its first digit.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The check digit of card numbers."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(2 * d - 9 * (d > 4) for d in map(int, even))) % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _matches(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """Every match of the patterns, leftmost and non-overlapping by kind, and whether it holds."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last, "email", True
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        yield m.start(), m.end(), "ip", _octets(m[0])
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if len(digits) >= 14:
                yield m.start(), m.end(), "card", len(digits) <= 19 and luhn(digits)
    for m in _PHONE.finditer(text):
        yield m.start(), m.end(), "phone", 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by start, then kind as listed."""
    return ordered([(a, b, k) for a, b, k, holds in _matches(text) if holds])


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|.", re.S)
_SPELT = re.compile(r"(?i)(?<![\w.+-])[\w.+-]+(?P<at>\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+)[\w-]+(?:(?:\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+|\.)[\w-]+)+")
_SPELLS = re.compile(r"(?i)[\[({]\s{0,9}at\s{0,9}[\])}]|\bdot\b")
_MARK = re.compile(r"[0-9]+|@")
_NUMERIC = frozenset(" .-()+/")
_SPELLING = frozenset(" .-_+%@[](){}")


def windows(text: str) -> list[tuple[int, int]]:
    """Where to look: ``REACH`` characters to both sides of digits, "@" and spelt-out addresses, to the next token bounds."""
    marks = [(m.start(), m.end()) for m in _MARK.finditer(text)]
    if _SPELLS.search(text):
        marks = sorted(marks + [(m.start(), m.end()) for m in _SPELT.finditer(text)])
    out: list[tuple[int, int]] = []
    for a, b in marks:
        if out and a - out[-1][1] <= 2 * REACH:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return [(_edge(text, a - REACH, -1), _edge(text, b + REACH, 1)) for a, b in out]


def _edge(text: str, at: int, step: int) -> int:
    """The next place at or beyond ``at`` that doesn't lie within a run of letters or digits."""
    while 0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum():
        at += step
    return min(max(at, 0), len(text))


_CUES = {c: k for k, words in {"p": "call phone tel telephone mobile fax cell tél teléfono telefon ruf", "c": "card visa mastercard amex pan credit kreditkarte carte tarjeta", "i": "ip host server address from inet addr", "m": "mail email e-mail contact write courriel correo", "n": "order invoice isbn version v no id ref item serial account code part ticket nr"}.items() for c in words.split()}


def _form(part: list[str]) -> str:
    """Runs of digits as their length, runs of letters as a, other characters as they are."""
    return "".join(str(len(t)) if t[0].isdigit() else "a" if t[0].isalpha() else t for t in part)


def _side(tokens: list[str], at: int, step: int) -> str:
    """What stands beyond an edge: the next character's class, and past a single separator whether digits go on."""
    if not 0 <= at < len(tokens):
        return "|"
    t = tokens[at]
    kind = "9" if "0" <= t[0] <= "9" else "a" if t[0].isalpha() else t
    if kind in " -./" and 0 <= at + step < len(tokens) and "0" <= tokens[at + step][0] <= "9":
        kind += f"9{min(5, len(tokens[at + step]))}"
    return kind


class Segment:
    """A candidate: tokens start to end, whether it may be an entity (else it is a single token outside), and its features."""

    __slots__ = ("start", "end", "entity", "features")

    def __init__(self, start: int, end: int, entity: bool, named: list[str]) -> None:
        self.start, self.end, self.entity = start, end, entity
        mask = (1 << FEATURE_BITS) - 1
        self.features = [zlib.crc32(x.encode()) & mask for x in named]


WIDTH = 18


def _outside(tokens: list[str], i: int) -> list[str]:
    t = tokens[i]
    kind = f"9{min(20, len(t))}" if "0" <= t[0] <= "9" else "a" if t[0].isalpha() else t if ord(t[0]) < 128 else "?"
    named = ["o", f"o{kind}", f"ol{kind}{_side(tokens, i - 1, -1)}", f"or{kind}{_side(tokens, i + 1, 1)}"]
    return named + ["-"] * (WIDTH - len(named))


def _inside(tokens: list[str], i: int, j: int, cue: str) -> list[str]:
    part = tokens[i:j]
    text, form = "".join(part), _form(part)
    digits = _NOT_DIGIT.sub("", text)
    n = len(digits)
    left, right = _side(tokens, i - 1, -1), _side(tokens, j, 1)
    spelt = "@" if "@" in text else "at" if any(t.lower() == "at" for t in part) else ""
    if spelt:
        tail = re.split(r"(?i)[.\s\[\](){}]+(?:dot[.\s\[\](){}]+)?", text)[-1]
        domain = text.partition("@")[2] if spelt == "@" else ""
        named = [
            "b", f"m{spelt}", f"mt{spelt}{min(8, len(tail))}{tail.isalpha()}", f"mk{tail.lower() if len(tail) < 5 else ''}", f"md{spelt}{min(3, text.count('.'))}{'dot' in text.lower()}", f"ml{spelt}{left}", f"mr{spelt}{right}",
            f"me{spelt}{form[0]}{form[-1]}", f"ms{spelt}{min(4, text.count(' '))}", f"mb{spelt}{sum(text.count(c) for c in '[({')}", f"mw{spelt}{left}{right}", f"mc{spelt}{cue}", f"mo{spelt}{min(3, text.count('@'))}{'.' in domain}", f"mf{form[:6]}",
        ]
    else:
        valid = 13 <= n <= 19 and luhn(digits)
        dots = form.count(".") == 3 and re.fullmatch(r"[0-9]+(\.[0-9]+){3}", text) is not None
        ip = dots and _octets(text)
        groups = [len(g) for g in re.split(r"[^0-9]+", text) if g]
        separators = "".join(sorted(set(_NUMERIC & set(text)))) or "none"
        named = [
            "b", f"s{form}", f"d{min(20, n)}", f"g{len(groups)}", f"v{valid}{min(20, n)}", f"vg{valid}{separators}{max(groups, default=0) > 4}", f"ip{dots}{ip}", f"+{text[0] == '+'}{min(16, n)}", f"x{separators}{text[0] == '+'}",
            f"l{left}", f"r{right}", f"ls{valid}{ip}{text[0] == '+'}{left}", f"rs{valid}{ip}{text[0] == '+'}{right}", f"c{cue}{valid}{ip}", f"cd{cue}{min(16, n)}", f"p{text.count('(') - text.count(')')}{separators}", f"e{groups[-1] if groups else 0}{separators}", f"f{groups[0] if groups else 0}{text[0] == '+'}",
        ]
    return named + ["-"] * (WIDTH - len(named))


def segments(tokens: list[str], low: int = 0, high: int | None = None) -> list[Segment]:
    """Every token from low to high alone as outside, and every candidate entity that starts there: numbers with their separators, and addresses
    around "@" or "at"."""
    high = len(tokens) if high is None else high
    out = [Segment(i, i + 1, False, _outside(tokens, i)) for i in range(low, high)]
    cue = ""
    since = 99
    for i in range(max(0, low - 12), high):
        first = tokens[i]
        numeric = i >= low and (first in "+(" or "0" <= first[0] <= "9")
        if numeric and not (i and "0" <= first[0] <= "9" and "a" <= tokens[i - 1][0].lower() <= "z"):
            n, seen = 0, ""
            for j in range(i, min(len(tokens), i + MOST_TOKENS)):
                t = tokens[j]
                if "0" <= t[0] <= "9":
                    n += len(t)
                    if n > 19:
                        break
                    if n >= 4 and not (j + 1 < len(tokens) and tokens[j + 1][0].isalpha()):
                        out.append(Segment(i, j + 1, True, _inside(tokens, i, j + 1, cue if since <= 6 else "")))
                elif t not in _NUMERIC or t == "+" and j > i or t == " " and seen == " ":
                    break
                seen = t
        if i >= low and first[0].isalnum() and not (i and (tokens[i - 1][0].isalnum() or tokens[i - 1] in "._%+-")):
            at = words = 0
            for j in range(i, min(len(tokens), i + MOST_TOKENS)):
                t = tokens[j]
                if t == "@" or t.lower() == "at":
                    at += 1
                    if at > 1 or j == i:
                        break
                elif t[0].isalnum() and ord(t[0]) < 128:
                    spaced = tokens[j - 1] == " " and j > i
                    if spaced and not at:
                        break
                    if at and j >= i + 2 and not (j + 1 < len(tokens) and (tokens[j + 1][0].isalnum())):
                        words += 1
                        if words > 1:
                            out.append(Segment(i, j + 1, True, _inside(tokens, i, j + 1, cue if since <= 6 else "")))
                elif t not in _SPELLING:
                    break
        if first[0].isalpha():
            cue, since = (_CUES[first.lower()], 0) if first.lower() in _CUES else (cue, since + 2)
        else:
            since += first[0].isdigit()
    return out


def cut(text: str, a: int, b: int) -> tuple[list[str], list[int]]:
    """The window's tokens and where each starts, then the end."""
    found = [(m[0], m.start()) for m in _TOKEN.finditer(text, a, b)]
    return [t for t, _ in found], [s for _, s in found] + [b]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis=axis, keepdims=True), -1e30)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _lse_by(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (sorted in ``key``) and the log of the summed exponentials of their rows."""
    keys, starts = np.unique(key, return_index=True)
    top = np.maximum(np.maximum.reduceat(values, starts, axis=0), -1e30)
    spread = np.repeat(top, np.diff(np.append(starts, len(key))), axis=0)
    return keys, top + np.log(np.add.reduceat(np.exp(values - spread), starts, axis=0))


class Example:
    """A window's segments as arrays, and the index and label of each segment of its right segmentation."""

    def __init__(self, tokens: list[str], begins: list[int], gold: list[Span]) -> None:
        found = segments(tokens)
        self.n = len(tokens)
        self.start = np.array([s.start for s in found])
        self.end = np.array([s.end for s in found])
        self.entity = np.array([s.entity for s in found])
        self.features = np.array([s.features for s in found])
        place = {(begins[s.start], begins[s.end]): k for k, s in enumerate(found) if s.entity}
        chosen = [(place[(a, b)], 1 + KINDS.index(k)) for a, b, k in gold if (a, b) in place]
        self.usable = len(chosen) == sum(a >= begins[0] and b <= begins[-1] for a, b, _ in gold)
        covered = np.zeros(self.n, bool)
        for k, _ in chosen:
            covered[self.start[k] : self.end[k]] = True
        self.gold = sorted(chosen + [(int(i), 0) for i in np.flatnonzero(~covered)], key=lambda x: self.start[x[0]])


LABELS = 1 + len(KINDS)


def train(examples: list[Example], steps: int = 240, rate: float = 0.2, decay: float = 1e-4, batch: int = 96, seed: int = 4) -> Weights:
    """Adaptive gradient steps on the negative log-likelihood of the right segmentations."""
    rng = np.random.default_rng(seed)
    emit, move = np.zeros((1 << FEATURE_BITS, LABELS)), np.zeros((LABELS, LABELS))
    ge, gm = np.full_like(emit, 1e-2), np.full_like(move, 1e-2)
    for _ in range(steps if examples else 0):
        some = [examples[i] for i in rng.choice(len(examples), min(batch, len(examples)), replace=False)]
        who = np.repeat(np.arange(len(some)), [len(e.start) for e in some])
        start, end, entity = (np.concatenate([getattr(e, k) for e in some]) for k in ("start", "end", "entity"))
        feats = np.concatenate([e.features for e in some])
        allowed = np.where(entity[:, None] == (np.arange(LABELS) > 0)[None], 0.0, -1e9)
        score = emit[feats].sum(axis=1) + allowed
        sizes = np.array([e.n for e in some])
        longest = int(sizes.max())
        fore = np.full((len(some), longest + 1, LABELS), -1e9)
        entry = np.full_like(fore, -1e9)  # the best of what comes before, by the label that follows
        back, leave = np.full_like(fore, -1e9), np.full_like(fore, -1e9)
        fore[:, 0, 0] = 0.0
        by_end = np.lexsort((who, end))
        limits = np.searchsorted(end[by_end], np.arange(longest + 2))
        entry[:, 0] = move[0]
        for t in range(1, longest + 1):
            s = by_end[limits[t] : limits[t + 1]]
            if len(s):
                keys, values = _lse_by(who[s], entry[who[s], start[s]] + score[s])
                fore[keys, t] = values
                entry[:, t] = _lse(fore[:, t, :, None] + move[None], 1)
        total = _lse(fore[np.arange(len(some)), sizes], 1)
        back[np.arange(len(some)), sizes] = 0.0
        by_start = np.lexsort((who, start))
        limits = np.searchsorted(start[by_start], np.arange(longest + 2))
        for t in range(longest - 1, -1, -1):
            s = by_start[limits[t] : limits[t + 1]]
            if len(s):
                keys, values = _lse_by(who[s], score[s] + back[who[s], end[s]])
                leave[keys, t] = values
                inner = keys[sizes[keys] > t]
                back[inner, t] = _lse(move[None] + leave[inner, t][:, None, :], 2)
        share = np.exp(entry[who, start] + score + back[who, end] - total[who][:, None])
        pair = np.exp(fore[:, :, :, None] + move[None, None] + leave[:, :, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
        offset = np.concatenate([[0], np.cumsum([len(e.start) for e in some])])
        for k, e in enumerate(some):
            before = 0
            for segment, label in e.gold:
                share[offset[k] + segment, label] -= 1
                pair[before, label] -= 1
                before = label
        de = np.stack([np.bincount(feats.reshape(-1), np.repeat(share[:, y], WIDTH), len(emit)) for y in range(LABELS)], axis=1) / len(some) + decay * emit
        dm = pair / len(some) + decay * move
        ge, gm = ge + de**2, gm + dm**2
        emit -= rate * de / np.sqrt(ge)
        move -= rate * dm / np.sqrt(gm)
    return {"emit": emit, "move": move}


def decode(tokens: list[str], weights: Weights, low: int = 0, high: int | None = None) -> list[tuple[int, int, int]]:
    """The entities of the best segmentation of the tokens from low to high, each as first token, end and label."""
    high = len(tokens) if high is None else high
    found = [s for s in segments(tokens, low, high) if s.end <= high]
    scores = weights["emit"][np.array([s.features for s in found])].sum(axis=1).tolist()
    move = weights["move"].tolist()
    n = high - low
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    for k, s in enumerate(found):
        ends[s.end - low].append(k)
    never = -1e18
    best = [[0.0] + [never] * (LABELS - 1)] + [[never] * LABELS for _ in range(n)]
    way: list[list[tuple[int, int] | None]] = [[None] * LABELS for _ in range(n + 1)]
    for t in range(1, n + 1):
        for k in ends[t]:
            s = found[k]
            for y in range(1, LABELS) if s.entity else (0,):
                for z, value in enumerate(best[s.start - low]):
                    total = value + move[z][y] + scores[k][y]
                    if total > best[t][y]:
                        best[t][y], way[t][y] = total, (k, z)
    out, t = [], n
    y = max(range(LABELS), key=lambda k: best[n][k])
    while t:
        k, z = way[t][y]
        if y:
            out.append((found[k].start, t + low, y))
        t, y = found[k].start - low, z
    return out[::-1]


#: A window of more tokens (a table of numbers) is decoded in runs, so that memory is bounded. Runs end at a character that no candidate holds, which is outside
#: in every segmentation, so the result is that of the whole; only where ``LONGEST / 2`` tokens have none does a run end at any token.
LONGEST = 2000


def field_spans(text: str, weights: Weights) -> list[Span]:
    out: list[Span] = []
    for a, b in windows(text):
        tokens, begins = cut(text, a, b)
        at = 0
        while at < len(tokens):
            to = min(len(tokens), at + LONGEST)
            if to < len(tokens):
                apart = (k for k in range(to, at + LONGEST // 2, -1) if not (tokens[k - 1][0].isalnum() or tokens[k - 1] in _NUMERIC or tokens[k - 1] in _SPELLING))
                to = next(apart, to)
            out += [(begins[i], begins[j], KINDS[y - 1]) for i, j, y in decode(tokens, weights, at, to)]
            at = to
    return out


def scan_text(text: str, weights: Weights) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and all spans."""
    base = base_spans(text)
    taken = sorted((a, b) for a, b, _ in base)
    starts = [a for a, _ in taken]
    furthest = list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    meets = lambda a, b: (k := bisect_left(starts, b)) > 0 and furthest[k - 1] > a
    return base, ordered(base + [s for s in field_spans(text, weights) if not meets(s[0], s[1])])


def generated(n: int = 2400, seed: int = 6) -> list[tuple[str, list[Span]]]:
    """Lines with the places of what is personal in them, among look-alikes."""
    rng = random.Random(seed)
    pick = lambda low, high=None, chars="0123456789": "".join(rng.choice(chars) for _ in range(rng.randint(low, high or low)))
    word = lambda: "".join(rng.choice(["an", "er", "on", "th", "in", "de", "la", "ou", "ré", "st", "ti", "en", "ü", "keit", "ción"]) for _ in range(rng.randint(1, 4)))
    name = lambda: "".join(rng.choice(["an", "er", "on", "th", "in", "de", "la", "ou", "st", "ti", "en"]) for _ in range(rng.randint(1, 4)))
    prose = lambda low, high: " ".join(rng.choice([word, word, word, word, word, lambda: rng.choice(["at", "dot", "from", "for", "the", "and", "to"]), lambda: word() + rng.choice([".", ",", ";"])])() for _ in range(rng.randint(low, high)))
    tail = lambda: rng.choice(["com", "org", "net", "de", "fr", "es", "example.com", "co.uk", "io"])
    group = lambda d, sep, sizes: sep.join(d[sum(sizes[:k]) : sum(sizes[: k + 1])] for k in range(len(sizes)))

    def card(valid: bool = True, sizes: tuple[int, ...] | None = None) -> str:
        sizes = sizes or rng.choice([(16,), (16,), (16,), (16,), (4, 4, 4, 4), (4, 4, 4, 4), (4, 6, 5), (15,), (19,)])
        sep = rng.choice([" ", "-", " ", "."])
        while True:
            d = pick(sum(sizes))
            if luhn(d) == valid:
                return group(d, sep, sizes)

    octet = lambda: str(rng.randint(0, 255))
    phone = lambda: rng.choice([
        lambda: f"+{rng.choice(['1', '1', '1', '49', '33', '34', '44'])} ({pick(3)}) {pick(3)}-{pick(4)}",
        lambda: f"+{rng.choice(['1', '49', '33', '34', '44', '351'])}{rng.choice([' ', '-', '.'])}{pick(2, 3)}{rng.choice([' ', '-', '.'])}{pick(3)}{rng.choice([' ', '-', '.'])}{pick(4)}",
        lambda: f"+{rng.choice(['1', '49', '33', '34', '44'])}{pick(9, 10)}",
        lambda: f"({pick(3)}) {pick(3)}-{pick(4)}",
        lambda: f"{pick(3)}-{pick(3)}-{pick(4)}",
        lambda: f"00{rng.choice(['49', '33', '34', '44'])} {pick(2, 3)} {pick(6, 7)}",
        lambda: f"0{pick(2, 3)} {pick(3)} {pick(4)}",
    ])()
    personal = {
        "email": lambda: rng.choice([
            lambda: f"{name()}.{pick(1, 2)}@{name()}{pick(1)}.example.com", lambda: f"{name()}{rng.choice(['.', '_', '+', '-', ''])}{name()}@{name()}.{tail()}",
            lambda: f"{name()}.{name()} at {name()} dot {rng.choice(['com', 'org', 'net', 'de'])}", lambda: f"{name()} (at) {name()}.{tail()}", lambda: f"{name()}{pick(1, 2)} [at] {name()} [dot] {rng.choice(['com', 'org', 'net', 'de'])}",
            lambda: f"{name()} AT {name()} DOT {rng.choice(['com', 'org', 'net'])}", lambda: f"{name()}{pick(0, 2) if rng.random() < 0.5 else ''} @ {name()}.{tail()}",
        ])(),
        "ip": lambda: ".".join(octet() for _ in range(4)),
        "card": card,
        "phone": phone,
    }
    harmless = [
        lambda: card(False, rng.choice([(16,), (16,), (16,), (4, 4, 4, 4), (15,)])),
        lambda: card(False, (16,)),
        lambda: pick(5, 13),
        lambda: f"{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}",
        lambda: ".".join(str(rng.randint(256, 999)) if k == j else octet() for j in [rng.randint(0, 3)] for k in range(4)),
        lambda: ".".join(octet() for _ in range(5)),
        lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}",
        lambda: f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1900, 2030)}",
        lambda: f"{pick(3)}-{pick(1)}-{pick(2, 4)}-{pick(5)}-{pick(1)}",
        lambda: f"{rng.choice(['$', '€', ''])}{pick(1, 3)}{rng.choice(['.', ',', ' '])}{pick(3)}{rng.choice(['.', ','])}{pick(2)}",
        lambda: f"{rng.choice(['token', 'secret', 'key'])} = \"{pick(12, 40, '0123456789abcdef')}\"",
        lambda: f"{rng.choice(['token', 'secret', 'key'])} = \"{pick(3, 9, '0123456789abcdef')}{pick(8, 18)}{pick(3, 9, 'abcdef')}\"",
        lambda: f"{rng.choice(['order', 'invoice', 'item', 'ref', 'no', 'id', 'serial'])} {pick(4, 14)}",
        lambda: f"@{name()} {name()}@{name()}",
        lambda: f"{name()} at {name()} {name()} at the {name()}.",
        lambda: f"{pick(2, 4)} {pick(2, 4)} {pick(1, 4)} {pick(2, 4)}",
        lambda: f"{pick(1, 2)}/{pick(2)} {pick(5, 7)}-{pick(2, 3)}",
        lambda: f"+{pick(1, 3)} {name()}, +{pick(2)}.{pick(1)}%",
        lambda: f"{pick(1, 4)},{pick(1, 4)},{pick(1, 5)},{pick(1, 3)}",
    ]
    cue = {"email": ["mail", "email", "contact", "write to"], "ip": ["ip", "host", "server", "from"], "card": ["card", "visa", "carte"], "phone": ["call", "tel", "phone", "fax"]}
    out = []
    for _ in range(n):
        text, spans = prose(0, 6), []
        for _ in range(rng.choice([1, 1, 1, 2, 2, 3])):
            text += rng.choice([" ", " ", " ", " ", "\n", ": ", " | ", ", "]) if text else ""
            if rng.random() < 0.6:
                kind = rng.choice(KINDS)
                if rng.random() < 0.25:
                    text += rng.choice(cue[kind]) + rng.choice([" ", ": ", ". "])
                value = personal[kind]()
                spans.append((len(text), len(text) + len(value), kind))
                text += value
            else:
                text += rng.choice(harmless)()
            if rng.random() < 0.6:
                text += rng.choice([" ", " ", " ", ". ", ", ", "\n", "!! ", "$$$ ", ") "]) + prose(0, 4)
        out.append((text + rng.choice(["", " ", ".", " " + prose(1, 5)]), spans))
    return out


def examples_of(text: str, gold: list[Span]) -> list[Example]:
    found = [Example(*cut(text, a, b), gold) for a, b in windows(text)]
    return [e for e in found if e.usable]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Weights from generated lines and from windows of ``SAMPLE`` documents, whose entities are those the patterns find."""
    rows = one_row_per_document(docs, id_col).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    chosen = rows.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    # one text an id, and of it what lies about marks: the sample's size on the driver is bounded by SAMPLE * SAMPLE_BYTES
    sample = rows.join(F.broadcast(chosen.distinct()), "_id").groupBy("_id").agg(F.min("_text").alias("_text")).mapInArrow(_sampled, "_id long, lines array<string>")
    data = [e for text, gold in generated() for e in examples_of(text, gold)]
    for _, lines in sorted(sample.collect()):
        for text in lines:
            found = list(_matches(text))
            if all(holds for *_, holds in found):
                data += examples_of(text, [(a, b, k) for a, b, k, _ in found])
    return train(data)


SAMPLE_BYTES = 20_000


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of sample texts, up to ``SAMPLE_BYTES`` a text."""
    for batch in batches:
        lines = []
        for text in batch.column(1).to_pylist():
            some, room = [], SAMPLE_BYTES
            for a, b in windows(text or ""):
                room -= b - a
                if room < 0:
                    break
                some.append(text[a:b])
            lines.append(some)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.string()))], names=["_id", "lines"])


_MARKED = np.zeros(256, bool)
_MARKED[list(b"0123456789@")] = True


def _marked(column: pa.Array) -> np.ndarray:
    """Rows with a digit or "@"."""
    data, limits = utf8(column)
    return np.diff(np.concatenate([[0], np.cumsum(_MARKED[data])])[limits]) > 0


def _scan(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    nothing = sha256(b"").hexdigest()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "added"]
    for batch in batches:
        rows = []
        for doc_id, text, marked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _marked(batch.column(1))):
            text = text or ""
            if not marked and not _SPELLS.search(text):
                rows.append((doc_id, 0, 0, 0, 0, nothing, "", 0))
                continue
            base, spans = scan_text(text, weights)
            kinds = [k for _, _, k in base]
            rows.append((doc_id, *(kinds.count(k) for k in KINDS), sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in names[5:7] else pa.int64()) for c, n in zip(zip(*rows) if rows else [[]] * 8, names)], names=names)


def scan(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, added (how many spans are the field's): one row per row of ``docs`` with an id."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    picked = one_row_per_document(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lambda it: _scan(it, shared.value), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, added long")
