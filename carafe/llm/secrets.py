r"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are runs of the characters of keys, and other characters one by one. A text is one chain: every token of it, a plain word as well, is
tagged begin, inside or outside, and the chain is decoded by Viterbi from "outside" to "outside". Features are the token's shape, length,
alphabet and first characters, the words and shapes around it, how far back a word that announces a secret ("passphrase") lies, and what the file
looks like. Tokens and words are taken whole, whatever their length.

The CRF is trained here, by gradient steps on the exact conditional likelihood (forward-backward), on generated examples of secrets and
of look-alikes, and on ``SAMPLE`` documents of the corpus (least hash of the id; documented bound), labelled by the patterns. Only of these documents are
parts chosen: ``STRETCHES`` of their tokens, and the ``windows`` about what could be a secret.

Scale. One pass over whole texts in Arrow batches, no shuffle; the model is a fixed size. A feature is looked up once for each distinct token (or combination
of classes) and scores are sums of rows of such tables. Scores are whole numbers, so what is found depends neither on the batches nor on the blocks.

Defined results: a null text is empty and has no spans. Repeated rows are scanned each. A null id is left out. An empty table gives
an empty result. Extra columns are not read. Spans count code points, end exclusive; a CRF span that meets a pattern's is not
added.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import one_row_per_document

SAMPLE = 512
#: Of a sample document, windows of more tokens are not trained on, and so many stretches of so many tokens are; all tokens are scanned.
MOST_TRAINED = 48
STRETCHES = 6
FEATURE_BITS = 15
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of [0-9a-f]+ that are long enough
_HINTS = ("passw", "secret", "token", "apikey", "api_key")
_TOKEN = re.compile(r"[A-Za-z0-9+/_.=-]+|[^\sA-Za-z0-9+/_.=-]")
_TOKEN_OR_BREAK = re.compile(_TOKEN.pattern + r"|\n")
_APART = re.compile(r"[^A-Za-z0-9+/_.=-]")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?:[A-Za-z.-]*+[0-9+/_=][A-Za-z0-9+/_.=-]*+|[A-Za-z.-]{24,}+)")
_CUES = ("passphrase", "password", "passwd", "pwd", "passcode", "credential", "bearer", "secret", "apikey", "token", "private key", "recovery phrase")
_CUE = re.compile("(?i)(?<![A-Za-z])(?:" + "|".join(_CUES) + ")(?![A-Za-z])")
MIN_TOKEN = 6
REACH = 3

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The patterns' spans by start, then kind as listed."""
    found: list[Span] = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def tokens_of(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def windows(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The text's tokens (none if it has no window), and the windows about what could be a secret or announces one, as first token and end: what is trained on."""
    coded = [m.start() for m in _CANDIDATE.finditer(text) if m.end() - m.start() >= MIN_TOKEN]
    low = text.lower() if text.isascii() else text
    said = [m.span() for m in _CUE.finditer(text)] if any(c in low for c in _CUES) or not text.isascii() else []
    if not coded and not said:
        return [], []
    tokens = tokens_of(text)
    starts = [a for a, _ in tokens]
    about = [(i - REACH, i + REACH + 1) for i in (bisect_left(starts, a) for a in coded)]
    about += [(bisect_right(starts, a) - 3, bisect_left(starts, b) + 2 * REACH) for a, b in said]
    out: list[tuple[int, int]] = []
    for low_, high in sorted(about):
        low_, high = max(0, low_), min(len(tokens), high)
        if out and low_ <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low_, high))
    return tokens, out


_CLASS = str.maketrans({**{c: "A" for c in string.ascii_uppercase}, **{c: "a" for c in string.ascii_lowercase}, **{c: "0" for c in string.digits}})


_RUN = re.compile(r"(.)\1+")


def shape(token: str) -> str:
    """Character classes with runs collapsed."""
    if token.isascii() and token.isalpha() and token[1:].islower():
        return "a" if token[0].islower() else "Aa"
    return _RUN.sub(r"\1", token.translate(_CLASS))


def file_class(text: str) -> int:
    """What the file looks like, 0 to 11: marks of settings or of code to a hundred characters, in steps."""
    n = max(1, len(text))
    marks = min(3, int(100 * (text.count("=") + text.count(":")) / n))
    code = min(2, int(200 * (text.count("{") + text.count(";") + text.count("(")) / n))
    return 3 * marks + code


_MASK = (1 << FEATURE_BITS) - 1


def _hash(name: str) -> int:
    return zlib.crc32(name.encode()) & _MASK


#: Of features named by a token's string: shape, first and last characters, a word before, a word behind, the shape of the one after that.
_STARTS = [zlib.crc32(x) for x in (b"s", b"p", b"p2", b"e", b"w0", b"w1", b"w2", b"w3", b"n0", b"n1")]


LETTERS = ("hex", "HEX", "num", "dotnum", "mix", "let")
SIZES = 13
FARS = (0, 1, 2, 3, 9)
#: Before a text, and between and behind texts, lie so many empty places; features look so far at most.
PAD = 4
_EMPTY, _BREAK = 0, 1


class Features:
    """Hashed features of the tokens of texts. All but a few belong to a token's string, its neighbours' strings or to combinations of small classes, so each
    is made once and found by number: ``numbers`` counts distinct tokens from 2 on, after the empty place beside a text and the line break."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = _Numbers(self._learn)
        self.known, self.new = np.zeros((0, 17), np.int64), []  # 11 features of the token, 4 as a word before, 2 as a word behind
        self.classes, self.new_classes = np.zeros((0, 4), np.int64), []  # kind (letters, plain, size), cue, mark, and 1 for "=" and ":" or 2 for "@"
        self.marks: dict[str, int] = {}
        self.counted: dict[tuple, list[int]] = {}
        self.marked, self.mark_row = np.zeros((0, 1), np.int64), np.zeros(0, np.int64)
        self.numbers[""], self.numbers["\n"]
        kinds = [(x, plain, size) for x in LETTERS for plain in (False, True) for size in range(SIZES)]
        self.cued = np.array([[_hash(f"c{cue}"), _hash(f"c{far}{x}"), _hash(f"c{far}{plain}{size}")] for cue in ("", *_CUES) for far in FARS for x, plain, size in kinds])
        self.filed = np.array([[_hash(f"f{m}{c}"), _hash(f"f{m}{c}{x}"), _hash(f"f{m}{c}{near}"), _hash(f"at{at}"), _hash(f"q{eq}{x}")] for m in range(4) for c in range(3) for x in LETTERS for near in (False, True) for eq in (False, True) for at in (False, True)])
        self.broken = np.array([[_hash("g" if lead == "first" else f"g{lead}{x}{size}")] for lead in ("", "NL", "first") for x, plain, size in kinds])

    def _learn(self, token: str) -> None:
        alpha, low = token.isalpha(), token.lower()
        size, digits = min(SIZES - 1, len(token) // 4), 0 if alpha else sum(map(str.isdigit, token))
        letters = 0 if not token.strip("0123456789abcdef") else 1 if not token.strip("0123456789ABCDEF") else 2 if digits == len(token) else 3 if not token.strip("0123456789.,/:-") else 4 if digits else 5
        plain = alpha and (token.islower() or token.istitle())
        word = low if low.isalpha() else shape(low)
        about = (letters, size, min(9, 10 * len(set(token)) // max(1, min(len(token), 32))), min(9, 10 * digits // max(1, len(token))), plain, min(14, len(token)))
        if about not in self.counted:
            x = LETTERS[letters]
            self.counted[about] = [*map(_hash, ("bias", f"l{size}", f"v{about[2]}", f"k{x}", f"kl{x}{size}", f"d{about[3]}", f"pl{plain}{about[5]}"))]
        said = word.encode()
        self.new += self.counted[about]
        self.new += [zlib.crc32(x, start) & _MASK for x, start in zip((shape(token).encode(), token[:4].encode(), token[:2].encode(), token[-2:].encode(), said, said, said, said, said, shape(low).encode()), _STARTS)]
        cue = _CUE.search(low) if alpha or size else None
        mark = self.marks.setdefault("w" if low.isalnum() else low, len(self.marks))
        self.new_classes += (letters * 2 * SIZES + plain * SIZES + size, 1 + _CUES.index(cue[0]) if cue else 0, mark, 2 if token == "@" else 1 if low and low in "=:" else 0)

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' tokens by number with ``PAD`` empty places before each text and behind the last, whether a line break lies before each, the class of its
        file, and each text's first place."""
        parts, files, at = [], [], [0]
        for text in texts:
            parts += [np.zeros(PAD, np.int64)] + [np.fromiter(map(self.numbers.__getitem__, _TOKEN_OR_BREAK.findall(piece)), np.int64) for piece in _pieces(text)]
            files.append(file_class(text))
            at.append(len(parts))
        sizes = [len(x) for x in parts]
        found, file = np.concatenate([*parts, np.zeros(PAD, np.int64)]), np.repeat([*files, 0], [*(sum(sizes[a:b]) for a, b in zip(at, at[1:])), PAD])
        token = found != _BREAK
        first = (np.cumsum(token) - token)[np.cumsum([0, *sizes])[at]] + PAD
        broken = np.concatenate([[False], ~token[:-1]])[token]
        return found[token], broken, file[token], first[:-1]

    def groups(self, number: np.ndarray, broken: np.ndarray, file: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of the tokens that have ``PAD`` places on both sides: rows, and the hashed features of each row. Rows are only ever added."""
        if self.new:
            self.known, self.new = np.concatenate([self.known, np.array(self.new).reshape(-1, 17)]), []
            self.classes, self.new_classes = np.concatenate([self.classes, np.array(self.new_classes).reshape(-1, 4)]), []
        n = len(number) - 2 * PAD
        places = {d: number[PAD + d : PAD + d + n] for d in range(-4, 3)}
        kind, cue, mark, sign = self.classes.T
        letters, plain = kind[places[0]] // (2 * SIZES), kind[places[0]] // SIZES % 2
        far, cued = np.full(n, len(FARS) - 1), np.zeros(n, np.int64)
        for d in range(4, 0, -1):
            hit = cue[places[-d]]
            far, cued = np.where(hit > 0, d - 1, far), np.where(hit > 0, hit, cued)
        at = (sign[places[1]] == 2) | (sign[places[2]] == 2) | (sign[places[-1]] == 2)
        lead = np.where(places[-1] == _EMPTY, 2, broken[PAD : PAD + n].astype(np.int64))
        told = (mark[places[-1]] * 2 + plain) * len(FARS) + far
        return [
            (places[0], self.known[:, :11]), *((places[i - 4], self.known[:, 11 + i : 12 + i]) for i in range(4)), (places[1], self.known[:, 15:16]), (places[2], self.known[:, 16:]),
            ((cued * len(FARS) + far) * len(LETTERS) * 2 * SIZES + kind[places[0]], self.cued), ((((file[PAD : PAD + n] * len(LETTERS) + letters) * 2 + (far < 4)) * 2 + (sign[places[-1]] == 1)) * 2 + at, self.filed),
            (lead * len(LETTERS) * 2 * SIZES + kind[places[0]], self.broken), (self._mark_rows(told), self.marked),
        ]

    def _mark_rows(self, told: np.ndarray) -> np.ndarray:
        """The row of the mark before a token with the token's classes. Only those met have one."""
        per = 2 * len(FARS)
        self.mark_row = np.concatenate([self.mark_row, np.full(per * len(self.marks) - len(self.mark_row), -1)])
        met = np.zeros(len(self.mark_row), bool)
        met[told] = True
        fresh = np.flatnonzero(met & (self.mark_row < 0))
        if len(fresh):
            names = list(self.marks)
            self.mark_row[fresh] = len(self.marked) + np.arange(len(fresh))
            self.marked = np.concatenate([self.marked, [[_hash(f"q{names[x // per]}{x // len(FARS) % 2 == 1}{FARS[x % len(FARS)]}")] for x in fresh.tolist()]])
        return self.mark_row[told]

    def matrix(self, text: str) -> np.ndarray:
        """Tokens x hashed features of one text."""
        number, broken, file, _ = self.read([text])
        return np.concatenate([hashed[row] for row, hashed in self.groups(number, broken, file)], axis=1)


class _Numbers(dict):
    """The number of each token; one not met before is learnt."""

    def __init__(self, learn) -> None:
        self.learn = learn

    def __missing__(self, token: str) -> int:
        self.learn(token)
        self[token] = n = len(self)
        return n


def _pieces(text: str, least: int = 1 << 20) -> Iterator[str]:
    """The text in parts that begin between tokens, so that a long one's tokens are never all strings at once."""
    at = 0
    while len(text) - at > least and (cut := _APART.search(text, at + least)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Crf:
    """States outside 0, begin 1, inside 2; a chain starts after and ends before outside."""

    def __init__(self) -> None:
        self.emit = np.zeros((1 << FEATURE_BITS, 3))
        self.move = np.zeros((3, 3))

    def transitions(self) -> np.ndarray:
        move = self.move.copy()
        move[0, 2] = -1e4  # inside can't follow outside
        return move

    def train(self, chains: list[tuple[np.ndarray, np.ndarray]], steps: int = 320, rate: float = 0.15, decay: float = 2e-4, batch: int = 160, seed: int = 3) -> None:
        """chains: (tokens x features, states). Adaptive gradient steps on the negative log-likelihood."""
        rng = np.random.default_rng(seed)
        ge, gm = np.full_like(self.emit, 1e-2), np.full((3, 3), 1e-2)
        for _ in range(steps):
            some = [chains[i] for i in rng.choice(len(chains), min(batch, len(chains)), replace=False)]
            longest = max(len(y) for _, y in some)
            feats = np.zeros((len(some), longest, some[0][0].shape[1]), np.int64)
            gold = np.zeros((len(some), longest), np.int64)
            inside = np.zeros((len(some), longest), bool)
            for i, (f, y) in enumerate(some):
                feats[i, : len(y)], gold[i, : len(y)], inside[i, : len(y)] = f, y, True
            scores, move = self.emit[feats].sum(axis=2), self.transitions()
            fore = np.zeros((len(some), longest, 3))
            back = np.zeros((len(some), longest, 3))
            fore[:, 0] = scores[:, 0] + move[0]
            for t in range(1, longest):
                fore[:, t] = scores[:, t] + _lse(fore[:, t - 1, :, None] + move, 1)
            last = inside.sum(axis=1) - 1
            for t in range(longest - 1, -1, -1):
                step = _lse(move[None] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2) if t + 1 < longest else np.zeros((len(some), 3))
                back[:, t] = np.where((last == t)[:, None], move[:, 0], step)
            total = _lse(fore[np.arange(len(some)), last] + move[:, 0], 1)
            node = np.exp(fore + back - total[:, None, None]) * inside[..., None]
            node -= np.eye(3)[gold] * inside[..., None]
            de = np.stack([np.bincount(feats.reshape(-1), np.repeat(node[..., s].reshape(-1), feats.shape[2]), len(self.emit)) for s in range(3)], axis=1) / len(some) + decay * self.emit
            dm = decay * self.move
            first = np.exp(move[0] + scores[:, 0] + back[:, 0] - total[:, None])
            dm[0] += (first - np.eye(3)[gold[:, 0]]).sum(axis=0) / len(some)
            end = np.exp(fore[np.arange(len(some)), last] + move[:, 0] - total[:, None])
            dm[:, 0] += (end - np.eye(3)[gold[np.arange(len(some)), last]]).sum(axis=0) / len(some)
            for t in range(1, longest):
                pair = np.exp(fore[:, t - 1, :, None] + move + (scores[:, t] + back[:, t])[:, None, :] - total[:, None, None])
                seen = np.eye(3)[gold[:, t - 1]][:, :, None] * np.eye(3)[gold[:, t]][:, None, :]
                dm += ((pair - seen) * inside[:, t, None, None]).sum(axis=0) / len(some)
            ge, gm = ge + de**2, gm + dm**2
            self.emit -= rate * de / np.sqrt(ge)
            self.move -= rate * dm / np.sqrt(gm)

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best states of one chain from its emission scores."""
        move = self.transitions()
        best, back = scores[0] + move[0], []
        for row in scores[1:]:
            way = best[:, None] + move
            back.append(way.argmax(axis=0))
            best = way.max(axis=0) + row
        state = int((best + move[:, 0]).argmax())
        out = [state]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def examples(n: int = 3000, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Generated lines with the places of their secrets: half with one, half with a look-alike."""
    rng = random.Random(seed)
    pick = lambda chars, low, high=None: "".join(rng.choice(chars) for _ in range(rng.randint(low, high or low)))
    alnum, hexa, b64 = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    word = lambda: "".join(rng.choice(["an", "er", "on", "th", "in", "de", "la", "ou", "re", "st", "ti", "en"]) for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    mixed = lambda low, high: pick(alnum, low - 2, high - 2) + rng.choice(string.digits) + rng.choice(string.ascii_letters)
    secret = [
        lambda: (f"{rng.choice(['password', 'passphrase', 'passcode', 'pwd', 'credential'])} {rng.choice(['is', 'was', 'set to', '->', 'equals'])} ", mixed(8, 20)),
        lambda: (f"{rng.choice(['PWD', 'pwd', 'DB_PASS', 'CLIENT_KEY', 'AUTH', 'SIGNING_KEY', 'access_key', 'private_key', 'auth_key'])}{rng.choice(['=', ': ', ' = '])}", mixed(12, 40)),
        lambda: ("Authorization: Bearer ", mixed(24, 48)),
        lambda: ("", rng.choice(["ghp_", "gho_", "sk_live_", "pk_live_", "xoxb-", "glpat-", "npm_", "SG."]) + mixed(24, 36)),
        lambda: ("", "eyJ" + pick(alnum, 16, 30) + ".eyJ" + pick(alnum, 20, 60) + "." + pick(alnum + "_-", 30, 43)),
        lambda: (f"{rng.choice(['aws_secret_access_key', 'AWS_SECRET_ACCESS_KEY'])} = ", pick(b64, 39) + "9"),
        lambda: ("-----BEGIN PRIVATE KEY-----\n", pick(b64, 60) + "8x=="),
        lambda: (f"{rng.choice(['token', 'secret', 'password', 'api key'])} {rng.choice(['is', 'here', 'value', 'below'])} ", mixed(10, 40)),
        lambda: (f"{rng.choice(['postgres', 'mysql', 'amqp', 'redis', 'https', 'ftp'])}://{word()}:", mixed(8, 20)),
        lambda: (f"{rng.choice(['token', 'secret', 'password', 'api_key'])}{rng.choice(['=', ' = ', ': '])}{rng.choice(['', '\"'])}", pick(hexa, 18, 40)),
    ]
    # several tokens: words of a passphrase, lines of a key
    several = [
        lambda: (f"{rng.choice(['passphrase', 'password', 'recovery phrase', 'passcode'])} {rng.choice(['is', 'was', 'set to', 'equals'])} ", " ".join(word() for _ in range(rng.randint(3, 6))), '"'),
        lambda: (f"{rng.choice(['passphrase', 'passcode'])}: ", " ".join(word() for _ in range(rng.randint(3, 5))), "'"),
        lambda: ("-----BEGIN PRIVATE KEY-----\n", "\n".join(pick(b64, 62) + "4y" for _ in range(rng.randint(2, 4))), "\n"),
    ]
    harmless = [
        lambda: f"{rng.choice(['the', 'a', 'your'])} {rng.choice(['password', 'passphrase', 'token', 'secret', 'credential', 'passcode'])} {rng.choice(['must', 'should', 'cannot', 'will'])} {prose(4)}",
        lambda: f"{rng.choice(['password', 'passphrase', 'passcode'])} {rng.choice(['is', 'was'])} {prose(3)}",
        lambda: f"+1 ({pick('23456789', 3)}) {pick(string.digits, 3)}-{pick(string.digits, 4)}",
        lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)),
        lambda: pick(string.digits, 12, 16),
        lambda: f"{word()}.{rng.randint(1, 99)}@{rng.choice(['mail', 'post'])}{rng.randint(1, 9)}.example.com",
        lambda: f"version {rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {rng.randint(10, 23)}:{rng.randint(10, 59)}",
        lambda: f"https://{word()}.example.org/{word()}/{rng.randint(1, 999)}/{word()}",
        lambda: f"commit {pick(hexa, 7, 12)}",
        lambda: f"{word()}_{word()}({word()}_{rng.randint(1, 9)})",
        lambda: f"{word().title()}{rng.randint(10, 99999)}",
        lambda: f"{word()}/{word()} {rng.randint(100, 99999)}.{rng.randint(0, 99)}",
        lambda: f"ISBN {rng.randint(100, 999)}-{rng.randint(1, 9)}-{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}-{rng.randint(1, 9)}",
        lambda: f"{rng.choice(['token', 'secret', 'password'])} {prose(4)}",
        lambda: f"{rng.choice(['order', 'invoice', 'tracking', 'part', 'model', 'serial', 'case', 'flight', 'room', 'ticket'])} {rng.choice(['', 'number ', 'no. ', '# '])}{pick(string.ascii_uppercase, 1, 4)}{rng.choice(['', '-'])}{pick(string.digits, 4, 12)}",
        lambda: f"{rng.choice(['https', 'ftp', 'redis'])}://{word()}.example.net:{rng.randint(1000, 9999)}/{word()}{rng.randint(1, 99)}",
        lambda: f"{word()}_{rng.choice(['', word() + '_'])}{rng.randint(1990, 2030)}{rng.choice(['', '_v2', '-3'])}.{rng.choice(['pdf', 'csv', 'txt', 'zip', 'jpg'])}",
        lambda: "".join(word().title() for _ in range(rng.randint(2, 4))) + str(rng.randint(1, 9)),
        lambda: f"id {pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}",
        lambda: "".join(word() for _ in range(8)) + f"{rng.choice(['.', ',', ''])}",
        lambda: f"{word()}={word()} {word()}: {rng.randint(1, 10**7)}",
    ]
    out = []
    for k in range(n):
        lead, tail = prose(rng.randint(0, 12)), prose(rng.randint(0, 8))
        text = lead + (rng.choice([" ", "\n"]) if lead else "")
        if k % 8 == 1:
            cue, value, quote = rng.choice(several)()
            text += cue + quote
            out.append((f"{text}{value}{quote} {tail}", [(len(text), len(text) + len(value))]))
        elif k % 2:
            cue, value = rng.choice(secret)()
            text += cue
            end = f"@{word()}.example.net:{rng.randint(1000, 9999)}/{word()} " if "://" in cue else rng.choice(["", '"', " ", "\n"])
            out.append((f"{text}{value}{end} {tail}", [(len(text), len(text) + len(value))]))
        else:
            out.append((text + rng.choice(harmless)() + " " + tail, []))
    return out


def labelled(text: str, secrets: list[tuple[int, int]], made: Features) -> tuple[np.ndarray, np.ndarray]:
    """The text's chain as features and states; a token that lies in a secret begins or continues it."""
    states, last = [], None
    for a, b in tokens_of(text):
        hit = next((s for s in secrets if s[0] < b and a < s[1]), None)
        states.append(0 if hit is None else 2 if hit == last else 1)
        last = hit
    return made.matrix(text), np.array(states)


def stretches(text: str, secrets: list[tuple[int, int]], made: Features) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of a sample document: the windows, and ``STRETCHES`` parts from its beginning to its end. Parts that would cut a secret are left out."""
    feats, states = labelled(text, secrets, made)
    n = max(1, len(states) - MOST_TRAINED)
    parts = {(int(a), min(len(states), int(a) + MOST_TRAINED)) for a in np.linspace(0, n - 1, STRETCHES)} | {(a, b) for a, b in windows(text)[1] if b - a <= MOST_TRAINED}
    return [(feats[a:b], states[a:b]) for a, b in sorted(parts) if a < b and states[a] != 2 and (b == len(states) or states[b] != 2)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """Trains on generated lines and on chains of ``SAMPLE`` documents, whose secrets are those the patterns find."""
    rows = one_row_per_document(docs, id_col).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"))
    chosen = rows.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE)
    # one text an id, so that rows which repeat an id change nothing
    sample = sorted((r[0], r[1] or "") for r in rows.join(F.broadcast(chosen.distinct()), "_id").groupBy("_id").agg(F.min("text")).collect())
    made = Features()
    data = [labelled(text, gold, made) for text, gold in examples()]
    data += [c for _, text in sample for c in stretches(text, [(a, b) for a, b, _ in base_spans(text)], made)]
    model = Crf()
    model.train(data)
    return model


#: Scores count in steps of 2 ** -20; no path takes what costs FORBIDDEN if there is another. Steps of a chain done at once lie BLOCK apart.
UNIT = 1 << 20
FORBIDDEN = 1 << 45
BLOCK = 64
#: So many tokens are scored, and texts of so many characters read, at a time; after so many distinct tokens the tables begin anew.
SLAB = 1 << 17
READ = 1 << 20
MOST_KNOWN = 250_000


def best_states(slabs: Iterable[np.ndarray], move: np.ndarray) -> np.ndarray:
    """Viterbi over one chain from "outside" to "outside" whose scores, whole numbers, come in slabs of tokens x states.

    A slab is cut into blocks of ``BLOCK`` tokens, which advance side by side: first what each makes of every state before it, then, from the scores that so
    are known before each block, the best way into every state. States are followed back likewise.
    """
    ways, value, every = [], [0, -FORBIDDEN, -FORBIDDEN], range(3)
    for scores in slabs:
        n = len(scores)
        more = np.zeros((-n % BLOCK, 3), np.int64)
        more[:, 1:] = -FORBIDDEN
        steps = np.ascontiguousarray(np.concatenate([scores, more]).reshape(-1, BLOCK, 3).transpose(1, 2, 0))
        through = np.repeat(np.where(np.eye(3, dtype=bool), 0, -FORBIDDEN)[:, :, None], steps.shape[2], axis=2)
        for step in steps:
            through = (through[:, :, None] + move[None, :, :, None]).max(axis=1) + step
        before = []
        for block in through.transpose(2, 0, 1).tolist():
            before.append(value)
            value = [max(value[i] + block[i][j] for i in every) for j in every]
        best, back = np.array(before, np.int64).T, np.empty(steps.shape, np.uint8)
        for t, step in enumerate(steps):
            way = best[:, None] + move[:, :, None]
            back[t] = way.argmax(axis=0)
            best = way.max(axis=0) + step
            if t == (n - 1) % BLOCK:
                value = best[:, -1].tolist()
        ways.append((back, n))
    state = int((np.array(value) + move[:, 0]).argmax())
    out = []
    for back, n in reversed(ways):
        last = (n - 1) % BLOCK
        came = np.repeat(np.arange(3)[:, None], back.shape[2], axis=1)
        for t in range(BLOCK - 1, -1, -1):
            step = np.take_along_axis(back[t], came, axis=0)
            if t > last:  # the last block ends before
                step[:, -1] = came[:, -1]
            came = step
        ends = []
        for block in came.T.tolist()[::-1]:
            ends.append(state)
            state = block[state]
        now, states = np.array(ends[::-1]), np.empty((BLOCK, back.shape[2]), np.uint8)
        for t in range(BLOCK - 1, -1, -1):
            states[t] = now
            step = back[t][now, np.arange(len(now))]
            if t > last:
                step[-1] = now[-1]
            now = step
        out.append(states.T.reshape(-1)[:n])
    return np.concatenate(out[::-1])


class Tagger:
    """The model's spans of texts. Tables hold the scores of each row of features."""

    def __init__(self, model: Crf) -> None:
        self.emit = np.rint(model.emit * UNIT).astype(np.int64)
        self.move = np.rint(model.transitions() * UNIT).astype(np.int64)
        self._begin()

    def _begin(self) -> None:
        self.made, self.tables = Features(), {}

    def scores(self, number: np.ndarray, broken: np.ndarray, file: np.ndarray) -> np.ndarray:
        total = np.zeros((len(number) - 2 * PAD, 3), np.int64)
        for k, (row, hashed) in enumerate(self.made.groups(number, broken, file)):
            table = self.tables.get(k, np.zeros((0, 3), np.int64))
            if len(table) < len(hashed):
                self.tables[k] = table = np.concatenate([table, self.emit[hashed[len(table) :]].sum(axis=1)])
            total += table[row]
        total[number[PAD:-PAD] == _EMPTY] = 0, -FORBIDDEN, -FORBIDDEN
        return total

    def spans(self, texts: list[str]) -> Iterator[list[Span]]:
        """Texts are one chain; the empty places between them are outside."""
        some, size = [], 0
        for text in texts:
            if some and size + len(text) > READ:
                yield from self._spans(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        if some:
            yield from self._spans(some)

    def _spans(self, texts: list[str]) -> Iterator[list[Span]]:
        if len(self.made.numbers) > MOST_KNOWN:
            self._begin()
        number, broken, file, first = self.made.read(texts)
        n = len(number) - 2 * PAD
        cuts = ((a, min(n, a + SLAB) + 2 * PAD) for a in range(0, max(n, 1), SLAB))
        states = best_states((self.scores(number[a:b], broken[a:b], file[a:b]) for a, b in cuts if b - a > 2 * PAD), self.move) if n else np.zeros(0, np.uint8)
        tagged = np.flatnonzero(states) + PAD
        bounds = np.searchsorted(tagged, [*first, len(number)]).tolist()
        for text, start, low, high in zip(texts, first.tolist(), bounds, bounds[1:]):
            out: list[Span] = []
            tokens = tokens_of(text) if low < high else []
            for k in tagged[low:high].tolist():
                a, b = tokens[k - start]
                if states[k - PAD] == 2:
                    out[-1] = (out[-1][0], b, "crf")
                else:
                    out.append((a, b, "crf"))
            yield out


def crf_spans(text: str, model: Crf) -> list[Span]:
    return next(Tagger(model).spans([text]))


def with_base(text: str, more: list[Span]) -> tuple[list[Span], list[Span]]:
    """The patterns' spans, and all spans."""
    base = base_spans(text)
    return base, ordered(base + [s for s in more if not any(a < s[1] and s[0] < b for a, b, _ in base)])


def scan_text(text: str, model: Crf) -> tuple[list[Span], list[Span]]:
    return with_base(text, crf_spans(text, model))


def _scan(batches: Iterator[pa.RecordBatch], fields: dict) -> Iterator[pa.RecordBatch]:
    model = Crf()
    vars(model).update(fields)
    tagger = Tagger(model)
    for batch in batches:
        rows, texts = [], [text or "" for text in batch.column(1).to_pylist()]
        for doc_id, text, more in zip(batch.column(0).to_pylist(), texts, tagger.spans(texts)):
            base, spans = with_base(text, more)
            kinds = [k for _, _, k in base]
            rows.append((doc_id, *(kinds.count(k) for k in KINDS[:3]), sha256(joined(base).encode()).hexdigest(), joined(spans)))
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in names[4:] else pa.int64()) for c, n in zip(zip(*rows) if rows else [[]] * 6, names)], names=names)


def scan(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row per row of ``docs`` with an id."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))  # plain arrays: workers need not import this module
    picked = one_row_per_document(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lambda it: _scan(it, shared.value), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
