"""The chain of op2 is the whole text, and decoding many texts at once gives what decoding one token after the other gives."""

import random
import re
import zlib

import numpy as np
import pytest

from carafe.llm import secrets

FIRST = zlib.crc32(b"pzebr") & ((1 << secrets.FEATURE_BITS) - 1)


def test_a_plain_word_far_from_any_number_or_cue_is_tagged(frame):
    model = secrets.Crf()
    model.emit[FIRST] = 0, 9, 0
    text = "a plain zebra went by " + "and by " * 5000 + "a zebra"
    assert secrets.windows(text)[1] == [] and secrets.crf_spans(text, model) == [(8, 13, "crf"), (35024, 35029, "crf")]
    got = {r.doc_id: r.spans for r in secrets.scan(frame([(1, text), (2, "no such word"), (3, None)], "doc_id long, text string"), model).collect()}
    assert got == {1: "crf:8:13,crf:35024:35029", 2: "", 3: ""}


def plain_features(text, tokens, k):
    """Stated token by token."""
    n = max(1, len(text))
    about = f"{min(3, int(100 * (text.count('=') + text.count(':')) / n))}{min(2, int(200 * (text.count('{') + text.count(';') + text.count('(')) / n))}"
    shape = lambda t: re.sub(r"(.)\1+", r"\1", "".join("A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else c for c in t))
    a, b = tokens[k]
    token = text[a:b]
    before = [text[i:j].lower() for i, j in tokens[max(0, k - 4) : k]]
    after = [text[i:j].lower() for i, j in tokens[k + 1 : k + 3]]
    before, after = [""] * (4 - len(before)) + before, after + [""] * (2 - len(after))
    size, digits = min(12, len(token) // 4), sum(c.isdigit() for c in token)
    letters = "hex" if re.fullmatch("[0-9a-f]+", token) else "HEX" if re.fullmatch("[0-9A-F]+", token) else "num" if digits == len(token) else "dotnum" if re.fullmatch(r"[0-9.,/:-]+", token) else "mix" if digits else "let"
    far = next((d for d, w in enumerate(reversed(before)) if secrets._CUE.search(w)), 9)
    cue = secrets._CUE.search(before[3 - far])[0] if far < 9 else ""
    words = [w if w.isalpha() else shape(w) for w in before]
    plain = token.isalpha() and (token.islower() or token.istitle())
    broken = f"g{'NL' if chr(10) in text[tokens[k - 1][1] : a] else ''}{letters}{size}" if k else "g"
    named = ["bias", f"s{shape(token)}", f"l{size}", f"v{min(9, 10 * len(set(token)) // min(len(token), 32))}", f"k{letters}", f"kl{letters}{size}", f"d{min(9, 10 * digits // len(token))}", f"p{token[:4]}", f"p2{token[:2]}", f"e{token[-2:]}", f"pl{plain}{min(14, len(token))}"]
    named += [f"c{cue}", f"c{far}{letters}", f"c{far}{plain}{size}", *(f"w{i}{w}" for i, w in enumerate(words)), f"n0{after[0] if after[0].isalpha() else shape(after[0])}", f"n1{shape(after[1])}", broken]
    named += [f"f{about}", f"f{about}{letters}", f"f{about}{far < 9}", f"at{'@' in after or '@' in before[-1:]}", f"q{before[-1] in '=:' if before[-1] else False}{letters}", f"q{before[-1] if not before[-1].isalnum() else 'w'}{plain}{far}"]
    return [zlib.crc32(x.encode()) & ((1 << secrets.FEATURE_BITS) - 1) for x in named]


def plain_spans(text, model):
    tokens, out = secrets.tokens_of(text), []
    if not tokens:
        return out
    emit, move = np.rint(model.emit * secrets.UNIT), np.rint(model.transitions() * secrets.UNIT)
    whole = secrets.Crf()
    whole.transitions = lambda: move
    for (a, b), state in zip(tokens, whole.viterbi(np.array([emit[plain_features(text, tokens, k)].sum(axis=0) for k in range(len(tokens))]))):
        if state == 1:
            out.append((a, b, "crf"))
        elif state == 2:
            out[-1] = (out[-1][0], b, "crf")
    return out


PARTS = ["the", "Token", "password", "is", "=", ":", "@", "'", "\n", " \n\n ", "é", "²", "ſ", "K", "0", "12:30", "1.2.3.4", "A1B2C3", "deadbeef", "FACE", "Zx9kLm2Qw8", "foo-bar", "pwd=", "x" * 300, "İz", "中文", "{", ";", "private", "key"]


@pytest.mark.parametrize("small", [False, True])
def test_many_texts_at_once_give_what_one_token_after_the_other_gives(monkeypatch, small):
    r, g = random.Random(7), np.random.default_rng(7)
    model = secrets.Crf()
    model.emit, model.move = g.normal(size=model.emit.shape) * 0.4, g.normal(size=(3, 3))
    texts = ["", "a", " \n", *("".join(r.choice(PARTS) + r.choice(["", " ", " "]) for _ in range(r.choice([1, 7, 63, 64, 65, 130, 400]))) for _ in range(40)), ""]
    if small:  # a text over several slabs, tables that begin anew, texts read by pieces
        monkeypatch.setattr(secrets, "SLAB", 128)
        monkeypatch.setattr(secrets, "READ", 500)
        monkeypatch.setattr(secrets, "MOST_KNOWN", 20)
        monkeypatch.setattr(secrets._pieces, "__defaults__", (50,))
    want = [plain_spans(text, model) for text in texts]
    assert list(secrets.Tagger(model).spans(texts)) == want and sum(map(len, want)) > 300
