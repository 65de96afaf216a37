"""Styles from a dictionary table: against the expression over a small one, and against brute force over a large one."""

import random

from carafe.functions import style
from carafe.operators import styles

APPELLATIONS = [("bourgogne", "pinot_noir", 2, "chardonnay", None), ("cote de nuits", "pinot_noir", 2, "chardonnay", None), ("champagne", "champagne", 2, None, None), ("ay champagne", "champagne", 2, None, None), ("jura", "medium_white", 2, None, "light_red"), ("sake brewery", "sake", 2, None, None)]


def test_styles_equal_those_of_the_expression(spark):
    r = random.Random(4)
    entries = [*style.ENTRIES, *APPELLATIONS]
    words = ["pinot", "noir", "blanc", "Rosé", "brut", "extra", "grenache", "red", "white", "bianca", "reds", "whites", "sake", "sparkling", "bourgogne", "cote", "de", "nuits", "champagne", "jura", "rouge", "brewery", "gin", "sauvignon", "x", "riesling", "ay"]
    texts = [" ".join(r.choices(words, k=r.randint(1, 6))) for _ in range(400)] + ["", "Pinot Noir / Chardonnay", "Château-Sauvignon BLANC!"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), (texts[0],)], "text string")
    got = {x.text: x.key for x in styles.styles_of(df, styles.dictionary(spark, entries)).collect()}
    want = {x.text: x.key for x in df.select("text", style.style_key(df.text, entries).alias("key")).distinct().collect() if x.key}
    assert got == want and len(want) > 250


def greedy(text, entries):
    """Aliases that are taken, by the definition: longest first, then table order, then place."""
    words, taken = text.split(), []
    for alias, *rest in sorted(entries, key=lambda e: -len(e[0])):
        a = alias.split()
        for i in range(len(words) - len(a) + 1):
            if words[i : i + len(a)] == a and not any(s < i + len(a) and i < e for s, e, _ in taken):
                taken.append((i, i + len(a), rest[0]))
    return sorted(taken)


def test_a_dictionary_of_thousands_is_met_as_by_brute_force(spark):
    r = random.Random(6)
    names = [f"w{i}" for i in range(40)]
    aliases = list(dict.fromkeys(" ".join(r.choices(names, k=r.randint(1, 4))) for _ in range(3000)))
    entries = [(a, f"k{i}", 1, None, None) for i, a in enumerate(aliases)]
    texts = list({" ".join(r.choices([*names, "other"], k=r.randint(1, 12))) for _ in range(60)})
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {}
    for x in styles.met(df, styles.trie(styles.dictionary(spark, entries))).collect():
        got.setdefault(x.text, []).append((x.start, x.end, x.key))
    assert {t: sorted(v) for t, v in got.items()} == {t: g for t in texts if (g := greedy(t, entries))}


def test_odd_texts_and_dictionaries(spark):
    empty = styles.dictionary(spark, [])
    texts = spark.createDataFrame([(None,), ("",), ("red",), ("nothing",)], "text string")
    assert [tuple(x) for x in styles.styles_of(texts, empty).collect()] == [("red", "default_red")]
    twice = styles.dictionary(spark, [("Côt", "malbec", 1, None, None), ("cot", "syrah", 1, None, None), ("--", "sake", 0, None, None)])
    assert [x.key for x in styles.styles_of(spark.createDataFrame([("Cot 2019",)], "text string"), twice).collect()] == ["malbec"]
    long = spark.createDataFrame([("x " * 20_000 + "pinot noir " * 500 + "rose",)], "text string")
    assert [x.key for x in styles.styles_of(long, styles.dictionary(spark)).collect()] == ["rose_dry"]  # a style word goes before grapes
    assert styles.styles_of(texts.limit(0), empty).count() == 0
