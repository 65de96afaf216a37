"""Embeddings, conversations, components, the pipeline and the registered queries."""

import hashlib
import random

import numpy as np

from carafe.llm import chat, embed_dedup
from carafe.llm.runtime import bucket_rank, components


def test_components_of_chains_and_stars(frame):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(6, 40)] + [(7, 7), (6, 5), (300, 299)]
    got = {r.id: r.component for r in components(frame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 40)}, 299: 299, 300: 299}
    assert components(frame([], "a long, b long")).count() == 0


def test_bucket_rank_is_gapless(frame):
    from pyspark.sql import functions as F

    rows = [(i % 3, i) for i in range(1000)]
    got = bucket_rank(frame(rows, "k int, v long"), ["k"], F.pmod(F.xxhash64("v"), F.lit(7)), [F.col("v")], "r").collect()
    for k in range(3):
        assert sorted(x.r for x in got if x.k == k) == list(range(sum(a == k for a, _ in rows)))


def test_embeddings_against_brute_force(frame):
    r = np.random.default_rng(2)
    base = r.normal(size=(60, 16))
    rows = [b + r.normal(scale=s, size=16) for b in base for s in (0.0, 0.02, 0.05, 0.2, 0.3)]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(rows)] + [(1000 + i, [float(x) for x in rows[0]]) for i in range(30)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("inf")] * 16), (2004, [1.0, 2.0]), (2005, [2.0, 4.0]), (2006, [])]
    ids, m = [i for i, _ in data], np.array([v for _, v in data])
    u = m / np.linalg.norm(m, axis=1)[:, None]
    near = u @ u.T >= 0.95
    got = {x.vec_id: x for x in embed_dedup.near_duplicates(frame(data + odd, "vec_id long, embedding array<double>")).collect()}
    links = {i: int(near[k].sum() - 1) for k, i in enumerate(ids)}
    assert sum(got[i].n_links for i in ids) >= 0.99 * sum(links.values()) and all(got[i].n_links <= links[i] for i in ids)
    assert got[2004].n_links == got[2005].n_links == 1 and got[2005].component_id == 2004 and not got[2005].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in (2000, 2001, 2002, 2003, 2006))
    assert embed_dedup.near_duplicates(frame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_just_above_the_threshold(frame):
    r = np.random.default_rng(3)
    a = r.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = r.normal(size=(600, 64))
    b -= (b * a).sum(axis=1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    c = r.uniform(0.951, 0.96, 600)[:, None]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(np.concatenate([a, c * a + np.sqrt(1 - c * c) * b]))]
    got = embed_dedup.near_duplicates(frame(data, "vec_id long, embedding array<double>")).collect()
    assert sum(x.n_links for x in got) >= 0.9 * 1200


def test_chat_round_trip_of_hostile_texts():
    r = random.Random(1)
    bits = ["### ", "assistant: ", "</turn>\n", "<image 0>", "\\", "\\\\", "#", "<", "é", "\n", ":", " ok"]
    for _ in range(500):
        turns = [{"role": r.choice(["user", "assistant", "a:b\\", ""]), "text": "".join(r.choice(bits) for _ in range(r.randrange(8)))} for _ in range(r.randrange(5))]
        seen = chat.format_turns(turns)
        whole = "".join(seen.out)
        assert chat.read_back(whole) == [(t["role"], t["text"]) for t in turns]
        assert "".join(chat.unescape(whole[s["start"] : s["end"]]) for s in seen.loss) == "".join(t["text"] for t in turns if t["role"] == "assistant")


def test_chat_parts(frame):
    parts = [
        {"type": "text", "text": "see <image 0>: "},
        {"type": "image", "ref": "s3://x", "width": 1024, "height": 512},
        {"type": "audio", "ref": "a", "seconds": 2.0},
        {"type": "document", "ref": "d", "pages": 3},
        {"type": "unknown", "text": "kept"},
    ]
    seen = chat.format_turns([{"role": "assistant", "parts": parts}])
    assert [(a["kind"], a["place"], a["tokens"]) for a in seen.attachments] == [("image", 0, 85 + 340), ("audio", 1, 50), ("document", 2, 2400)]
    assert chat.read_back("".join(seen.out)) == [("assistant", "see <image 0>: <image 0><audio 1><document 2>kept")]
    rows = frame([(1, 0, "user", [{"type": "image", "text": None, "ref": "r", "width": 10, "height": 10, "seconds": None, "pages": None}]), (1, 1, None, None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    (got,) = chat.format_conversations(rows, parts_col="parts").collect()
    assert got.n_turns == 2 and got.attachments[0].ref == "r" and got.expanded_tokens == 255


def test_chat_digest_and_edge_cases(frame):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "x"), (1, 0, "user", "x"), (2, None, None, ""), (None, 0, "user", "lost")]
    out = chat.digests(chat.format_conversations(frame(rows, "conv_id long, turn long, role string, text string"))).collect()
    got = {r.conv_id: r for r in out}
    assert set(got) == {1, 2} and got[1].n_turns == 3 and got[1].loss_chars == 0
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nx\nuser\nx\nassistant\n\n").hexdigest()
    assert chat.digests(chat.format_conversations(frame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_pipeline_stages(spark, sf):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for k, (_, stage) in enumerate(c.STAGES):
        docs = stage(spark, docs, sf)
        assert k == len(c.STAGES) - 1 or tuple(docs.columns) == c.COLUMNS
        docs = docs.checkpoint()
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] >= counts[4]
    assert c.run(spark, sf).count() == counts[-1]


def test_pipeline_gives_the_packed_tokens(spark, frame):
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    from carafe.llm import packing

    out = c.pack(spark, frame([(1, "some words"), (2, "and others")], "doc_id long, text string"), "")
    encode = Tokenizer.from_file(packing.tokenizer_path()).encode
    assert {r.doc_id: r.ids for r in out.collect()} == {i: encode(t, add_special_tokens=False).ids + [2] for i, t in ((1, "some words"), (2, "and others"))}
    assert {len(r.ids) for r in packing.sequences(out).collect()} == {sum(r.length for r in out.collect())}


def test_every_query_runs(spark, sf):
    import __spark_entry__ as entry

    for name, query in entry.queries().items():
        if name.startswith("op") and name[2].isdigit():
            assert query(spark, sf).count() > 0, name
