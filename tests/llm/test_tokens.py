"""Operators 2 and 6: exact recounts after edits, permutation, round trip of shards, resumed reads, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import token_counts as C
from quarry.llm import token_output as O
from quarry.llm.bytes_bpe import END, encoding

TEXTS = ["It's  plain.\n\nText with spaces \t and   'll contractions", "x" * 900, " lead and trail ", "日本語 の テキスト 🙂 " * 60, "a b " * 500, "", "one"]


def test_edits_are_exact():
    rng, count = random.Random(0), lambda x: len(encoding().encode_ordinary(x))
    for text in [*TEXTS, *(" ".join(rng.choice(["it's", "a", "  ", "\n", "word,", "12345", "é", "don't"]) for _ in range(400)) for _ in range(6))]:
        for leaf in (8, 64):
            leaves, now = C.cut(text, leaf), text
            assert "".join(leaves) == text
            tree = C.Tree([len(x) for x in leaves], [count(x) for x in leaves])
            assert tree.total == (len(text), count(text))
            for _ in range(25):
                at, remove, insert = rng.randint(0, len(now) + 3), rng.randint(0, 12), rng.choice(["", " ", "  ", "\n", "'s", "x", " new words here ", "9 9"])
                want = now[: min(at, len(now))] + insert + now[min(at, len(now)) + remove :]
                now, _ = C.edit(now, tree, at, remove, insert, count)
                assert now == want and tree.total == (len(now), count(now))


def test_recount(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(50, None), (None, "no id"), (1, TEXTS[1])]
    docs = spark.createDataFrame([(k, t, "c", 3) for k, t in rows], "doc_id long, text string, chars string, n_tokens int")
    got = C.recount(C.trees(docs), C.standard_edits()).collect()
    count = lambda x: len(encoding().encode_ordinary(x))
    want = []
    for k, t in rows:
        t = t or ""
        new = "Document: " + t
        new = new[: len(t) // 2] + " [redacted] " + new[len(t) // 2 + 5 :] + " [end]" if len(t) // 2 + 5 <= len(new) else None
        want.append((k, count(t), count(new), len(new)))
    assert sorted(((r.doc_id, r.n_tokens, r.n_tokens_after, r.n_chars_after) for r in got), key=str) == sorted(want, key=str)
    # Of a long text only the regions near edits are encoded again.
    long = spark.createDataFrame([(1, "many plain words " * 5000)], "doc_id long, text string")
    assert C.recount(C.trees(long), C.standard_edits()).first().n_encoded_chars < 3000
    assert C.recount(C.trees(docs), F.lit(None)).agg({"n_edits": "sum"}).first()[0] == 0
    assert C.recount(C.trees(docs.limit(0)), C.standard_edits()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel(n):
    slots = O.feistel(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert n < 1000 or (slots != O.feistel(np.arange(n), n, key=7)).any()


def test_shards(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(50, None), (None, "no id"), (1, TEXTS[1])]
    docs = spark.createDataFrame([(k, t, "c") for k, t in rows], "doc_id long, text string, slot string").repartition(3)
    got = O.shards(docs, length=16, per_shard=8).orderBy("shard").collect()
    n = sum(r.n for r in got)
    assert [r.first_slot for r in got] == [8 * k for k in range(len(got))]
    assert all(r.n == 8 for r in got[:-1]) and all(len(r.payload) == r.n * 32 == r.n * r.stride for r in got)
    O.write_shards(O.shards(docs, length=16, per_shard=8), f"{tmp_path}/shards")
    back = O.read_shards(spark, f"{tmp_path}/shards").collect()
    assert sorted(r.slot for r in back) == list(range(n))
    # The spans put every document together again.
    pieces: dict = {}
    for r in back:
        ids, at = np.frombuffer(r.payload, "<u2"), 0
        for s in r.spans:
            pieces.setdefault(s.doc_id, {}).setdefault(s.start, []).append(ids[at : at + s.length].tolist())
            at += s.length
        assert at == r.n_tokens and (ids[at:] == END).all()
    for k, t in rows:
        whole = [x for s in sorted(pieces[k]) for x in pieces[k][s][0]]
        if k != 1:
            assert whole == [*encoding().encode_ordinary(t or ""), END]
    assert sum(r.n_tokens for r in back) == sum(len(encoding().encode_ordinary(t or "")) + 1 for _, t in rows)
    some = O.read_shards(spark, f"{tmp_path}/shards", 11).collect()
    assert sorted(r.slot for r in some) == list(range(11, n))
    assert {r.slot: r.ids_crc32 for r in some}.items() <= {r.slot: r.ids_crc32 for r in back}.items()
    assert O.shards(docs.limit(0)).count() == 0
