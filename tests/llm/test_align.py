"""Operator 13 against a brute force over whole texts: pieces, whole texts, stripes, shares, edge cases."""

import hashlib
import random
from collections import defaultdict
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import align


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers as P
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), decoders.ByteLevel()


def tokens(tools, text):
    """[(id, begin, end)] of both sides, nothing where the bytes differ.  A's ends come from its offsets in a text of one character a byte."""
    a, b, _ = tools
    if not text:
        return [], []
    data = (" " + text).encode()
    byte = {}
    for k in range(256):
        byte[_letter(k)] = k
    out = []
    for ids, raw in ((a.encode(" " + text, add_special_tokens=False).ids, lambda k: bytes(byte[c] for c in a.id_to_token(k))), (b.encode(text), lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode())):
        side, at = [], 0
        joined = b""
        for k in ids:
            joined += raw(k)
            side.append((k, at, len(joined)))
            at = len(joined)
        if joined != data:
            return [], []
        out.append(side)
    return out


def _letter(k):
    from tokenizers.pre_tokenizers import ByteLevel

    if not hasattr(_letter, "table"):
        # The alphabet in code point order: characters from 256 on stand for the bytes that aren't printable, in order.
        letters = sorted(ByteLevel.alphabet(), key=ord)
        own = {ord(c): c for c in letters if ord(c) < 256}
        rest = iter([c for c in letters if ord(c) >= 256])
        _letter.table = [own.get(b) or next(rest) for b in range(256)]
    return _letter.table[k]


def brute(tools, rows):
    held, made = defaultdict(int), []
    for doc, text in rows:
        a, b = tokens(tools, text)
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        for pair in set(links):
            held[pair] += 1
        ends = sorted({x[2] for x in a} & {x[2] for x in b})
        groups = ["|".join(",".join(str(x[0]) for x in side if lo <= x[1] and x[2] <= hi) for side in (a, b)) for lo, hi in zip([0, *ends], ends, strict=False)]
        made.append((doc, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return sorted([(doc, n, m, len(g), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if n else "") for doc, n, m, g, links in made], key=str)


def found(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, "x", 0) for k, t in rows], "doc_id long, text string, stripe string, block int").repartition(3)
    got = align.align(docs, **options)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


ODD = ["", None, " ", "\n", "a\nb c", " a", "a ", "a  b", "a\t\nb", "a\n\nb", "don't we'll", "<|endoftext|> <s></s>", "x<|endoftext|>y", "▁a", "a▁b", "é́ ﬁ Å", "日本語のテキスト 中文。", "𝒳𝒴 ​", "a\x00b", "﻿x", "0x0A <0x0A>", "abc" * 400, "a b", "Ünïcödé straße", "a\r\nb", " x y"]


def test_whole(spark, tools):
    rng = random.Random(4)
    words = ["the", "of", "tokenizer", "Straße", "naïve", "12345", "x,y", "(ab)", "—", "été", "\nline", "日本"]
    rows = [(k, t) for k, t in enumerate(ODD)]
    rows += [(100 + k, " ".join(rng.choices(words, k=rng.randint(1, 40))).strip()) for k in range(60)]
    rows += [(None, "the of"), (100, rows[40][1]), (100, rows[40][1])]
    want = brute(tools, rows)
    assert found(spark, rows) == want
    assert found(spark, rows, wide_stripe=5_000, block=300, share=2) == want


@settings(max_examples=200, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n.,'aé1"), st.characters(codec="utf-8")), max_size=30))
def test_text(tools, text):
    own = align.aligner_of()
    got, codes = own.documents([text])
    a, b = tokens(tools, text)
    assert got[0][:2] == (len(a), len(b))
    assert sorted(codes.tolist()) == sorted(x[0] * own.n_b + y[0] for x in a for y in b if x[1] < y[2] and y[1] < x[2])


def test_given_texts(tools):
    """Aligned by pieces as by whole texts, on the driver's documents."""
    path = Path("/root/testdata/sf0.001/documents.parquet")
    if not path.exists():
        pytest.skip("no test data")
    import pyarrow.parquet as pq

    texts = pq.read_table(path)["text"].to_pylist()
    own = align.aligner_of()
    got, _ = own.documents(texts)
    for text, x in zip(texts, got, strict=True):
        a, b = tools[0].encode(" " + text, add_special_tokens=False).ids if text else [], tools[1].encode(text) if text else []
        (groups,), figures, _ = own.aligned([b" " + text.encode()], [a], [b]) if text else ([""], [[0] * 5], None)
        assert x == ((*figures[0][:4].tolist(), hashlib.sha256(groups[:-1].encode()).hexdigest()) if groups else (0, 0, 0, 0, ""))


def test_memory(tools, monkeypatch):
    """Pieces are forgotten when there are too many, with the same results."""
    monkeypatch.setattr(align, "MOST", 20)
    own = align.aligner_of()
    own.clear()
    texts = [f"word{k} other{k // 2} the" for k in range(40)]
    once = [own.documents([t])[0][0] for t in texts]
    assert once == own.documents(texts)[0]


def test_empty(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert found(spark, [(1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")]
