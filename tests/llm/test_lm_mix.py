"""Operator 8: base score against brute force, the model's probabilities sum to one and beat the base on held-out text, edge cases."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lm_mix as L
from quarry.llm.common import lower_words


def made_of(texts, others=()):
    """Code, pairs and logits from texts; ``others`` have pairs too, but count nothing."""
    data = [np.frombuffer(bytes([L.END]) + L.symbols(x), np.uint8).astype(int) for x in texts]
    code = L.codes(np.bincount(np.concatenate([x[:-1] << 8 | x[1:] for x in data]), minlength=1 << 16).reshape(256, 256))
    keys = np.concatenate([L.pair_keys(parts, before).ravel() for _, parts, before in L.pieces(list(texts))])
    seen, counts = np.unique(keys, return_counts=True)
    pairs = np.union1d(seen, L.encoded_pieces(list(others))[1]) if others else seen
    every = np.zeros(len(pairs), np.int64)
    every[np.searchsorted(pairs, seen)] = counts
    return code, pairs, L.path_logits(pairs, every, code)


def scored(made, texts):
    code, pairs, logits = made
    return L.pair_score(code, L.encoded_pieces(texts)[0], len(texts), pairs, logits)


def test_codes_are_complete():
    counts = np.zeros((256, 256), np.int64)
    counts[97] = np.arange(256) ** 3
    counts[98, 99] = 10**12
    length, nodes, signs = L.codes(counts)
    for before in (97, 98, 5):
        at = range(before << 8, (before + 1) << 8)
        assert sum(2.0 ** -length[k] for k in at) == pytest.approx(1)
        assert len({(tuple(nodes[k, : length[k]]), tuple(signs[k, : length[k]])) for k in at}) == 256
        assert all((nodes[k, length[k] :] == -1).all() and (signs[k, length[k] :] == 0).all() for k in at)
    assert length[98 << 8 | 99] == 1


def test_probabilities_sum_to_one():
    """Of all symbols that can come next, the end included, after a text long enough for weights, matches and counts to have moved."""
    prefix = "the cat sat on the mat and the cat sat " * 9
    data = [L.symbols(prefix)[:-1] + bytes([s]) for s in range(256)]
    every = np.unique(np.concatenate([L.pair_keys([x], [b""]).ravel() for x in data]))
    code, seen, _ = made_of(["the cat sat on the mat " * 20, "another cat"])
    counts = np.zeros(len(every), np.int64)
    counts[np.isin(every, seen)] = 3
    logits = L.path_logits(every, counts, code)

    def bits(x):
        distinct, number = L.encoded_keys(L.pair_keys([x], [b""]))
        return L.pair_score(code, [([0], [x], [b""], distinct, number)], 1, every, logits)[0]

    before = bits(data[0][:-1])
    assert sum(2.0 ** (bits(x) - before) for x in data) == pytest.approx(1, abs=2e-3)


def test_company_does_not_matter():
    texts = ["some words", None, "", "x" * 3000, "again and again words, again and again words"]
    made = made_of(["some words to learn from, again and again"] * 3, texts)
    together = scored(made, texts)
    assert together == pytest.approx([scored(made, [x])[0] for x in texts], rel=1e-4)
    assert together[1] == together[2] < 0


def test_guesses():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (1, 400, 7, 900)]
    guess, run = L.guesses(parts)
    want, right = [], []
    for x in parts:
        streak = 0
        for k in range(len(x)):
            right.append(min(streak, len(L.STRENGTH) - 1))
            last = next((j for j in range(k - 1, L.MATCH - 1, -1) if x[j - L.MATCH : j] == x[k - L.MATCH : k]), None) if k >= L.MATCH else None
            want.append(-1 if last is None else x[last])
            streak = streak + 1 if want[-1] == x[k] else 0
    assert guess.tolist() == want and run.tolist() == right


def order_one(rows, doc):
    """log10 probability of a text by smoothed counts of bytes after the byte before, in training rows."""
    counts = np.ones((256, 256))
    for k, t in rows:
        if k is not None and zlib.crc32(str(k).encode()) % 7 != 2:
            data = np.frombuffer(bytes([L.END]) + L.symbols(t), np.uint8)
            np.add.at(counts, (data[:-1], data[1:]), 1)
    data = np.frombuffer(bytes([L.END]) + L.symbols(dict(rows)[doc]), np.uint8)
    return float(np.log10(counts / counts.sum(1, keepdims=True))[data[:-1], data[1:]].sum())


def test_score(spark):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in ("mon", "tre", "sal", "ver") for b in ("da", "ly", "ing", "est")]
    rows = [(k, " ".join(rng.choice(words, rng.integers(1, 80)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "Monda  MONDA\tunseen"), (None, "monda nowhere"), (7, rows[7][1])]
    docs = spark.createDataFrame([(k, t, "b", 1) for k, t in rows], "doc_id long, text string, block string, at int").repartition(3)
    got = L.score(docs).collect()
    out = lambda k: k is not None and zlib.crc32(str(k).encode()) % 7 == 2
    tokens = lambda t: [*lower_words(t), "end"]
    counts = Counter(w for k, t in rows if k is not None and not out(k) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((k, out(k), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for k, t in rows), key=str)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == want
    held = [r for r in got if r.held_out and r.doc_id < 500]
    # Better than the bytes alone, order by order: a static code of each byte after the one before.
    assert held and sum(r.score for r in held) > sum(order_one(rows, r.doc_id) for r in held)
    assert np.mean([r.bits_per_byte for r in held]) < 2.5
    assert L.score(docs.limit(0)).count() == 0
    none = L.score(docs.where("doc_id is null")).first()
    assert (none.train_tokens, none.n_known, none.base_score) == (0, 0, 0)


def test_pairs_are_exact():
    texts = ["ab", "", None, "the cat sat on the mat", "aé" * 30]
    got = np.concatenate([L.pair_keys(parts, before) for _, parts, before in L.pieces(texts)], 1)
    texts = sorted(texts, key=lambda x: len(x or ""))
    want = []
    for which, order in enumerate(L.ORDERS):
        row = []
        for x in map(L.symbols, texts):
            padded = bytes([L.END]) * 6 + x
            row += [which << 56 | int.from_bytes(padded[k + 6 - order : k + 7][::-1], "little") for k in range(len(x))]
        want.append(row)
    assert got.tolist() == [[which << 56 | sum(b << 8 * j for j, b in enumerate(k.to_bytes(8, "little")[:7])) for k in row] for which, row in enumerate(want)]


def test_segments_carry_on(monkeypatch):
    text = "some words to learn from, again and again, in a text of some length; " * 60
    made = made_of([text], [text, "again"])
    whole = scored(made, [text, "again"])
    monkeypatch.setattr(L, "SEGMENT", 1000)
    assert sum(len(p) for _, parts, _ in L.pieces([text]) for p in parts) == len(L.symbols(text))
    # Segments hand on context, weights and counts: what is lost is a block's end and the reach of matches.
    cut = scored(made, [text, "again"])
    assert cut[0] == pytest.approx(whole[0], rel=0.35) and cut[1] == pytest.approx(whole[1], rel=1e-4)
    alone = sum(scored(made_of([text], [text, text[:1000]]), [text[:1000]]).tolist()) * len(text) / 1000
    assert cut[0] > alone


def test_model_grows_with_the_corpus(spark):
    # 140,000 contexts of four bytes: as hashed into 2**15 slots they gave more bits a byte.
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + k) for k in w) for w in rng.integers(0, 26, (20_000, 7))]
    rows = [(k, " ".join(rng.choice(words, 60))) for k in range(2_000)]
    got = L.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("held_out").collect()
    assert np.mean([r.bits_per_byte for r in got]) < 2.45


def test_last_bytes():
    data = b"some bytes of text" + bytes([L.END])
    assert L.last_bytes(data).tolist() == [int.from_bytes((bytes(8) + data)[k + 1 : k + 9], "big") for k in range(len(data))]
    assert L.last_bytes(b"").tolist() == []
