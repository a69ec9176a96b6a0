"""Operator 11 against brute force: blocks, split pivots, languages, edge cases, exact scores."""

import random
import re
from collections import Counter

import pytest

from quarry.llm import phrases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, covers=80, top=2000):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            if w:
                n[lang] += len(w)
            for m in range(1, 5):
                f.setdefault(lang, Counter()).update(tuple(w[k : k + m]) for k in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        c = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in c.items():
            if any(len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) and 100 * b >= covers * a for q, b in c.items()):
                continue
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, x, y, n[lang], -score) for rank, (score, a, p, x, y) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def made_up(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(25)] + ["É", "é", "the", "The", "ab\x1cc", "x y", "𝒳"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for _ in range(n):
        text = "".join(w + rng.choice([" "] * 9 + ["  ", "\t", ". ", ",", "\n", "\r\n", "?!", "\x0b", "; "]) for w in rng.choices(words, weights, k=rng.randint(0, 60)))
        rows.append((text, rng.choice(["en", "en", "fr", None, "und", ""])))
    return rows + [(None, "en"), ("", "en"), (" . ,\n", "de"), ("w0 " * 300, "en"), ("w1 w1. " * 50, "fr")]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(t, x, "n", 7, "w") for t, x in rows], "text string, lang string, word string, id int, block string").repartition(3)
    got = phrases.collocations(docs, **options)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed, options", [(1, {}), (2, {"block": 200, "hot": 40, "most": 50}), (3, {"block": 9, "hot": 7, "most": 20})])
def test_mined(spark, seed, options):
    rows = made_up(seed)
    assert found(spark, rows, least=4, **options) == brute(rows, 4)
    if seed == 2:
        assert found(spark, rows, least=4, top=5, **options) == brute(rows, 4, top=5)


def test_long_text(spark):
    """Parts of one text see three words of each other; a word may be longer than a block."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choices(["a", "b", "c", "dd"], k=3000)) + " " + "z" * 500 + " a b", "en")]
    assert found(spark, rows, least=30, block=64) == brute(rows, 30)


def test_empty(spark):
    assert found(spark, [(None, None)]) == []
    assert phrases.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_wide_numbers():
    """Vocabularies beyond 8 and 16 bits, in one block."""
    import numpy as np

    rng = np.random.default_rng(3)
    number = np.sort(rng.choice(1 << 20, 500, replace=False))
    codes = rng.integers(0, 501, 4000).astype(np.int32)
    t = phrases.rewritten("en", 7, codes, 0, 0, (np.arange(1, 501), number, np.full(500, 8)))
    got = Counter()
    for row in t.to_pylist():
        kind = next(k for a, b, k in phrases.WIDTHS if a <= row["pivot"] < b)
        shape, times, words = np.frombuffer(row["shapes"], np.uint8), np.frombuffer(row["times"], np.uint32).astype(np.int64), np.frombuffer(row["words"], kind).astype(np.int64)
        ids, n = phrases.local_phrases(np.full(len(shape), row["pivot"]), shape, times, np.zeros(len(shape), bool), words, 1)
        assert (ids.max(1) == row["pivot"]).all()
        for p, k in zip(ids.tolist(), n.tolist(), strict=True):
            got[tuple(x for x in p if x >= 0)] += k
    want = Counter()
    plain = [int(number[c - 1]) if c else -1 for c in codes]
    for m in range(2, 5):
        want.update(tuple(plain[k : k + m]) for k in range(len(plain) - m + 1) if min(plain[k : k + m]) >= 0)
    assert got == want
