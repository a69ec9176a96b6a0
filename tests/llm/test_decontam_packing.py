"""Operators 1 and 9 against brute force, with nulls, repeated rows, ties, empty tables and clashing columns."""

import zlib

import numpy as np
import pytest

from quarry.llm import decontam, packing

DOCS = "doc_id long, text string, key string, n_words string, row string"


def documents(spark, rows):
    return spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], DOCS).repartition(3)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven"), (2, "short item"), (3, None), (4, "..."), (None, "zebra yak"), (2, "short item"), (10, "a a a a a a a a a a a a"), (11, "Éa two-three")]
ROWS = [
    (0, "x ONE two, three four five six seven eight nine ten y"),
    (1, "one two three four five six seven eight nine eleven"),
    (2, None),
    (3, ""),
    (4, "a short-item; another SHORT item short"),
    (5, "a " * 15),
    (5, "a " * 15),
    (6, "zebra yak"),
    (7, "éa Éa two three"),
    (None, "short item"),
    (8, "w " * 3000 + "two three four five six seven eight nine ten eleven"),
]


def brute(rows, items, size=10):
    windows = []
    for item, text in items:
        w = decontam.words_of(text)
        windows += [(item, w[k : k + size]) for k in range(max(1, len(w) - size + 1)) if w]
    out = []
    for doc, text in rows:
        w, hit, got = decontam.words_of(text), set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    got.add(item)
        out.append((doc, len(w), len(hit), sorted(str(x) for x in got if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("prune", [500_000, 0])
def test_decontamination(spark, prune):
    docs, items = documents(spark, ROWS), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontam.decontaminate(docs, items, prune_most=prune).collect()), key=str)
    assert got == brute(ROWS, ITEMS)
    kept = decontam.clean_documents(docs, items, prune_most=prune)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def test_clean_rows_of_null_and_repeated_ids_stay(spark):
    rows = [(None, "short item"), (None, "clean words"), (7, "a short item"), (7, "other clean words"), (7, None), (8, "fine")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontam.clean_documents(documents(spark, rows), items)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[1], *rows[3:]], key=str)


def test_decontamination_of_nothing(spark):
    docs, items = documents(spark, ROWS[:3]), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    assert [r.n_hit for r in decontam.decontaminate(docs, items.limit(0)).collect()] == [0, 0, 0]


def test_first_fit_decreasing():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 100):
        sizes = rng.integers(1, 65, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 64)
        room, want = [64] * n, {}
        for i in np.argsort(-sizes, kind="stable"):
            want[i] = next(k for k in range(n) if room[k] >= sizes[i])
            room[want[i]] -= sizes[i]
        assert [want[i] for i in range(n)] == bins.tolist()
        for b in set(bins.tolist()):
            at = 0
            for o, s in sorted((offsets[i], sizes[i]) for i in range(n) if bins[i] == b):
                assert o == at
                at += s


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(1, "Some plain words."), (2, None), (3, "  odd \n\n spaces\t here  and  there "), (4, "long words " * 700), (4, "long words " * 700), (None, "x"), (5, "a<|endoftext|>b <|endoftext|> 's don't x \x1c y"), (6, "q" * 5000), (7, "日本 語🙂 é")]
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(documents(spark, rows), group_rows=3).collect()
    want = []
    for doc, text in rows:
        ids = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        want += [(doc, k, len(ids[k : k + 1024]), zlib.crc32(np.array(ids[k : k + 1024], "<u4").tobytes()), len(ids)) for k in range(0, len(ids), 1024)]
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str) == sorted(want, key=str)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(documents(spark, rows).limit(0)).count() == 0
    assert packing.padding(packing.pack(documents(spark, rows))).first().ids == sum(x[2] for x in want)
