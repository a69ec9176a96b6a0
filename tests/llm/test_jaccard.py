"""Operator 3 and components against brute force: exact and near copies, hot groups, edge cases."""

import random

import pytest

from quarry.llm import jaccard
from quarry.llm.common import lower_words
from quarry.llm.components import components


def brute(rows, percent=75):
    sets = []
    for doc, text in rows:
        w = lower_words(text)
        sets.append((doc, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    name = list(range(len(rows)))

    def root(k):
        while name[k] != k:
            k = name[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i][1], sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                name[root(i)] = root(j)
    out = []
    for i, (doc, s) in enumerate(sets):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(s), min(ids) if ids else None))
    return sorted(out, key=str)


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


WORDS = [f"w{k}" for k in range(3000)]


def made_up(seed):
    rng = random.Random(seed)
    passage, rows = prose(rng, 40), []
    for _ in range(12):
        base = prose(rng, rng.randint(20, 120))
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append(" ".join(copy))
    rows += [" ".join(passage + prose(rng, n)) for n in range(0, 40, 2)]
    rows += [rows[0]] * 6 + ["a b", "A  b", "a", "", None, " \t ", "one two three four five", "one two three four five six"]
    rng.shuffle(rows)
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, seed):
    rows = made_up(seed)
    docs = spark.createDataFrame([(k, t, "n", 0) for k, t in rows], "doc_id long, text string, node string, part int").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, block_entries=500 * seed, crowd=2 * seed).collect()), key=str)
    assert got == brute(rows)
    if seed == 1:
        kept = jaccard.one_of_each(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _, c in brute(rows) if k == c)


def test_edges(spark):
    docs = spark.createDataFrame([(None, "x y z"), (None, "q r s"), (3, "x y z"), (3, "x y z"), (4, None), (4, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard.join(docs).collect()), key=str) == sorted([(None, 3), (None, None), (3, 3), (3, 3), (4, 4), (4, 4)], key=str)
    assert sorted(((r.doc_id, r.text) for r in jaccard.one_of_each(docs).collect()), key=str) == [(3, "x y z"), (4, None), (None, "q r s")]
    assert jaccard.join(docs.limit(0)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(0, 60) if k % 20] + [(100, k) for k in range(101, 140)] + [(7, 7), (5, 107)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    for a, b in links:
        assert a == b or got[a] == got[b]
    assert got[120] == 1 and got[25] == 21 and got[60] == 41


def test_hot_groups(spark):
    """One n-gram in every document, one text in every batch, and a template of 0.67 that links nothing."""
    rng = random.Random(9)
    template, common, copy = prose(rng, 60), prose(rng, 5), " ".join(prose(rng, 30))
    rows = []
    for k in range(300):
        if k % 3 == 0:
            own = list(template)
            own[2 + k % 9 : 5 + k % 9] = [f"own{k}", f"mine{k}", f"self{k}"]
            rows.append((k, " ".join(own)))
        else:
            rows.append((k, copy if k % 3 == 1 else " ".join(common + prose(rng, 40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, block_entries=400).collect()), key=str)
    assert got == brute(rows)
