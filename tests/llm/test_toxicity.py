"""Operator 5: gradients against differences, windows, held-out accuracy on made-up prose, edge cases."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import toxicity as T


def prose(rng, n, bad):
    words = [*("the of and to in is that it was for".split()), *("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200))]
    rows = []
    for k in range(n):
        text = list(rng.choice(words, rng.integers(3, 150)))
        toxic = int(k % 4 == 0)
        if toxic:
            text[rng.integers(len(text))] = str(rng.choice(bad))
        rows.append((k, " ".join(text), toxic))
    return rows


def test_windows_cover_all_words():
    for n in range(150):
        doc, first, size = T.windows([n])
        seen = {w for f, s in zip(first, size, strict=True) for w in range(f, f + s)}
        assert seen == set(range(n)) and (size <= T.WINDOW).all() and (size > 0).all()


def test_long_words_count_to_their_end():
    assert T.words_of("a" * 24 + " b") == ["a" * 24, "b"]
    for n in range(25, 100):
        run = "".join(chr(0x4E00 + k) for k in range(n))
        pieces = T.words_of(run)
        assert max(map(len, pieces)) <= T.PIECE
        assert all(any(run[k : k + 12] in x for x in pieces) for k in range(n - 11))
    rows = prose(np.random.default_rng(2), 600, ["vilewretch"])
    network = T.train([t for _, t, _ in rows], [y for _, _, y in rows])
    run = "thatwasforthetoinandofisit" * 2
    clean, toxic = network.score([run + "forthewas", run + "vilewretch"])
    assert toxic > clean + 0.1


def test_gradients():
    """Of the whole network (recurrence, attention, word and character embeddings) against differences."""
    rng = np.random.default_rng(0)
    net = T.Network({k: v.astype(np.float64) * 3 for k, v in T.Network.fresh(rng, 3).items()}, {})
    words = ["ab", "longer", "x", "worddd", "mnop"]
    flat, per_word = T.char_rows(words)
    rows = np.array([1, 2, 0, 3, 0])
    ids = np.array([[1, 3, 5], [2, 4, 1], [5, 0, 2], [4, 0, 0]])
    target, weight = np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 2.0])
    _, got = T.gradients(net, ids, rows, flat, per_word, target, weight)
    assert got.keys() == net.w.keys()
    for name, g in got.items():
        spots = np.argsort(-np.abs(g).ravel())[:3].tolist()
        for at in spots:
            i = np.unravel_index(at, g.shape)
            old, loss = net.w[name][i], []
            for step in (1e-5, -1e-5):
                net.w[name][i] = old + step
                loss.append(T.gradients(net, ids, rows, flat, per_word, target, weight)[0])
            net.w[name][i] = old
            assert abs((loss[0] - loss[1]) / 2e-5 - g[i]) < 1e-6 * max(1, abs(g[i])), (name, i)


def test_char_rows():
    words = ["a", "ab", "abc", "überall", "x" * 24]
    flat, per_word = T.char_rows(words)
    assert per_word.tolist() == [len(x) + max(0, min(6, len(x)) - 1) for x in words]
    at = np.concatenate([[0], np.cumsum(per_word)])
    for k, x in enumerate(words):  # the company doesn't matter
        assert T.char_rows([x])[0].tolist() == flat[at[k] : at[k + 1]].tolist()
    assert set(T.char_rows(["wretch"])[0].tolist()) & set(T.char_rows(["wretches"])[0].tolist())


def test_network_learns_without_log_odds_and_unseen_spellings():
    """Ablation: embeddings that start at random, and words that training has never seen."""
    rows = prose(np.random.default_rng(3), 1600, [f"wret{x}" for x in ("ch", "chy", "cho", "chil", "chix", "chen")])
    tests = prose(np.random.default_rng(4), 400, ["wretchunt", "wretchors"])
    network = T.train([t for _, t, _ in rows], [y for _, _, y in rows], odds_start=False)
    scores = network.score([t for _, t, _ in tests])
    toxic = np.array([y for _, _, y in tests]) == 1
    assert (scores[toxic] >= T.THRESHOLD).mean() > 0.9 and (scores[~toxic] < T.THRESHOLD).mean() > 0.95


def test_held_out_recall_on_the_labels(spark):
    from quarry.llm.common import table

    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = T.score(docs, T.fit(docs, labels)).join(labels, "doc_id").where(T.held_out()).select("score", "toxic").collect()
    found = [r.score >= T.THRESHOLD for r in scored if r.toxic == 1]
    # Of 18; some labels are wrong on purpose.
    assert sum(found) >= 0.85 * len(found)
    assert sum(r.score >= T.THRESHOLD for r in scored if r.toxic == 0) <= 0.02 * len(scored)


def test_held_out_accuracy_and_edges(spark):
    rng = np.random.default_rng(1)
    rows = prose(rng, 800, ["vile", "wretch"])
    docs = spark.createDataFrame([(k, t, "a", 1) for k, t, _ in rows], "doc_id long, text string, score string, row int")
    labels = spark.createDataFrame([*((k, 1, y) for k, _, y in rows), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    network = T.fit(docs, labels)
    got = {r.doc_id: r for r in T.score(docs, network).withColumn("out", T.held_out()).collect()}
    assert all(r.out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    out = [(got[k].score >= 0.7, y) for k, _, y in rows if got[k].out]
    assert sum(p == bool(y) for p, y in out) > 0.95 * len(out)
    # Scores don't depend on the company, and the last words of a long text count.
    odd = [(1, None), (2, ""), (3, "..."), (3, "..."), (None, "word " * 5000 + "vile"), (4, "word " * 5000)]
    edge = spark.createDataFrame(odd, "doc_id long, text string")
    assert [r.score for r in T.score(edge, network).collect() if r.doc_id in (1, 2, 3)] == [0, 0, 0, 0]
    assert {r.doc_id: r.score for r in T.score(edge, network).collect()}[None] > 0.7
    kept = T.clean_documents(docs, network)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.score < 0.7}
    # A doc_id that comes with many texts trains one of them.
    again = docs.unionByName(docs.limit(1).withColumn("text", F.explode(F.array(*[F.lit(f"t{k}") for k in range(50)]))))
    assert len(T.training_rows(again, labels)) == len(T.training_rows(docs, labels))
    assert T.fit(docs, labels.limit(0)) is None
    assert T.score(edge, None).agg({"score": "max"}).first()[0] == 0
