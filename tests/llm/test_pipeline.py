"""The pipeline on a made-up corpus: planted cases go, clean documents stay whole, every kept id is packed once."""

import random

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(1500)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    rows, labels = [], []
    for k in range(500):
        toxic = k % 5 == 0
        rows.append((k, prose(60) + (" vile wretch " if toxic else " ") + prose(10)))
        labels.append((k, 1, int(toxic)))
    passage, item = prose(70), prose(14)
    near = rows[1][1].split()
    near[30] = "changed"
    rows += [(1001, rows[1][1]), (1002, " ".join(near)), (1003, f"{prose(40)} {passage} {prose(40)}"), (1004, f"{prose(50)} {passage} {prose(30)}"), (1005, f"{prose(20)} {item} {prose(20)}"), (1006, None), (1007, "")]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, {}
    for n, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "packing" or docs.columns == columns
    clean = {k for k, _, t in labels if not t}
    assert len(clean - seen["toxicity"].keys()) <= 4 and sum(t for k, _, t in labels if k in seen["toxicity"]) <= 4
    left = seen["ngram_jaccard"].keys()
    assert {1001, 1002} & left == set() and 1 in left and seen["toxicity"].keys() - left == {1001, 1002}
    cut = seen["substring_dedup"]
    assert passage in cut[1003].text and passage[80:300] not in cut[1004].text and cut[1004].n_chars == len(cut[1004].text)
    assert all(cut[k].text == dict(rows)[k] for k in clean & left) and {1006, 1007} <= cut.keys()
    assert seen["substring_dedup"].keys() - seen["decontamination"].keys() == {1005}
    assert seen["packing"].keys() == seen["decontamination"].keys()
    names = {r.doc_id for r in P.run(spark, str(tmp_path)).collect()}
    assert names == seen["packing"].keys()
