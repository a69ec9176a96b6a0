"""Operator 10 against brute force; cuts depend on nearby content alone; edge cases."""

import random

from quarry.llm import substring as S


def test_cuts_are_local():
    rng = random.Random(0)
    body = bytes(rng.choices(range(97, 123), k=5000))
    old, new = S.cuts(body).tolist(), S.cuts(b"something else " + body).tolist()
    assert {x + 15 for x in old if x > 100} == {x for x in new if x > 115}
    assert [e.tolist() for e, _ in S.all_chunks([b"", body, b"q", body[:3000]])] == [[], old, [1], S.cuts(body[:3000]).tolist()]
    h = S.gear_hash(b := __import__("numpy").frombuffer(body, "uint8"))
    want = 0
    for k, x in enumerate(b[:200].tolist()):
        want = ((want << 1) + int(S.GEAR[x])) & 0xFFFFFFFF
        assert want == h[k]


def plain_chunks(data):
    """Chunks by the definition, a byte at a time."""
    out, h, last = [], 0, 0
    for k, x in enumerate(data):
        h = ((h << 1) + int(S.GEAR[x])) & 0xFFFFFFFF
        if k + 1 >= 32 and h >> 27 == 0:
            out.append(data[last : k + 1])
            last = k + 1
    return [*out, data[last:]] if last < len(data) else out


def brute(rows, least):
    """Of (doc_id, text, key): chunks that were seen before go, where a run of them has words enough.  Every row counts, repeated ones too."""
    seen, out = set(), []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0], r[2])):
        parts = plain_chunks((text or "").encode())
        later = [x in seen or x in parts[:k] for k, x in enumerate(parts)]
        seen |= set(parts)
        kept, k = b"", 0
        while k < len(parts):
            end = k
            while end < len(parts) and later[end]:
                end += 1
            run = b"".join(parts[k:end])
            rest = b"".join(parts[end:])
            # Bytes of a character that is cut through stay.
            head = len(run) - len(run.lstrip(bytes(range(0x80, 0xC0))))
            tail = 0
            while rest and tail < len(run) - head and (run + rest)[len(run) - tail] & 0xC0 == 0x80:
                tail += 1
            whole = run[head : len(run) - tail]
            kept += run[:head] + run[len(run) - tail :] if len(whole.split()) >= least else run
            if end < len(parts):
                kept += parts[end]
            k = end + 1
        out.append((doc, None if text is None else kept.decode(), len(parts), sum(later)))
    return out


def test_deduplicate(spark):
    rng = random.Random(3)
    words = [f"wö{k}" if k % 7 == 0 else f"word{k}" for k in range(900)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passage, short = prose(60), prose(8)
    rows = [(k, f"{prose(rng.randint(0, 90))} {passage if k % 3 == 0 else short} {prose(30)}") for k in range(30)]
    rows += [(100, rows[4][1]), (None, rows[5][1]), (101, None), (102, ""), (103, "x"), (104, passage), (3, rows[3][1]), (None, rows[5][1]), (None, rows[5][1]), (3, "another text"), (102, "")]
    docs = spark.createDataFrame([(k, t, -1, "r", 5) for k, t in rows], "doc_id long, text string, n_later int, key string, n_chars int").repartition(4)
    got = S.deduplicate(docs).collect()
    want = brute([(r.doc_id, r.text, r.k) for r in docs.select("doc_id", "text", S.row_key().alias("k")).collect()], S.LEAST_WORDS)
    assert sorted([(r.doc_id, r.text, r.n_chunks, r.n_later) for r in got], key=str) == sorted(want, key=str)
    text = {r.doc_id: r.text for r in got if r.doc_id is not None and r.doc_id != 3}
    text[3] = max((r.text for r in got if r.doc_id == 3), key=len)
    # Passages are cut from all but the first; prose of its own and short strings stay.
    assert passage in text[0] and sum(passage[60:250] in (t or "") for t in text.values()) == 1
    assert all(short in text[k] for k in (1, 2, 4))
    kept = S.without_repeats(docs)
    assert kept.schema == docs.schema
    left = {r.doc_id: r for r in kept.collect()}
    assert 101 in left and 102 in left and left[6].n_chars == len(left[6].text) and left[1].n_chars == 5 and left[1].n_later == -1
    assert S.deduplicate(docs.limit(0)).count() == 0


def test_repeated_rows_keep_one(spark):
    rng = random.Random(8)
    text = " ".join(f"word{rng.randrange(900)}" for _ in range(80))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, text)], "doc_id long, text string").repartition(3)
    got = S.deduplicate(docs).collect()
    assert sorted((r.text == text, r.n_later == r.n_chunks) for r in got) == [(False, True)] * 4 + [(True, False)]
    assert [r.doc_id for r in got if r.text == text] == [1]
    assert [r.doc_id for r in S.without_repeats(docs).collect()] == [1]
