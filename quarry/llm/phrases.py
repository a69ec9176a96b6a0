"""Operator 11: phrase collocation mining with pivot partitioning, as in MG-FSM.

Words of a language are numbered from the most frequent one down, so of the words of a
phrase the one with the largest number is the rarest: its pivot.  A text is rewritten for
each occurrence of a word as pivot: of the words about it only those stay that are no
rarer, up to the reach of a phrase, and on the left none that is the pivot itself, so that
a phrase is counted at the first of its pivots alone.  These fragments are counted within
a block of texts, go to the partition of their pivot, and are mined there for the phrases
that hold the pivot.  No other partition has any of these, so their counts are whole.  A
pivot with more than ``HOT`` occurrences is mined in several parts, whose counts are added.

A block of texts gets the numbers of its own words by a join on the word, so no task
holds the vocabulary.  A cut of a phrase is scored by the counts of its two sides, which
are frequent phrases or words themselves, by a join as well.  A phrase can be covered by a
longer one only if one that is a single word longer covers it, because each phrase between
them is at least as frequent as the longer one.

Nulls and edge cases: a null or empty text has no words; a null lang is ``und``; repeated
rows count each; ties in score and count are ranked by the phrase's bytes; a text longer
than a block is dealt with in parts that see three words of each other; empty tables give
no rows; doc_id and other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from itertools import chain, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import small_batches, starts, task_base, written
from quarry.operators.order import numbered

LONGEST = 4
LEAST = 30
#: A longer phrase covers one within it from this percentage of its occurrences.
COVERS = 80
SCALE = 2_000_000
TOP = 2_000
#: Bytes of text that are rewritten together; occurrences of a pivot that are mined together, about.
BLOCK = 4_000_000
HOT = 2_000_000
#: Fragments of a row, and those that a task mines at once, about.
ROW, MINED = 1_024, 500_000
#: Separators become a byte that UTF-8 never has; A-Z are lower-cased.
_BREAK = b"\xff"
_BYTES = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_EDGE = re.compile(rb"[ \t\xff]")
CODED = "block long, lang string, lead int, tail int, codes binary, words array<string>, counts array<long>"
FRAGMENTS = "lang string, pivot int, salt int, split boolean, shapes binary, times binary, words binary"


def tokens(data: bytes, most: int = BLOCK):
    """Words and breaks of a text, in lists of about ``most`` bytes of it that end between words."""
    data = data.translate(_BYTES)
    at = 0
    while at < len(data):
        edge = _EDGE.search(data, at + most) if at + most < len(data) else None
        end = edge.start() if edge else len(data)
        yield data[at:end].replace(_BREAK, b" \xff ").split()
        at = end


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def coded(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of texts of one language as codes of their own words, 0 for a break, with the words and how often they occur.  ``lead`` and ``tail`` codes are of the parts before and after."""
    reach = LONGEST - 1

    def rows(lang, texts, number):
        ahead, before = deque(), []

        def row():
            nonlocal before
            part = ahead.popleft()
            after = [w for p in ahead for w in p[:reach]][:reach]
            known = _Numbers({_BREAK: 0})
            codes = np.fromiter(map(known.__getitem__, chain(before, part, after)), np.int32, len(before) + len(part) + len(after))
            own = codes[len(before) : len(codes) - len(after)]
            out = {"block": next(number), "lang": lang, "lead": len(before), "tail": len(after), "codes": codes.tobytes(), "words": [*map(bytes.decode, list(known)[1:])], "counts": np.bincount(own, minlength=len(known))[1:]}
            before = [*before, *part][-reach:]
            return out

        for part in tokens(_BREAK.join(texts), block):
            ahead.append(part)
            # A part waits until the words after it are known.
            while sum(map(len, ahead)) - len(ahead[0]) >= reach:
                yield row()
        while ahead:
            yield row()

    kinds = pa.schema({"block": pa.int64(), "lang": pa.string(), "lead": pa.int32(), "tail": pa.int32(), "codes": pa.binary(), "words": pa.list_(pa.string()), "counts": pa.list_(pa.int64())})

    def run(batches):
        number, held, size = count(task_base()), {}, {}
        for batch in small_batches(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, []).append(text.encode())
                    size[lang] = size.get(lang, 0) + len(held[lang][-1])
            full = [x for x in held if size[x] >= block]
            for lang in list(held) if sum(size.values()) >= 4 * block else full:
                size.pop(lang)
                for row in rows(lang, held.pop(lang), number):
                    yield pa.RecordBatch.from_pylist([row], kinds)
        for lang, texts in held.items():
            for row in rows(lang, texts, number):
                yield pa.RecordBatch.from_pylist([row], kinds)

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(run, CODED)


def reaches(ids: np.ndarray, reach: int = LONGEST - 1) -> tuple[np.ndarray, np.ndarray]:
    """Of each place with a number from 0: words that stay on its left (more frequent) and on its right (no rarer)."""
    n = len(ids)
    left, right = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for out, ok in ((left, np.less), (right, np.less_equal)):
        still = ids >= 0
        for d in range(1, reach + 1):
            here = np.zeros(n, bool)
            if out is left:
                here[d:] = (ids[:-d] >= 0) & ok(ids[:-d], ids[d:])
            else:
                here[:-d] = (ids[d:] >= 0) & ok(ids[d:], ids[:-d])
            still = still & here
            out += still
    return left, right


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of an array as binary values, from their borders in items."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def rewritten(lang: str, block: int, codes: np.ndarray, lead: int, tail: int, words: tuple[np.ndarray, np.ndarray, np.ndarray], hot: int = HOT) -> pa.Table:
    """Fragments of a block, each with its number, by pivot.  ``words`` are the codes of frequent words, their numbers and their counts in the corpus."""
    code, number, count = words
    order = np.argsort(number)
    place = np.full(int(codes.max(initial=0)) + 1, -1, np.int64)
    # The frequent words of a block are numbered within it in the same order, so that three of them fit into 64 bits.
    place[code[order]] = np.arange(len(order))
    number, count = number[order], count[order]
    if len(number) >= (1 << 21) - 1:
        raise OverflowError("a block has too many different words")
    ids = place[codes]
    left, right = reaches(ids)
    owned = np.flatnonzero((left + right > 0) & (np.arange(len(ids)) >= lead) & (np.arange(len(ids)) < len(ids) - tail))
    if not len(owned):
        return EMPTY.empty_table()
    left, right, pivot = left[owned].astype(np.int64), right[owned].astype(np.int64), ids[owned]
    padded = np.concatenate([ids, np.full(LONGEST, -1)])
    near = np.stack([np.where(left >= d, padded[owned - d], -1) for d in (3, 2, 1)] + [np.where(right >= d, padded[owned + d], -1) for d in (1, 2, 3)]).reshape(6, -1)
    packed = [(near[k] + 1) << 42 | (near[k + 1] + 1) << 21 | (near[k + 2] + 1) for k in (0, 3)]
    keys = (packed[1], packed[0], pivot << 4 | left << 2 | right)
    order = np.lexsort(keys)
    first = np.ones(len(order), bool)
    first[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    at = np.flatnonzero(first)
    times = np.diff(np.append(at, len(order)))
    at = order[at]
    pivot, shape, near = pivot[at], (left << 2 | right)[at].astype(np.uint8), near[:, at].T
    size = (left + right)[at]
    near = number[near[near >= 0]]
    # Rows of one pivot, of at most ROW fragments.
    edge = np.flatnonzero(np.concatenate([[True], pivot[1:] != pivot[:-1]]))
    edge = np.concatenate([np.arange(a, b, ROW) for a, b in zip(edge, np.append(edge[1:], len(pivot)), strict=True)])
    ends = np.append(edge, len(pivot)).astype(np.int64)
    word_ends = starts(size)[ends]
    own, parts = number[pivot[edge]], count[pivot[edge]] // hot + 1
    salt = xxhash.xxh3_64_intdigest(str(block).encode()) % parts.astype(np.uint64)
    tables = []
    # Words no rarer than the pivot have smaller numbers, so the pivot says how wide they are.
    for low, high, kind in WIDTHS:
        a, b = np.searchsorted(own, [low, high])
        if a < b:
            some, some_words = ends[a : b + 1], word_ends[a : b + 1]
            flat = near[some_words[0] : some_words[-1]].astype(kind)
            tables.append(pa.table({"lang": pa.array([lang] * (b - a), pa.string()), "pivot": pa.array(own[a:b], pa.int32()), "salt": pa.array(salt[a:b].astype(np.int32)), "split": pa.array(parts[a:b] > 1), "shapes": _binary(shape[some[0] : some[-1]], some - some[0]), "times": _binary(times[some[0] : some[-1]].astype(np.uint32), some - some[0]), "words": _binary(flat, some_words - some_words[0])}))
    return pa.concat_tables(tables)


WIDTHS = ((0, 1 << 8, np.uint8), (1 << 8, 1 << 16, np.uint16), (1 << 16, 1 << 31, np.uint32))
EMPTY = pa.schema({"lang": pa.string(), "pivot": pa.int32(), "salt": pa.int32(), "split": pa.bool_(), "shapes": pa.binary(), "times": pa.binary(), "words": pa.binary()})


def fragments(blocks: DataFrame, vocabulary: DataFrame, hot: int = HOT) -> DataFrame:
    """Fragments of all blocks; the vocabulary is (lang, word, id, n) of frequent words."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return EMPTY.empty_table()
        words = tuple(right[c].to_numpy().astype(np.int64) for c in ("code", "id", "n"))
        r = left.to_pylist()[0]
        return rewritten(r["lang"], r["block"], np.frombuffer(r["codes"], np.int32), r["lead"], r["tail"], words, hot)

    each = blocks.select("block", "lang", F.posexplode("words").alias("code", "word")).join(vocabulary, ["lang", "word"]).select(F.col("block").alias("of"), (F.col("code") + 1).alias("code"), "id", "n")
    return blocks.select("block", "lang", "lead", "tail", "codes").groupBy("block").cogroup(each.groupBy("of")).applyInArrow(run, FRAGMENTS)


def _flat(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """Items of binary values side by side, and how many each value has."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    width = np.dtype(kind).itemsize
    return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind) if data is not None else np.empty(0, kind)), np.diff(ends) // width


def local_phrases(pivot: np.ndarray, shape: np.ndarray, times: np.ndarray, split: np.ndarray, words: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(words with -1 after the last, count) of phrases that hold the pivots of these fragments: those of enough occurrences, and all of pivots that are split."""
    left, right = (shape >> 2).astype(np.int64), (shape & 3).astype(np.int64)
    begin = starts(left + right)[:-1]
    high, low, n, whole = [], [], [], []
    for s in range(LONGEST):
        for e in range(LONGEST - s):
            if s + e == 0:
                continue
            some = np.flatnonzero((left >= s) & (right >= e))
            at = begin[some] + left[some]
            ids = [*[words[at - d] for d in range(s, 0, -1)], pivot[some], *[words[at + d] for d in range(e)]]
            ids = [x.astype(np.uint64) + np.uint64(1) for x in ids] + [np.zeros(len(some), np.uint64)] * (LONGEST - len(ids))
            high.append(ids[0] << np.uint64(32) | ids[1])
            low.append(ids[2] << np.uint64(32) | ids[3])
            n.append(times[some])
            whole.append(~split[some])
    high, low, n, whole = map(np.concatenate, (high, low, n, whole))
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    at = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])) if len(high) else np.empty(0, np.int64)
    sums = np.add.reduceat(n[order], at) if len(at) else np.empty(0, np.int64)
    kept = (sums >= least) | ~whole[order][at]
    at, sums, mask = at[kept], sums[kept], np.uint64(0xFFFFFFFF)
    return np.stack([high[at] >> np.uint64(32), high[at] & mask, low[at] >> np.uint64(32), low[at] & mask], 1).astype(np.int64) - 1, sums


def mined(rows: DataFrame, least: int = LEAST, most: int = MINED) -> DataFrame:
    """(lang, ids, a) of phrases from two words, from the fragments of their pivots; of split pivots in parts."""

    def found(lang, held):
        pivot, shape, times, split, words = map(np.concatenate, zip(*held, strict=True))
        ids, a = local_phrases(pivot, shape, times, split, words, least)
        real = ids >= 0
        for k in range(0, len(a), 100_000):
            some = real[k : k + 100_000]
            lists = pa.ListArray.from_arrays(pa.array(starts(some.sum(1)), pa.int32()), pa.array(ids[k : k + 100_000][some], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), lists, pa.array(a[k : k + 100_000], pa.int64())], names=["lang", "ids", "a"])

    def run(batches):
        lang, last, held, size = None, None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            pivots = batch.column("pivot").to_numpy().astype(np.int64)
            dictionary = batch.column("lang").dictionary_encode()
            code = dictionary.indices.to_numpy()
            width = np.searchsorted([x[0] for x in WIDTHS], pivots, "right") - 1
            # Runs of one language and one width; within them a task's share may end wherever the pivot or the salt does.
            salts = batch.column("salt").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (width[1:] != width[:-1]), [True]]))
            for a, b in zip(edge, edge[1:], strict=False):
                name = dictionary.dictionary[int(code[a])].as_py()
                if held and name != lang:
                    yield from found(lang, held)
                    held, size = [], 0
                lang = name
                ends = np.append(np.flatnonzero((pivots[a + 1 : b] != pivots[a : b - 1]) | (salts[a + 1 : b] != salts[a : b - 1])) + 1 + a, b)
                begin = a
                for end in ends.tolist():
                    # Rows are gathered up to a border of groups; the last group may go on in the next batch.
                    if end < b and end - begin < 200:
                        continue
                    some = batch.slice(begin, end - begin)
                    if held and size >= most and last != (pivots[begin], salts[begin]):
                        yield from found(lang, held)
                        held, size = [], 0
                    shape, n = _flat(some.column("shapes"), np.uint8)
                    times, _ = _flat(some.column("times"), np.uint32)
                    words, _ = _flat(some.column("words"), WIDTHS[width[begin]][2])
                    held.append((np.repeat(pivots[begin:end], n), shape, times.astype(np.int64), np.repeat(some.column("split").to_numpy(zero_copy_only=False), n), words.astype(np.int64)))
                    size += len(shape)
                    last = pivots[end - 1], salts[end - 1]
                    begin = end
        if held:
            yield from found(lang, held)

    return rows.repartition("lang", "pivot", "salt").sortWithinPartitions("lang", "pivot", "salt").mapInArrow(run, "lang string, ids array<int>, a long")


def collocations(docs: DataFrame, least: int = LEAST, covers: int = COVERS, top: int = TOP, block: int = BLOCK, hot: int = HOT, most: int = MINED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language, scored by the cut that holds them together least."""
    blocks = written(coded(docs, block), "phrase-blocks", "zstd")
    n = blocks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    frequent = each.where(F.col("n") >= least).withColumn("down", -F.col("n"))
    vocabulary = written(numbered(frequent, ["down", "word"], ["lang"], "id").select("lang", "word", F.col("id").cast("int").alias("id"), "n"), "phrase-words")
    parts = mined(fragments(blocks, vocabulary, hot), least, most)
    found = written(parts.groupBy("lang", "ids").agg(F.sum("a").alias("a")).where(F.col("a") >= least), "phrases")

    sides = F.flatten(F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda k: F.array(F.struct(k.alias("k"), F.lit(0).alias("side"), F.slice("ids", 1, k).alias("part")), F.struct(k.alias("k"), F.lit(1).alias("side"), F.slice("ids", k + 1, F.size("ids") - k).alias("part")))))
    counts = found.select("lang", F.col("ids").alias("part"), F.col("a").alias("f")).unionByName(vocabulary.select("lang", F.array("id").alias("part"), F.col("n").alias("f")))
    looked_up = found.select("lang", "ids", "a", F.explode(sides).alias("s")).select("lang", "ids", "a", "s.*").join(counts, ["lang", "part"])
    columns = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("f"))).alias(f"{name}{k}") for k in range(1, LONGEST) for s, name in enumerate("lr")]
    # Decimals, since the product may pass 64 bits; ``div`` drops the rest.
    score = lambda k: F.expr(f"cast({SCALE} as decimal(10,0)) * cast(a as decimal(20,0)) div cast(l{k} + r{k} as decimal(20,0))")
    cut = [F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)]
    scored = looked_up.groupBy("lang", "ids", "a").agg(*columns).select("lang", "ids", "a", F.array_min(F.array_compact(F.array(*cut))).alias("cut"))
    longer = found.where(F.size("ids") > 2).select("lang", "a", F.explode(F.array(F.slice("ids", F.lit(1), F.size("ids") - 1), F.slice("ids", F.lit(2), F.size("ids") - 1))).alias("ids")).groupBy("lang", "ids").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "ids"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covers * F.col("a"))).select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")

    # All that could be among the first by score and count get their words; the phrase decides ties.
    best = kept.withColumn("at", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("at") <= top).drop("at")
    spelled = best.select("*", F.posexplode("ids").alias("place", "id")).join(vocabulary.select("lang", "id", "word"), ["lang", "id"])
    phrases = spelled.groupBy("lang", "ids", "a", "l", "r", "score").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])).alias("phrase"))
    ranked = phrases.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
