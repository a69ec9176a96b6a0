"""Operator 8: language-model scoring by online logistic context mixing, beside a unigram base score.

The corpus gives two things, both from all training documents and nothing else:
counts of words (for the base score), and counts of symbols after contexts of three and
of five bytes (for the model; the code itself holds those after one byte); both grow with the corpus.  A text's lower-cased bytes are
symbols, and so is its end, a byte that UTF-8 never has; each is coded as the binary
decisions of a Huffman code of what follows the byte before, made from the corpus, so
a likely byte is a few decisions.

* Predictors.  Every order's context predicts each decision from the corpus' counts of
  that context alone (contexts are dealt to tasks by hash and told apart exactly).  One
  more moves while the text is read: what followed the last time that the text had the
  same ``MATCH`` bytes, trusted the more the longer it has been right.
* Mixing.  Predictions, as logits gated by how much their context has been seen, are
  weighted and added up; each text refines the weights as it is read, a block of
  decisions at a time, from the blocks before.
* Refinement.  Each text counts how often the likelier bit came, by the mixed logit's
  size and by how long matches have been right; half of the final probability is from
  these counts, which begin with what the mixer says.

The sum of the decisions' log probabilities is the text's.  A text of more than
``SEGMENT`` bytes is read in segments of that length from its begin, which hand on
context, weights and counts; matches are sought within a segment.

Documents are dealt to blocks of about ``DOC_BLOCK`` bytes.  A block sends each of its
distinct words, and pairs of context and symbol, once to the bucket of its hash, and
gets back the corpus' counts of its words and the logits along the codes of its pairs.
So a word that a third of all rows have costs one entry a block, and no task holds the
model.

Nulls and edge cases: a null text is empty; an empty text is its end alone; a null
doc_id isn't held out but no training row either; repeated rows give and count a row each; without
training rows all counts are 0 and the first decisions have one half; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import hashed_words, mixed, small_batches, starts, written

#: Orders of the model: so many bytes before.
ORDERS = (3, 5)
#: The byte that ends a text.
END = 255
BLOCK = 128
RATE = 0.015
#: Start of the gates: weight of an order's logit, and how many sightings of a context make it half trusted; last, the match's weight.
WEIGHTS, TRUST, MATCH_WEIGHT = (0.5, 0.6), 0.4, 0.4
#: Bytes of context that make a match, and its logit by how many guesses in a row were right.
MATCH, STRENGTH = 6, (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0)
#: Cells of the refinement: sizes of the mixed logit by kinds of match; how many sightings what the mixer says is worth.
SIZES, STEP, KINDS, WORTH = 12, 0.5, 3, 24.0
#: Bytes of text of a block of documents, and of a segment.
DOC_BLOCK, SEGMENT = 8_000_000, 1 << 19
#: Bits of a place in a piece, which holds a segment and one more text of a segment at most.
PLACE_BITS = 21
#: The end of a text among the hashes of words.
END_WORD = xxhash.xxh3_64_intdigest(b" end ")
#: Bytes of text for each bucket of words, and of pairs.
WORD_BUCKET, PAIR_BUCKET = 20_000_000, 4_000_000
SCALE = 16.0


def text_bytes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts side by side; where texts begin; their offsets."""
    at = starts([len(x) for x in data])
    first = np.zeros(at[-1], bool)
    first[at[:-1]] = True
    return np.frombuffer(b"".join(data), np.uint8), first, at


def last_bytes(data: bytes) -> np.ndarray:
    """Of each byte: the eight bytes that end with it as a number, itself lowest; ahead of all are zeros."""
    return np.ndarray(len(data), ">u8", bytes(7) + data, strides=(1,)).astype(np.uint64)


def pair_keys(parts: list[bytes], before: list[bytes]) -> np.ndarray:
    """Key of each byte of the parts by order, [order, byte]: the order's number, the bytes before and the byte itself.  ``before`` is what a part's text has right before it; ahead of a text all bytes are END."""
    longest = max(ORDERS)
    data, _, at = text_bytes([bytes([END]) * (longest - len(x)) + x + y for x, y in zip(before, parts, strict=True)])
    own = np.ones(len(data), bool)
    own[(at[:-1, None] + np.arange(longest)).ravel()] = False
    latest = last_bytes(data.tobytes())[own]
    return np.stack([latest & np.uint64((1 << 8 * (k + 1)) - 1) | np.uint64(which << 56) for which, k in enumerate(ORDERS)])


def pieces(texts: list[str | None]):
    """(numbers of the texts, parts, bytes before the parts) of about SEGMENT bytes each; segments of a longer text come alone and in order."""
    owner, parts, held = [], [], 0
    # Texts of like length are read side by side.
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k] or "")):
        whole = symbols(texts[k])
        if owner and held + len(whole) > SEGMENT:
            yield owner, parts, [b""] * len(parts)
            owner, parts, held = [], [], 0
        if len(whole) <= SEGMENT:
            owner.append(k)
            parts.append(whole)
            held += len(whole)
        else:
            for at in range(0, len(whole), SEGMENT):
                yield [k], [whole[at : at + SEGMENT]], [whole[max(0, at - max(ORDERS)) : at]]
    if owner:
        yield owner, parts, [b""] * len(parts)


def encoded_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in any order, and each key's number among them."""
    got = pa.array(keys.ravel()).dictionary_encode()
    return got.dictionary.to_numpy(), got.indices.to_numpy().reshape(keys.shape)


def symbols(text: str | None) -> bytes:
    """A lower-cased text's bytes and its end."""
    return (text or "").encode("utf-8", "surrogatepass").lower() + bytes([END])


def huffman(counts: np.ndarray) -> list[list]:
    """Paths of the 256 symbols of a code, as lists of (node, bit) from the root; inner nodes are 0 to 254, the root last."""
    heap = [(int(c), k) for k, c in enumerate(counts)]
    heapq.heapify(heap)
    child = []
    for node in range(255):
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        child.append((x, y))
        heapq.heappush(heap, (a + b, 256 + node))
    paths: list[list] = [[] for _ in range(256)]
    stack = [(254, [])]
    while stack:
        node, path = stack.pop()
        for bit, x in enumerate(child[node]):
            if x < 256:
                paths[x] = [*path, (node, bit)]
            else:
                stack.append((x - 256, [*path, (node, bit)]))
    return paths


def codes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A code of the symbols after each byte, from counts [byte before, symbol]: (length, nodes[, depth], signs of the bits[, depth]) of byte before * 256 + symbol."""
    plain = counts.sum(0) + 1
    every = huffman(plain)
    # Rare symbols have a floor, so codes stay below some 30 decisions.
    paths = [path for row in counts for path in (huffman(np.maximum(row, 1 + row.sum() // (1 << 18)) * 256 + plain * 256 // plain.sum()) if row.any() else every)]
    length = np.array([len(x) for x in paths])
    # One column more than the longest code has; beyond a code's end there is no node, and a sign of 0.
    nodes, signs = np.full((1 << 16, length.max() + 1), -1, np.int16), np.zeros((1 << 16, length.max() + 1), np.int8)
    for k, path in enumerate(paths):
        nodes[k, : len(path)], signs[k, : len(path)] = zip(*path, strict=True)
    return length, nodes, np.where(nodes < 0, 0, 2 * signs - 1).astype(np.int8)


def guesses(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each byte: what followed when its part last had the same ``MATCH`` bytes before (-1: never), and how many guesses in a row were right just before."""
    data, first, at = text_bytes(parts)
    n, owner, places = len(data), np.repeat(np.arange(len(parts)), np.diff(at)), np.arange(len(data), dtype=np.int32)
    enough = np.ones(n + MATCH, bool)
    enough[(at[:-1, None] + np.arange(MATCH)).ravel()] = False
    full = np.flatnonzero(enough[:n])
    key = last_bytes(bytes(1) + data.tobytes())[full] & np.uint64((1 << 8 * MATCH) - 1)
    # A context's hash above the place, so that places with one context lie together in order.
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = np.sort(mixed(key * np.uint64(0x9E3779B97F4A7C15) + owner[full].astype(np.uint64)) & ~low | full.astype(np.uint64))
    place, same = (key & low).astype(np.int64), key[1:] >> np.uint64(PLACE_BITS) == key[:-1] >> np.uint64(PLACE_BITS)
    before, after = place[:-1][same], place[1:][same]
    mine = owner[before] == owner[after]
    guess = np.full(n, -1, np.int16)
    guess[after[mine]] = data[before[mine]]
    right = guess == data
    # Guesses in a row that were right: places since the last that wasn't, or since the text's begin.
    wrong = np.maximum.accumulate(np.where(right, np.int32(-1), places))
    run = np.zeros(n, np.int64)
    run[1:] = places[:-1] - np.maximum(wrong[:-1], np.repeat(at[:-1] - 1, np.diff(at))[1:])
    run[first] = 0
    return guess, np.minimum(run, len(STRENGTH) - 1).astype(np.int8)


def encoded_pieces(texts: list[str | None]) -> tuple[list[tuple], np.ndarray]:
    """Pieces with their bytes' numbers among the piece's distinct pairs; the sorted distinct pairs of all."""
    made = [(owner, parts, before, *encoded_keys(pair_keys(parts, before))) for owner, parts, before in pieces(texts)]
    return made, np.unique(np.concatenate([x[3] for x in made]))


def pair_score(code, made: list[tuple], n_texts: int, pairs: np.ndarray, logits: np.ndarray) -> np.ndarray:
    """log2 probability of each text by the logits along the codes of its ``pairs``, side by side in ``logits``."""
    at = starts(code[0][(pairs & np.uint64(0xFFFF)).astype(np.int64)])
    out, last, state = np.zeros(n_texts, np.float64), None, None
    for owner, parts, before, distinct, number in made:
        # Sorted keys are found faster than scattered ones.
        order, begin = np.argsort(distinct), np.empty(len(distinct), np.int32)
        begin[order] = at[np.searchsorted(pairs, distinct[order])]

        def inputs_of(steps, depth, begin=begin, number=number):
            x = np.empty((len(number) + 1, len(depth)), np.int8)
            for k, row in enumerate(number):
                logits.take(np.repeat(begin.take(row), steps) + depth, out=x[k], mode="clip")
            return x

        carried = state if len(owner) == 1 and owner[0] == last else None
        bits, state = mixed_bits(code, parts, before, inputs_of, carried)
        np.add.at(out, owner, bits)
        last = owner[-1]
    return out


def mixed_bits(code, parts: list[bytes], before: list[bytes], inputs_of, state=None) -> tuple[np.ndarray, tuple]:
    """log2 probability of each part, and its weights and counts after it.  ``inputs_of(steps, depth)`` gives the logits [order, decision] of bytes of so many decisions, with a row to spare for the match."""
    data, first, at = text_bytes(parts)
    length, nodes, signs = code
    width = nodes.shape[1]
    signs, nodes = signs.ravel(), nodes.ravel()
    last = np.empty(len(data), np.int32)
    last[1:] = data[:-1]
    last[at[:-1]] = [x[-1] if x else END for x in before]
    last <<= 8
    steps = length[last + data]
    per_text = np.add.reduceat(steps, at[:-1])
    blocks = -(-per_text // BLOCK)
    begin = np.cumsum(blocks) - blocks
    # Each text's decisions fill whole blocks: its last symbol has as many empty ones as are needed.
    empty = blocks * BLOCK - per_text
    steps[at[1:] - 1] += empty
    # Of each decision: what its byte has.
    of = lambda x: np.repeat(x, steps)
    depth = np.arange(steps.sum(), dtype=np.int32) - of((np.cumsum(steps) - steps).astype(np.int32))
    np.minimum(depth, width - 1, out=depth)
    path = depth + of((last + data) * width)
    node, sign = nodes.take(path), signs.take(path).reshape(-1, BLOCK)
    x = inputs_of(steps, depth)
    # The match speaks as long as the guess's code has gone the same way.
    guess, run = guesses(parts)
    path = depth + of(np.where(guess < 0, -width, (last + guess) * width).astype(np.int32))
    agrees = (nodes.take(path, mode="clip") == node) & (path >= 0) & (node >= 0)
    strong = np.rint(SCALE * np.array(STRENGTH)).astype(np.int8)
    x[-1] = of(strong[run]) * signs.take(path, mode="clip") * agrees
    kind = of((np.where(guess < 0, 0, np.where(run < 3, 1, 2)) * SIZES).astype(np.int16)).reshape(-1, BLOCK)
    orders = len(x)
    x = x.reshape(orders, -1, BLOCK)
    # Texts side by side, longest first, a block of each at a time.
    order = np.argsort(-blocks, kind="stable")
    live = np.searchsorted(-blocks[order], -np.arange(blocks.max()), side="left")
    if state is None:
        weights = np.full((len(parts), orders), 1 / SCALE, np.float32)
        weights[:, -1] *= MATCH_WEIGHT
        says = 1 / (1 + np.exp(-STEP * (np.arange(KINDS * SIZES) % SIZES + 0.5)))
        state = weights, np.tile((WORTH * says).astype(np.float32), (len(parts), 1)), np.full((len(parts), KINDS * SIZES), WORTH, np.float32)
    weights, came, seen = (v.copy() for v in state)
    rate, out, cells = np.float32(RATE / SCALE / SCALE), empty.astype(np.float64), KINDS * SIZES
    for t in range(int(blocks.max())):
        who = order[: live[t]]
        rows = begin[who] + t
        inputs, s, w = x.take(rows, axis=1).astype(np.float32), sign.take(rows, axis=0).astype(np.float32), weights[who]
        m = inputs[0] * w[:, :1]
        for k in range(1, orders):
            m += inputs[k] * w[:, k : k + 1]
        m *= s
        far = np.abs(m)
        q = 1 / (1 + np.exp(-far))
        likely = m > 0
        # 1 or -1, by which both cases are worked out in one: picking by a mask is slower.
        side = likely.astype(np.float32)
        side *= 2
        side -= 1
        # The refinement, of the likelier bit.
        cell = np.minimum(far * np.float32(1 / STEP), SIZES - 1).astype(np.int16)
        cell += kind.take(rows, axis=0)
        cell = cell.astype(np.intp)
        cell += np.arange(len(who))[:, None] * cells
        refined = (came[who] / seen[who]).ravel().take(cell, mode="clip")
        refined += q
        refined -= 1
        p = refined * side
        p += 1
        # Twice the probability; an empty decision counts as one bit, which was put in before.
        p[s == 0] = 1
        out[who] += np.log(p).sum(1) / math.log(2) - BLOCK
        cell *= 2
        cell += likely
        both = np.bincount(cell.ravel(), minlength=2 * cells * len(who)).reshape(len(who), cells, 2)
        came[who] += both[:, :, 1]
        seen[who] += both[:, :, 0] + both[:, :, 1]
        q -= np.float32(0.5)
        q *= side
        s *= np.float32(0.5) - q
        weights[who] = w + rate * np.einsum("kmb,mb->mk", inputs, s)
    return out, (weights, came, seen)


def training():
    """Rows that the corpus counts are from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 != 2, F.lit(False))


def block_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts side by side, an end after each; words of each text, the end included."""
    words, n = hashed_words(texts)
    out = np.full(len(words) + len(n), END_WORD, np.uint64)
    out[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
    return out, n + 1


def by_bucket(distinct: np.ndarray, buckets: int, rest: int = 0) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Order of sorted hashes by bucket; the buckets that have any, and where each begins.  With ``rest``, keys that differ in so many last bits only share a bucket."""
    hashes = mixed(distinct >> np.uint64(rest)) if rest else distinct
    bucket = (hashes >> np.uint64(17)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    at = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    return order, bucket[at[:-1]], at


def path_logits(keys: np.ndarray, counts: np.ndarray, code) -> np.ndarray:
    """Of sorted distinct pairs and their counts: gated logits of bit 1 at the nodes along each pair's code, side by side, as int8 of 1/SCALE.  A context's pairs must all be there."""
    length, nodes, signs = code
    symbol = (keys & np.uint64(0xFFFF)).astype(np.int64)
    steps = length[symbol]
    of = np.repeat(np.arange(len(keys)), steps)
    depth = np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)
    context = np.cumsum(np.append(0, (keys[1:] >> np.uint64(8)) != (keys[:-1] >> np.uint64(8))))
    _, place = np.unique((context[of] << 8) + nodes[symbol[of], depth], return_inverse=True)
    n = counts.astype(np.float64)[of]
    total = np.bincount(place, n)[place]
    ones = np.bincount(place, n * (signs[symbol[of], depth] > 0))[place]
    p = (ones + 0.4) / (total + 0.8)
    gate = np.array(WEIGHTS)[(keys >> np.uint64(56)).astype(np.int64)][of] * total / (total + TRUST)
    return np.clip(np.rint(SCALE * gate * 2 * np.log(p / (1 - p))), -127, 127).astype(np.int8)


def narrow(x: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"u{x[0]}", offset=1).astype(np.int64)


def symbol_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Numbers of the symbols after each byte in training rows, and the bytes of all rows."""

    def run(batches):
        counts, size = np.zeros(1 << 16, np.int64), 0
        for batch in small_batches(batches):
            size += batch.num_rows + (pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0)
            texts = batch.filter(batch.column("trains")).column("text").cast(pa.binary()).fill_null(b"")
            if len(texts):
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), bytes([END]))[0].as_py()
                data = LOWER.take(np.frombuffer(bytes([END]) + joined + bytes([END]), np.uint8))
                counts += np.bincount(data[:-1] << 8 | data[1:], minlength=1 << 16)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"pair": pa.array(np.append(some, -1)), "n": pa.array(np.append(counts[some], size))})

    got = docs.select("text", training().alias("trains")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts, size = np.zeros(1 << 16, np.int64), 0
    for r in got:
        if r.pair < 0:
            size = r.n
        else:
            counts[r.pair] = r.n
    return counts.reshape(256, 256), size


#: Bytes with A-Z lower-cased.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.int32)
GATHERED = "bucket long, block long, keys binary, counts binary"


def gathered(blocks: DataFrame, word_buckets: int, pair_buckets: int) -> DataFrame:
    """A block's distinct words of a bucket with their numbers in training rows, and the same of its pairs of context and symbol, whose buckets come after those of words."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        texts, trains = rows["text"].to_pylist(), np.array(rows["trains"].to_pylist(), bool)
        out: list[tuple] = []

        def packed(distinct, count, base, cut_at):
            order, bucket, at = cut_at
            out.extend((base + b, distinct[order[i:j]].tobytes(), narrow(count[order[i:j]])) for b, i, j in zip(bucket.tolist(), at, at[1:], strict=False))

        h, n = block_words(texts)
        distinct, where = np.unique(h, return_inverse=True)
        packed(distinct, np.bincount(where[np.repeat(trains, n)], minlength=len(distinct)), 0, by_bucket(distinct, word_buckets))
        del h, where
        keys, counts = [], []
        for owner, parts, before in pieces(texts):
            # The last bit tells whether the row trains.
            marked = pair_keys(parts, before) << np.uint64(1) | np.repeat(trains[owner], [len(x) for x in parts])
            got, number = np.unique(marked, return_counts=True)
            keys.append(got >> np.uint64(1))
            counts.append(np.where(got & np.uint64(1), number, 0))
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        packed(distinct, np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.int64), word_buckets, by_bucket(distinct, pair_buckets, 8))
        bucket, keys, counts = zip(*out, strict=True)
        return pa.table({"bucket": pa.array(bucket, pa.int64()), "block": pa.array([key[0].as_py()] * len(bucket), pa.int64()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return blocks.groupBy("block").applyInArrow(run, GATHERED)


def answered(rows: DataFrame, word_buckets: int, sent) -> DataFrame:
    """Back to every block, in its own order of a bucket: the corpus counts of its words, or the logits along the codes of its pairs; and to block -1 the tokens and distinct training words of a bucket."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        bucket, code = key[0].as_py(), sent.value
        keys = [np.frombuffer(x.as_py(), np.uint64) for x in rows["keys"]]
        counts = np.concatenate([wide(x.as_py()) for x in rows["counts"]])
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, counts, len(distinct)).astype(np.int64)
        at, blocks = starts([len(x) for x in keys]), rows["block"].to_pylist()
        if bucket < word_buckets:
            out = [narrow(total[where[a:b]]) for a, b in zip(at, at[1:], strict=False)]
            blocks, out = [*blocks, -1], [*out, narrow(np.array([total.sum(), (total > 0).sum()]))]
        else:
            logits, steps, out = path_logits(distinct, total, code), code[0][(distinct & np.uint64(0xFFFF)).astype(np.int64)], []
            begin = starts(steps)
            for a, b in zip(at, at[1:], strict=False):
                n = steps[where[a:b]]
                out.append(logits[np.repeat(begin[where[a:b]] - starts(n)[:-1], n) + np.arange(n.sum())].tobytes())
        return pa.table({"block": pa.array(blocks, pa.int64()), "bucket": pa.array([bucket] * len(out), pa.int64()), "answer": pa.array(out, pa.binary())})

    return rows.groupBy("bucket").applyInArrow(run, "block long, bucket long, answer binary")


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of each row."""
    plain, size = symbol_counts(docs)
    sent = docs.sparkSession.sparkContext.broadcast(codes(plain))
    n_blocks, word_buckets, pair_buckets = (max(1, -(-size // x)) for x in (DOC_BLOCK, WORD_BUCKET, PAIR_BUCKET))
    # Rows are dealt by number too, so that repeated ones don't meet in one block.
    at = F.monotonically_increasing_id()
    blocks = docs.select("doc_id", training().alias("trains"), "text", at.alias("at")).withColumn("block", F.pmod(F.xxhash64("doc_id", "text", "at"), F.lit(n_blocks)))
    answers = answered(gathered(blocks, word_buckets, pair_buckets), word_buckets, sent)

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            tokens, kinds = np.sum([wide(x.as_py()) for x in right["answer"]], axis=0).tolist()
            return pa.table({"doc_id": pa.array([None], pa.int64()), "n_tokens": [tokens], "n_known": [kinds], "base": [0.0], "score": [0.0], "size": pa.array([-1], pa.int64())})
        left, right = left.sort_by("at"), right.sort_by("bucket")
        texts = left["text"].to_pylist()
        words, paths = right.filter(pc.less(right["bucket"], word_buckets)), right.filter(pc.greater_equal(right["bucket"], word_buckets))
        h, n = block_words(texts)
        distinct, where = np.unique(h, return_inverse=True)
        c = np.empty(len(distinct), np.int64)
        c[by_bucket(distinct, word_buckets)[0]] = np.concatenate([wide(x.as_py()) for x in words["answer"]])
        c, at = c[where], starts(n)[:-1]
        base, known = np.add.reduceat(np.log10(c + 1.0), at), np.add.reduceat((c > 0).astype(np.int64), at)
        del h, where, c, distinct
        code = sent.value
        made, pairs = encoded_pieces(texts)
        order = by_bucket(pairs, pair_buckets, 8)[0]
        # Paths come by bucket, and are put in the order of the pairs.
        steps = code[0][(pairs & np.uint64(0xFFFF)).astype(np.int64)]
        came = np.empty(len(pairs), np.int64)
        came[order] = starts(steps[order])[:-1]
        paths = np.frombuffer(b"".join(x.as_py() for x in paths["answer"]), np.int8)
        if len(paths) != steps.sum():
            raise ValueError("a block's rows aren't those that were gathered")
        paths = paths[np.repeat(came - starts(steps)[:-1], steps) + np.arange(len(paths))]
        bits = pair_score(code, made, len(texts), pairs, paths)
        return pa.table({"doc_id": left["doc_id"].cast(pa.int64()), "n_tokens": n, "n_known": known, "base": base, "score": bits * math.log10(2), "size": pa.array([len(symbols(x)) for x in texts], pa.int64())})

    both = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    got = written(both.applyInArrow(run, "doc_id long, n_tokens long, n_known long, base double, score double, size long"), "scored")
    total = got.where("size < 0").first()
    tokens, kinds = (total.n_tokens, total.n_known) if total else (0, 0)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out")
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(tokens + kinds + 1))
    return got.where("size >= 0").select("doc_id", held_out, "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score", (-F.col("score") / F.lit(math.log10(2)) / F.col("size")).alias("bits_per_byte"))
