"""Operator 9: packing into fixed-length sequences, first-fit decreasing over a tournament tree of bin capacities.

A document's ids are cut into pieces of exactly ``length``; these are sequences
of their own and move nowhere.  What remains of each document (fewer than
``length`` ids) goes, without its ids, to one of many randomised groups, and in
each group first-fit decreasing puts it in the first bin that has room.  A group
has about ``group_rows`` remainders whatever the size of the input, so no task
grows with it.

Nulls and edge cases: a null text is the empty text, whose only id is the end
id; a null doc_id is kept as it is; repeated rows are packed as often as they
come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import arrow, encoder_of, released, small_batches, task_base, written

LENGTH = 1024
GROUP_ROWS = 8000
PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_pieces(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Each document's ids with the end id, in pieces of ``length`` and one shorter remainder: place, length and crc32 of each piece."""

    def run(batches):
        encoder, row = encoder_of(tokenizer), task_base()
        end, step = np.array([end_id], "<u4").tobytes(), 4 * length
        for batch in small_batches(batches):
            out = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([x or "" for x in batch.column("text").to_pylist()]), strict=True):
                ids += end
                out += [(row + k // step, doc, k // 4, len(ids[k : k + step]) // 4, zlib.crc32(ids[k : k + step]), len(ids) // 4) for k in range(0, len(ids), step)]
                row += len(ids) // step + 1
            yield arrow({n: (c, pa.int64()) for n, c in zip(("row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"), zip(*out, strict=True), strict=True)})

    return docs.select("doc_id", "text").mapInArrow(released(run), PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.  The tree's leaves are the bins' free room and each inner node is the larger of its two: the first bin with room is found from the root in log2(bins) steps."""
    n = len(lengths)
    leaves = 1 << max(0, int(n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, at = int(lengths[i]), 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - tree[at]
        tree[at] -= size
        at //= 2
        while at:
            best = tree[2 * at] if tree[2 * at] >= tree[2 * at + 1] else tree[2 * at + 1]
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
    return bins, offsets


def pack(docs: DataFrame, length: int = LENGTH, tokenizer: str | None = None, group_rows: int = GROUP_ROWS, n_docs: int | None = None, seed: int = 0) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    Sequence ids are even for groups' bins, odd for full pieces.  ``n_docs`` only
    sets how many groups there are; it is counted where it isn't given.
    """
    groups = max(1, -(-(docs.count() if n_docs is None else n_docs) // group_rows))
    cut = cut_pieces(docs, length, tokenizer)
    whole = (F.col("length") == length).alias("whole")
    # A full piece needs no company: it stays in a group of its own size class, dealt by row so that no group grows.
    keyed = cut.select("*", F.when(whole, F.lit(None)).otherwise(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups))).alias("group"))

    def fill(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        return rows.drop_columns(["row", "group"]).append_column("sequence_id", pa.array(((key[0].as_py() << 32) + bins) * 2)).append_column("offset", pa.array(offsets))

    # The cut is written once: both branches read it, and no document is encoded twice.
    keyed = written(keyed, "pieces")
    full = keyed.where(F.col("group").isNull()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("row") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    packed = keyed.where(F.col("group").isNotNull()).groupBy("group").applyInArrow(fill, PACKED)
    return full.unionByName(packed)


def padding(packed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Sequences, ids and padding of a packing; a sequence whose ids are a power of two in number isn't padded."""
    filled = packed.groupBy("sequence_id").agg(F.sum("length").alias("filled"))
    power = F.col("filled").bitwiseAND(F.col("filled") - 1) == 0
    return filled.agg(F.count("*").alias("sequences"), F.sum("filled").alias("ids"), F.sum(F.when(power, 0).otherwise(length - F.col("filled"))).alias("padding"))


