"""Operator 6: token ids materialised in training order, as fixed-stride binary shards.

Documents are encoded, each followed by the end id, and the ids of a task's
documents are cut into sequences of ``length``.  Sequences are numbered without
gaps (a task's first number is the sum of the counts of the tasks before it), and a
keyed Feistel permutation of 0..n-1, by cycle-walking, gives each its slot in the
training order.  A range of ``per_shard`` slots is a shard: one binary of records of
equal width, so slot s is found at byte (s mod per_shard) * stride of shard
s div per_shard, and reading can stop and go on anywhere.

Nulls and edge cases: a null or empty text has the end id alone; the last sequence of
each task is filled up with the end id (n_tokens says how many ids are its
own); repeated rows come as often as they are there; an empty table gives no shards;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.bytes_bpe import END, encoding
from quarry.llm.common import arrow, small_batches, written

LENGTH, PER_SHARD, KEY, ROUNDS = 1024, 1024, 20260101, 4
#: So many tasks' first numbers are sent to all tasks; more are joined by shuffle.
BROADCAST_TASKS = 500_000
SPANS = "array<struct<doc_id:long,start:long,length:int>>"
SPAN_TYPE = pa.list_(pa.struct({"doc_id": pa.int64(), "start": pa.int64(), "length": pa.int32()}))


def feistel(x: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Slots of numbers below n: a permutation of 0..n-1.  The network permutes the next even power of two; numbers that land beyond n go through it again."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(v):
        left, right = v >> np.uint64(half), v & mask
        for r in range(rounds):
            h = (right + np.uint64(key & 0xFFFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key >> 32) + r * 0x632BE5AB)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((h >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(x.astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = once(out[far])
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int = LENGTH, end_id: int = END, ranks: str | None = None) -> DataFrame:
    """(task, at, n_tokens, spans, payload) of each sequence: where its ids come from, and the ids as little-endian uint16."""

    def run(batches):
        encode, task = encoding(ranks).encode_ordinary, TaskContext.get().partitionId()
        held, spans, filled, at = [], [], 0, 0

        def flush(out):
            nonlocal held, spans, filled, at
            ids = np.concatenate(held)
            out.append((task, at, filled, spans, np.pad(ids, (0, length - filled), constant_values=end_id).astype("<u2").tobytes()))
            held, spans, filled, at = [], [], 0, at + 1

        def batch_of(out):
            task, at, n, spans, payload = zip(*out, strict=True) if out else ([],) * 5
            return arrow({"task": (task, pa.int64()), "at": (at, pa.int64()), "n_tokens": (n, pa.int32()), "spans": (spans, SPAN_TYPE), "payload": (payload, pa.binary())})

        for batch in small_batches(batches):
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*(encode(text) if text else ()), end_id], np.uint16)
                k = 0
                while k < len(ids):
                    part = ids[k : k + length - filled]
                    held.append(part)
                    spans.append({"doc_id": doc, "start": k, "length": len(part)})
                    filled, k = filled + len(part), k + len(part)
                    if filled == length:
                        flush(out)
            yield batch_of(out)
        if filled:
            out = []
            flush(out)
            yield batch_of(out)

    return docs.select("doc_id", "text").mapInArrow(run, f"task long, at long, n_tokens int, spans {SPANS}, payload binary")


def placed(rows: DataFrame, key: int = KEY) -> DataFrame:
    """The sequences with their slots."""
    counts = rows.groupBy("task").agg(F.count("*").alias("n"))
    # One row per task of the encoding job, not per sequence.
    first = counts.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("base"))
    tasks, total = counts.agg(F.count("*"), F.sum("n")).first()
    total = total or 0

    def run(batches):
        for batch in batches:
            slot = feistel(batch.column("base").to_numpy() + batch.column("at").to_numpy(), total, key)
            yield pa.RecordBatch.from_arrays([pa.array(slot), *[batch.column(c) for c in ("n_tokens", "spans", "payload")]], names=["slot", "n_tokens", "spans", "payload"])

    return rows.join(F.broadcast(first) if tasks <= BROADCAST_TASKS else first, "task").mapInArrow(run, f"slot long, n_tokens int, spans {SPANS}, payload binary")


def shards(docs: DataFrame, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, end_id: int = END, ranks: str | None = None) -> DataFrame:
    """(shard, first_slot, n, stride, payload, n_tokens, spans): a row per shard; the last two have an entry per record."""
    rows = written(sequences(docs, length, end_id, ranks), "sequences", "zstd")
    stride = 2 * length

    def run(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows, shard = rows.sort_by("slot"), group[0].as_py()
        one = {"shard": shard, "first_slot": shard * per_shard, "n": rows.num_rows, "stride": stride}
        return pa.table({**{k: pa.array([v], pa.int64()) for k, v in one.items()}, "payload": pa.array([b"".join(x.as_py() for x in rows["payload"])], pa.binary()), "n_tokens": pa.array([rows["n_tokens"].to_pylist()], pa.list_(pa.int32())), "spans": pa.array([rows["spans"].to_pylist()], pa.list_(SPAN_TYPE))})

    slots = placed(rows, key).withColumn("shard", F.expr(f"slot div {per_shard}"))
    return slots.groupBy("shard").applyInArrow(run, f"shard long, first_slot long, n long, stride long, payload binary, n_tokens array<int>, spans array<{SPANS}>")


def records(shards: DataFrame, from_slot: int = 0) -> DataFrame:
    """(slot, shard, byte, n_tokens, ids_crc32, spans, payload) of the records from a slot on: whole shards before it aren't read."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keep = range(max(0, from_slot - r["first_slot"]), r["n"])
                cut = [r["payload"][k * r["stride"] : (k + 1) * r["stride"]] for k in keep]
                yield arrow({"slot": ([r["first_slot"] + k for k in keep], pa.int64()), "shard": ([r["shard"]] * len(keep), pa.int64()), "byte": ([k * r["stride"] for k in keep], pa.int64()), "n_tokens": ([r["n_tokens"][k] for k in keep], pa.int32()), "ids_crc32": ([zlib.crc32(x) for x in cut], pa.int64()), "spans": ([r["spans"][k] for k in keep], SPAN_TYPE), "payload": (cut, pa.binary())})

    return shards.where(F.col("first_slot") + F.col("n") > from_slot).mapInArrow(run, f"slot long, shard long, byte long, n_tokens int, ids_crc32 long, spans {SPANS}, payload binary")


def write_shards(shards: DataFrame, path: str) -> None:
    """One row per shard: each file has some whole shards, which are shuffled by number when they are made and aren't moved again."""
    shards.sortWithinPartitions("shard").write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """Records of written shards in training order from a slot on."""
    return records(spark.read.parquet(path), from_slot)
