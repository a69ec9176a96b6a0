"""Operator 10: substring deduplication by content-defined chunking with a gear rolling hash.

A cut lies wherever the gear hash of the last 32 bytes has its top bits all zero,
so cuts depend on content near them alone and shift along with an insertion.
Chunks are told apart by a digest of 128 bits.  Each chunk's first occurrence, by
(doc_id, place), stays; a document loses the runs of later occurrences that are at
least ``least_words`` words long together.  Runs below that stay, so common short
strings aren't touched.

A batch sends, packed, one occurrence of each chunk to the bucket of its digest:
the first it has.  All its others are known to be later ones, so a chunk that very
many documents share reaches its bucket once a batch.  Buckets send back the
places of later occurrences only.  One pass over the documents follows, which cuts.

Nulls and edge cases: a null text stays null and an empty one empty; a text
without a cut is one chunk; of repeated rows (the same doc_id and text) one, the first
as rows were written, is the earliest, and all chunks of the others are later ones; a
null doc_id comes last in the order, and rows of one doc_id go by a hash of their text;
empty tables give no rows; other columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import group_released, released, small_batches, starts, written

#: Top bits that must be zero at a cut: chunks are 2**BITS bytes long on average.
BITS = 5
SPAN = 32
LEAST_WORDS = 20
BUCKET_ROWS = 400_000
#: 256 fixed random words of the gear hash, from a rule.
GEAR = np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=1) & 0xFFFFFFFF for b in range(256)], np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """Hash at each byte over the last ``SPAN``: h = (h << 1) + gear[byte], by doubling spans."""
    h, span = GEAR[data], 1
    while span < SPAN:
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span) if span < len(h) else np.uint32(0)
        h, span = more, 2 * span
    return h


def cuts(data: bytes) -> np.ndarray:
    """Ends of the chunks of one text; the last is its length."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    at = np.flatnonzero(gear_hash(np.frombuffer(data, np.uint8)) >> np.uint32(32 - BITS) == 0) + 1
    at = at[at >= SPAN]
    return at if len(at) and at[-1] == n else np.append(at, n)


def chunks(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ends, digests) of a text's chunks."""
    return all_chunks([data])[0]


def digests(text: bytes, ends: list[int]) -> np.ndarray:
    """128-bit digests of the chunks that end there, as rows of two words."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(text[a:b]) for a, b in zip([0, *ends], ends, strict=False)]), np.uint64).reshape(-1, 2)


def all_chunks(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Chunks of many texts: the hash runs once over all of them, and cuts within ``SPAN`` of a text's begin are left out."""
    at = starts([len(x) for x in texts])
    joined = b"".join(texts)
    if not joined:
        return [(np.empty(0, np.int64), np.empty((0, 2), np.uint64)) for _ in texts]
    found = np.flatnonzero(gear_hash(np.frombuffer(joined, np.uint8)) >> np.uint32(32 - BITS) == 0) + 1
    out = []
    low, high = np.searchsorted(found, at[:-1] + SPAN), np.searchsorted(found, at[1:], side="right")
    for k, text in enumerate(texts):
        ends = found[low[k] : high[k]] - at[k] if high[k] > low[k] else found[:0]
        if text and (not len(ends) or ends[-1] != len(text)):
            ends = np.append(ends, len(text))
        out.append((ends, digests(text, ends.tolist())))
    return out


def encoded(texts: list[str | None]) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in texts]


def packed_chunks(docs: DataFrame, buckets: int) -> DataFrame:
    """A batch's first occurrences by bucket of their digest, and its others (kind 1) by bucket of their row; packed."""

    def packed(bucket, kind, *columns):
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        at = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)] if len(bucket) else [0]
        cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(bucket[at[:-1]]), pa.array([kind] * (len(at) - 1), pa.int32()), *[cut(x[order]) for x in columns]], names=["bucket", "kind", "digests", "ranks", "keys", "places"])

    def run(batches):
        for batch in small_batches(batches, 8_000_000):
            parts = all_chunks(encoded(batch.column("text").to_pylist()))
            n = [len(d) for _, d in parts]
            if not sum(n):
                continue
            digest = np.concatenate([d for _, d in parts])
            place = np.concatenate([np.arange(k, dtype=np.uint32) for k in n])
            rank, key = (np.repeat(np.array(batch.column(c).to_pylist(), np.int64), n) for c in ("rank", "key"))
            digest, rank, key, place, later = in_order(digest, rank, key, place)
            yield packed((digest[~later, 0] >> np.uint64(11)).astype(np.int64) % buckets, 0, digest[~later], rank[~later], key[~later], place[~later])
            yield packed((key[later] >> 7) % buckets, 1, digest[later], rank[later], key[later], place[later])

    return docs.select("rank", "key", "text").mapInArrow(released(run), "bucket long, kind int, digests binary, ranks binary, keys binary, places binary")


def in_order(digest, rank, key, place):
    """Occurrences by (digest, rank, key, place), each once, and whether another of the digest comes before."""
    order = np.lexsort((place, key, rank, digest[:, 1], digest[:, 0]))
    digest, rank, key, place = digest[order], rank[order], key[order], place[order]
    later = np.append(False, (digest[1:] == digest[:-1]).all(1))[: len(digest)]
    once = ~(later & np.append(False, (key[1:] == key[:-1]) & (place[1:] == place[:-1]))[: len(digest)])
    return digest[once], rank[once], key[once], place[once], later[once]


def later_places(packed: DataFrame) -> DataFrame:
    """(key, places) of chunks that occur before, by (rank, key, place): one row per document and bucket."""

    def run(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        def read(kind):
            part = rows.filter(pc.equal(rows["kind"], kind))
            return [np.frombuffer(b"".join(x.as_py() for x in part[c]), t) for c, t in (("digests", np.uint64), ("ranks", np.int64), ("keys", np.int64), ("places", np.uint32))]

        digest, rank, key, place = read(0)
        digest = digest.reshape(-1, 2)
        # Only digests of which the first word occurs twice are put in order.
        order = np.argsort(digest[:, 0], kind="stable")
        same = digest[order, 0][1:] == digest[order, 0][:-1]
        order = order[(np.append(same, False) | np.append(False, same))[: len(order)]]
        _, _, key, place, later = in_order(digest[order], rank[order], key[order], place[order])
        known = read(1)
        key, place = np.concatenate([key[later], known[2]]), np.concatenate([place[later], known[3]])
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        at = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else [0]
        return pa.table({"key": pa.array(key[at[:-1]], pa.int64()), "places": pa.array([place[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary())})

    return packed.groupBy("bucket").applyInArrow(group_released(run), "key long, places binary")


def runs_to_drop(data: bytes, ends: np.ndarray, later: np.ndarray, least_words: int) -> list[tuple[int, int]]:
    """Byte spans of consecutive later chunks that hold at least ``least_words`` words."""
    edge = np.diff(np.concatenate([[0], later.astype(np.int8), [0]]))
    out = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        low, high = int(ends[a - 1]) if a else 0, int(ends[b - 1])
        # A span never splits a character of UTF-8.
        while low < high and data[low] & 0xC0 == 0x80:
            low += 1
        while high > low and high < len(data) and data[high] & 0xC0 == 0x80:
            high -= 1
        if len(data[low:high].split()) >= least_words:
            out.append((low, high))
    return out


def row_key():
    """A row by its id and text: repeated rows share it."""
    return F.xxhash64("doc_id", "text")


def keyed(docs: DataFrame) -> DataFrame:
    """(rank, key, text): the doc_id, null last, and the row's key."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rank"), row_key().alias("key"), "text")


def free(name: str, docs: DataFrame) -> str:
    """A column name that the documents don't have."""
    while name in docs.columns:
        name += "_"
    return name


def deduplicate(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The documents with the columns n_chunks, n_later, dropped (byte spans of the old text) added (columns of these names give way), and text without the dropped spans."""
    names = ["n_chunks", "n_later", "dropped"]
    docs = docs.drop(*names)
    own, fields = docs.columns, docs.schema.fields
    size, rows, keys = docs.agg(F.sum(F.octet_length("text")), F.count("*"), F.count_distinct(row_key())).first()
    buckets = max(1, ((size or 0) >> BITS) // BUCKET_ROWS)
    row, key, places, first = (free(x, docs) for x in ("row", "key", "places", "first"))
    # Repeated rows get numbers, which are written so that all who read them see the same.
    docs = docs.withColumn(row, F.monotonically_increasing_id() if rows != keys else F.lit(None).cast("long"))
    docs = written(docs, "numbered") if rows != keys else docs
    marks = later_places(packed_chunks(keyed(docs), buckets)).select("key", "places", F.lit(None).cast("long").alias("first"))
    if rows != keys:
        repeated = docs.groupBy(row_key().alias("key")).agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1")
        marks = marks.unionByName(repeated.select("key", F.lit(None).cast("binary").alias("places"), "first"))
    marks = marks.groupBy(F.col("key").alias(key)).agg(F.collect_list("places").alias(places), F.max("first").alias(first))
    both = docs.join(marks, F.xxhash64(docs["doc_id"], docs["text"]) == marks[key], "left").drop(key)
    schema = pa.list_(pa.struct({"begin": pa.int64(), "end": pa.int64()}))

    def run(batches):
        for batch in small_batches(batches, 8_000_000):
            data = encoded(batch.column("text").to_pylist())
            texts, count, n_later, dropped = [], [], [], []
            marked = (batch.column(c).to_pylist() for c in ("text", places, row, first))
            for text, (ends, _), old, found, mine, one in zip(data, all_chunks(data), *marked, strict=True):
                flags = np.full(len(ends), one is not None and mine != one)
                for x in found or ():
                    flags[np.frombuffer(x, np.uint32)] = True
                spans = runs_to_drop(text, ends, flags, least_words) if flags.any() else []
                at, kept = 0, []
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                texts.append(b"".join([*kept, text[at:]]).decode("utf-8", "surrogatepass") if spans else old)
                count.append(len(ends))
                n_later.append(int(flags.sum()))
                dropped.append([{"begin": a, "end": b} for a, b in spans])
            columns = {c: (pa.array(texts, pa.string()) if c == "text" else batch.column(c)) for c in own}
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(count, pa.int64()), pa.array(n_later, pa.int64()), pa.array(dropped, schema)], names=[*columns, *names])

    added = StructType.fromDDL("n_chunks long, n_later long, dropped array<struct<begin:long,end:long>>")
    return both.mapInArrow(released(run), StructType([*fields, *added.fields]))


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents with repeated passages cut out of their texts; those of which no word is left go.  All columns kept; n_chars, where there is one, follows the text."""
    aside = {c: f"_{c}" for c in ("n_chunks", "n_later", "dropped") if c in docs.columns}
    got = deduplicate(docs.withColumnsRenamed(aside), **options)
    got = got.where(F.col("text").isNull() | (F.size("dropped") == 0) | F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.when(F.size("dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return got.drop("n_chunks", "n_later", "dropped").withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)
