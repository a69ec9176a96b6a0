"""Operator 1: benchmark decontamination as a prefix-filtered set join.

Each benchmark item gives windows of ``window`` consecutive words (an item of
fewer words is one window).  A window is found in a document only if all its
shingles are there, so one shingle is a sufficient prefix: the rarest, by how
often the whole corpus has it.  Documents are joined with the windows on that
shingle alone; the bounds on position (the window may not begin before the
document) and length (nor end after it) come next, and then an exact comparison
of the words.

The windows' shingles are used in the tasks to drop a document's other shingles
before the join, but only where there are at most ``prune_most`` of them; beyond
that every shingle goes to a shuffled join, and the result is the same.

Nulls and edge cases: a null or empty text has no words and isn't contaminated;
an item without words has no window; a null item_id is named nowhere, but its
windows hit; repeated items are one item; each row of documents gives one row;
empty tables give no rows, or no hits; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import WordHash, released, shingles, small_batches, starts, task_base

WINDOW = 10
SHINGLE = 3
PRUNE_MOST = 500_000
#: UTF-8 bytes of words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`, A-Z lower-cased; every other byte becomes a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
OCCURRENCE = "array<struct<at:int,before:int,words:array<string>>>"
DOCS = f"row long, doc_id long, n_words long, found array<struct<key:long,occurrences:{OCCURRENCE}>>"


def words_of(text: str | None) -> list[bytes]:
    """Words of the lower-cased text, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def windows_of(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Windows of the items with the keys of their shingles: (item_id, words, width, keys)."""

    def run(batches):
        hashes = WordHash()
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text)
                size = min(window, len(words))
                h = hashes.of(words)
                for k in range(len(words) - size + 1) if size else ():
                    width = min(shingle, size)
                    out.append({"item_id": item, "words": [x.decode("utf-8", "replace") for x in words[k : k + size]], "width": width, "keys": shingles(h[k : k + size], width).view(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(out, pa.schema({"item_id": pa.int64(), "words": pa.list_(pa.string()), "width": pa.int32(), "keys": pa.list_(pa.int64())}))

    return items.select("item_id", "text").mapInArrow(released(run), "item_id long, words array<string>, width int, keys array<long>").distinct()


def _tokens(batch: pa.RecordBatch, hashes: WordHash) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each row, hashes of all words, and the rows' offsets among these."""
    words = [words_of(x) for x in batch.column("text").to_pylist()]
    at = starts([len(x) for x in words])
    return words, hashes.of([x for row in words for x in row]), at


def _places(h: np.ndarray, at: np.ndarray, widths: list[int], wanted: np.ndarray | None):
    """(row, word, key) of each shingle inside a row, of those wanted only."""
    for width in widths:
        keys = shingles(h, width).view(np.int64)
        if wanted is None:
            hit = np.arange(len(keys))
        else:
            # A bitmap of the keys' low bits first: nearly all shingles end there.
            bits = np.zeros(1 << 20, bool)
            bits[wanted & 0xFFFFF] = True
            hit = np.flatnonzero(bits[keys & 0xFFFFF])
            hit = hit[np.isin(keys[hit], wanted)]
        row = np.searchsorted(at, hit, side="right") - 1
        inside = hit + width <= at[row + 1]
        hit, row = hit[inside], row[inside]
        yield row, hit - at[row], keys[hit]


def rarity(docs: DataFrame, widths: list[int], wanted: np.ndarray | None) -> DataFrame:
    """How often all documents have each wanted shingle: (key, n)."""

    def run(batches):
        hashes = WordHash()
        for batch in small_batches(batches):
            _, h, at = _tokens(batch, hashes)
            for _, _, keys in _places(h, at, widths, wanted):
                key, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    return docs.select("text").mapInArrow(released(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def occurrences(docs: DataFrame, widths: list[int], wanted: np.ndarray | None, window: int = WINDOW) -> DataFrame:
    """One row per document with the places of wanted shingles and the words about each, as many as a window can reach."""

    def run(batches):
        hashes, base = WordHash(), task_base()
        for batch in small_batches(batches):
            words, h, at = _tokens(batch, hashes)
            found: list[dict] = [{} for _ in words]
            for rows, places, keys in _places(h, at, widths, wanted):
                for r, p, k in zip(rows.tolist(), places.tolist(), keys.tolist(), strict=True):
                    low = max(0, p - window + 1)
                    found[r].setdefault(k, []).append({"at": p, "before": p - low, "words": [x.decode("utf-8", "replace") for x in words[r][low : p + window]]})
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(base, base + n)),
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(np.diff(at)),
                    pa.array([[{"key": k, "occurrences": o} for k, o in f.items()] for f in found], pa.list_(pa.struct({"key": pa.int64(), "occurrences": pa.list_(pa.struct({"at": pa.int32(), "before": pa.int32(), "words": pa.list_(pa.string())}))}))),
                ],
                names=["row", "doc_id", "n_words", "found"],
            )
            base += n

    return docs.select("doc_id", "text").mapInArrow(released(run), DOCS)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, prune_most: int = PRUNE_MOST) -> DataFrame:
    """Per document: row, doc_id, n_words, n_hit, items (sorted as strings), spans (at, size) of hit windows."""
    windows = windows_of(items, window, shingle)
    sizes = windows.agg(F.sum(F.size("keys")).alias("n"), F.collect_set("width").alias("widths")).first()
    widths = sorted(sizes["widths"])
    wanted = None
    if (sizes["n"] or 0) <= prune_most:
        wanted = np.array(sorted({k for (keys,) in windows.select("keys").collect() for k in keys}), np.int64)

    # The rarest shingle of each window, ties by key: its prefix.
    each = windows.withColumn("window", F.xxhash64("item_id", "words")).select("*", F.posexplode("keys").alias("ahead", "key"))
    ranked = each.join(rarity(docs, widths, wanted), "key", "left").groupBy("window", "item_id", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "ahead")).alias("prefix"))
    index = ranked.groupBy(F.col("prefix.key").alias("key")).agg(F.collect_list(F.struct("item_id", "words", F.col("prefix.ahead").alias("ahead"))).alias("windows"))
    if wanted is not None:
        index = index.persist()
        wanted = np.array(sorted(r[0] for r in index.select("key").collect()), np.int64)
        index = F.broadcast(index)

    found = occurrences(docs, widths, wanted, window).select("row", "doc_id", "n_words", F.explode_outer("found").alias("f"))
    # Rows without a place get a key of their own, so that no partition gathers them; `has` keeps them from meeting a window.
    left = found.select("row", "doc_id", "n_words", F.col("f.occurrences").alias("occurrences"), F.col("f").isNotNull().alias("has"), F.coalesce("f.key", F.xxhash64("row")).alias("key"))
    met = left.join(index.withColumn("has", F.lit(True)), ["key", "has"], "left")
    hits = F.expr("""
        flatten(transform(windows, w -> transform(
            filter(occurrences, o -> o.before >= w.ahead
                and o.before - w.ahead + size(w.words) <= size(o.words)
                and slice(o.words, o.before - w.ahead + 1, size(w.words)) = w.words),
            o -> struct(o.at - w.ahead as at, size(w.words) as size, w.item_id as item_id))))""")
    per_doc = met.select("row", "doc_id", "n_words", hits.alias("hits")).groupBy("row", "doc_id", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    return per_doc.select(
        "row",
        "doc_id",
        "n_words",
        F.expr("cast(size(array_distinct(flatten(transform(hits, h -> sequence(h.at, h.at + h.size - 1))))) as long)").alias("n_hit"),
        F.expr("array_sort(array_distinct(transform(filter(hits, h -> h.item_id is not null), h -> cast(h.item_id as string))))").alias("items"),
        F.expr("array_sort(array_distinct(transform(hits, h -> struct(h.at, h.size))))").alias("spans"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without a hit, all columns kept.  A row is known by its id and text, so rows with a null or repeated doc_id go or stay by their own text."""
    keys = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    hit = decontaminate(keys, items, **options).where("n_hit > 0").select(F.col("doc_id").alias("key")).distinct()
    return docs.join(hit, F.xxhash64(docs["doc_id"], docs["text"]) == hit["key"], "left_anti")
