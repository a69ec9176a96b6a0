"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

#: The vocabulary file that is used where none is named.
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where that is unset, one of our own in local mode (tests), and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows written as a table in the shared folder and read again: the lineage ends there, and lost executors lose nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Gives memory that Python and Arrow have freed back to the system.  A Python worker lives on after its task, and would hold it beside the stages that run in the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that gives back at its end what it has freed."""

    def freeing(batches):
        yield from run(batches)
        release()

    return freeing


def group_released(run: Callable) -> Callable:
    """The same for a task over the table of a group."""

    def freeing(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        out = run(key, rows)
        release()
        return out

    return freeing


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  ``bytes.lower`` and ``bytes.split`` deal with ASCII alone, as is wanted."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHash(dict):
    """Word to 64-bit hash; forgets all when it holds ``most`` words, so memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got

    def of(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b + 32 if 65 <= b <= 90 else b]), seed=7) for b in range(256)], np.uint64)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_BASE = 0x9E3779B97F4A7C15
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, n of each at least."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 19), base, np.uint64)]))
    return _POWERS


def hashed_words(texts: list[str | None], part: int = 250_000) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``lower_words`` of all texts side by side, and how many each text has.

    A word's hash is a polynomial of its bytes, from prefix sums over a quarter of a megabyte of texts at a time; no word becomes an object.
    """
    hashes, counts, held, size = [], [], [], 0

    def flush():
        data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        up, down = _powers(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE.take(data) * up[: len(data)], dtype=np.uint64)])
        blank = _BLANK.take(data)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        hashes.append(mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        at = starts([len(x) + 1 for x in held])
        counts.append(np.diff(np.searchsorted(first, at)))

    for text in texts:
        held.append(text.encode("utf-8", "surrogatepass") if text else b"")
        size += len(held[-1])
        if size >= part:
            flush()
            held, size = [], 0
    if held:
        flush()
    return (np.concatenate(hashes), np.concatenate(counts)) if counts else (np.empty(0, np.uint64), np.empty(0, np.int64))


def mixed(h: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit words."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word hashes; empty if there are fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mixed(out)


def starts(lengths) -> np.ndarray:
    """Offsets of rows that lie one after another; one more than there are rows."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def task_base() -> int:
    """First row number of this task: unique over tasks, and the same when the task is run again."""
    ctx = TaskContext.get()
    return (ctx.partitionId() if ctx else 0) << 40


#: Texts with other white space than single spaces and newlines between words are encoded as they are.
IRREGULAR = re.compile(r"^\s|\s$|\s\s|[^\S \n]")


class PieceEncoder:
    """Byte-level BPE by ``tokenizers`` with a bounded memo of pieces; gives what ``encode`` gives for the whole text.

    A pre-token always begins at a single space or newline between two characters
    that are no white space, so what lies between these is encoded apart.  A space
    belongs to the piece on its right; a newline is a pre-token of its own.
    Texts with marks of special tokens are encoded as they are.
    """

    def __init__(self, path: str, kind=np.uint32, most: int = 600_000, longest: int = 40):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t, self.kind, self.most, self.longest = Tokenizer.from_file(path), kind, most, longest
        (self.newline,) = self.t.encode("\n", add_special_tokens=False).ids
        #: Of pieces at a text's begin, and of pieces after a space; those after a newline have it before them.
        self.first: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def _learn(self, memo: dict[str, bytes], keys: list[str], texts: list[str], before: bytes = b"") -> None:
        """Encodes pieces as the lines of a longer text."""
        for k in range(0, len(keys), 5_000):
            part = texts[k : k + 5_000]
            ids = np.array(self.t.encode_batch_fast(["\n".join(part)], add_special_tokens=False)[0].ids, self.kind)
            cut = [0, *((np.flatnonzero(ids == self.newline) + 1) * ids.itemsize).tolist(), (len(ids) + 1) * ids.itemsize]
            raw, wide = ids.tobytes(), ids.itemsize
            memo.update(zip(keys[k : k + 5_000], [before + raw[a : b - wide] for a, b in zip(cut, cut[1:], strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian bytes of the chosen width."""
        split = [None if IRREGULAR.search(x) or "<|" in x else x.replace("\n", " \n").split(" ") if x else [] for x in texts]
        first = list({p[0] for p in split if p} - self.first.keys())
        self._learn(self.first, first, first)
        seen: set[str] = set()
        for p in split:
            if p:
                seen.update(p[1:])
        new = seen - self.inner.keys()
        lines = [x for x in new if x[0] == "\n"]
        words = [x for x in new if x[0] != "\n"]
        self._learn(self.inner, lines, [x[1:] for x in lines], np.array([self.newline], self.kind).tobytes())
        self._learn(self.inner, words, [" " + x for x in words])
        whole = iter(self.t.encode_batch_fast([x for x, p in zip(texts, split, strict=True) if p is None], add_special_tokens=False))
        get, head = self.inner.__getitem__, self.first
        out = [np.array(next(whole).ids, self.kind).tobytes() if p is None else head[p[0]] + b"".join(map(get, p[1:])) if p else b"" for p in split]
        # A full memo keeps what it has: common pieces come early.
        spare = len(new) if len(self.inner) > self.most else 0
        for x in new if spare else [x for x in new if len(x) > self.longest]:
            del self.inner[x]
        if len(self.first) > self.most // 10:
            self.first.clear()
        return out


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder_of(path: str | None, kind=np.uint32) -> PieceEncoder:
    """The encoder of this Python process, kept from task to task."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    key = (path, np.dtype(kind).str)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, kind)
    return _ENCODERS[key]


def small_batches(batches, most: int = 4_000_000, column: str = "text"):
    """Arrow batches cut so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = np.fromiter((0 if x is None else x for x in pc.binary_length(batch.column(column)).to_pylist()), np.int64, batch.num_rows)
        group, at = starts(size)[:-1] // most, 0
        for end in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]:
            yield batch.slice(at, end - at)
            at = end


def arrow(kinds: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A batch of named columns with their types."""
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in kinds.values()], names=list(kinds))
