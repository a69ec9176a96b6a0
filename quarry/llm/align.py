"""Operator 13: alignment of two tokenizers, with counts in id-striped dense matrices.

Tokenizer A (byte-level) and tokenizer B (pieces) cut one and the same bytes, a space and
the text.  Places where tokens of both end cut these into groups; tokens whose bytes
overlap are linked.  Each block of texts keeps its links and has a list of its different
pairs of ids, with how many of its documents hold each.

Pairs are partitioned by stripe, the A id modulo the number of stripes, which deals
frequent ids out evenly.  A task adds the pairs of a stripe into a dense block of counts,
A ids of the stripe by all B ids, with ``np.add.at``; row maxima are the best counts.  A
stripe's blocks may be shared out among tasks (``SHARE`` blocks each) whose counts are
added up.  For the scores the same pairs, partitioned alike, meet their stripe's finished
counts, and go back to their block, which sums them up along its own links.

Pieces of a text between single spaces and newlines are cut by both tokenizers on their
own, so a piece is aligned once and remembered; other texts are aligned as wholes.

Nulls and edge cases: a text that is null, empty, or whose bytes by A or by B differ from
a space and the text has no tokens: zeros, and an empty ``groups_sha256``; strings of
special tokens are plain text; each row is a document of its own, repeated ones too;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import IRREGULAR, small_batches, starts, task_base, written

PIECES = "piece_bpe_32k.model"
#: A ids of a stripe, and blocks of texts whose pairs are counted or scored in one task.
WIDE = 256
SHARE = 4_096
#: Bytes of text in a block; pieces that are remembered at most, and their characters.
BLOCK = 4_000_000
MOST, MOST_BYTES = 400_000, 16_000_000
ROWS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, at binary, times binary, stripe int, a binary, b binary, n binary"
SUMS = "stripe int, a binary, b binary, n binary"


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of two ascending lists without repetition, and those that both have."""
    # Two runs, which a stable sort merges.
    both = np.sort(np.concatenate([a, b]), kind="stable")
    twice = both[1:] == both[:-1]
    return both[np.concatenate([[True], ~twice])] if len(both) else both, both[1:][twice]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends, place in A, place in B) of the links, and (ends, tokens of A, tokens of B) of the groups, from the tokens' ends, the last of which is one place."""
    # Between two neighbouring ends there is one token of either side, and no two such stretches have the same two.
    ends, common = merged(a_ends, b_ends)
    sizes = [np.diff(np.searchsorted(x, common, "right"), prepend=0) for x in (a_ends, b_ends)]
    return ends, np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends), common, *sizes


class Aligner:
    """Both tokenizers and the pieces aligned so far, kept from task to task."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        # Byte-level characters stand for bytes: printable Latin-1 characters for themselves, the others follow from 256 on.
        plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]
        letter = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
        if set(letter) != set(ByteLevel.alphabet()):
            raise ValueError("tokenizer A isn't byte-level as known")
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = [bytes(letter[c] for c in t) if t and all(c in letter for c in t) else b"" for t in map(self.a.id_to_token, range(size))]
        names = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(names)]
        self.n_b = len(names)
        #: No piece of B goes on over a space or a newline, so text can be cut there.
        self.apart = not any("▁" in x.lstrip("▁") or "\n" in x for x in names)
        lengths = lambda x: np.fromiter(map(len, x), np.int64, len(x))
        self.a_size, self.b_size = lengths(self.a_bytes), lengths(self.b_bytes)
        #: Ids as text with what follows them: in a group, after A's last, after B's last.
        written = lambda n, end: np.array([f"{k}{end}" for k in range(n)], object)
        self.inner = written(max(size, self.n_b), ",")
        self.a_last, self.b_last = written(size, "|"), written(self.n_b, ";")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.bytes_known = 0
        #: Of each known piece its groups as text, its figures and whether both sides have its bytes, and where its links lie.
        self.texts: list[str] = []
        self.figures = np.empty((0, 5), np.int64)
        self.codes = np.empty(0, np.int64)
        self.begin = np.zeros(1, np.int64)

    def aligned(self, data: list[bytes], a: list[list[int]], b: list[list[int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Of each text: its groups, with a ``;`` after each; (n_a, n_b, n_groups, n_links, whole), zeros where a side's bytes differ; and the pair codes of all links side by side."""
        ids = [np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b)]
        n = [np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b)]
        raw = [b"".join([t[k] for k in i.tolist()]) for t, i in zip((self.a_bytes, self.b_bytes), ids, strict=True)]
        size = np.fromiter(map(len, data), np.int64, len(data))
        sizes = [np.bincount(np.repeat(np.arange(len(data)), m), t[i], len(data)) for t, i, m in zip((self.a_size, self.b_size), ids, n, strict=True)]
        if not (raw[0] == raw[1] == b"".join(data) and all((s == size).all() for s in sizes)):
            whole = np.array([b"".join([self.a_bytes[k] for k in x]) == d == b"".join([self.b_bytes[k] for k in y]) for d, x, y in zip(data, a, b, strict=True)], bool)
            if not whole.all():
                some = np.flatnonzero(whole).tolist()
                texts, figures, codes = self.aligned([data[k] for k in some], [a[k] for k in some], [b[k] for k in some])
                out, all_figures = [""] * len(data), np.zeros((len(data), 5), np.int64)
                for k, t in zip(some, texts, strict=True):
                    out[k] = t
                all_figures[some] = figures
                return out, all_figures, codes
        # Texts lie one after another, so each ends with a token's end on both sides.
        link_ends, a_at, b_at, group_ends, a_group, b_group = overlaps(np.cumsum(self.a_size[ids[0]]), np.cumsum(self.b_size[ids[1]]))
        codes = ids[0][a_at] * self.n_b + ids[1][b_at]
        ends = np.cumsum(size)
        links = np.diff(np.searchsorted(link_ends, ends, "right"), prepend=0)
        groups = np.searchsorted(group_ends, ends, "right")
        # A group's ids of A, then those of B.
        text = np.empty(len(ids[0]) + len(ids[1]), object)
        for own, other, sizes_own, sizes_other, late, final in ((ids[0], ids[1], a_group, b_group, 0, self.a_last), (ids[1], ids[0], b_group, a_group, 1, self.b_last)):
            group = np.repeat(np.arange(len(sizes_own)), sizes_own)
            before = np.concatenate([[0], np.cumsum(sizes_other)])[group + late]
            last = np.zeros(len(own), bool)
            last[np.cumsum(sizes_own) - 1] = True
            text[np.arange(len(own)) + before] = np.where(last, final[np.minimum(own, len(final) - 1)], self.inner[own])
        at = [0, *np.cumsum(n[0] + n[1]).tolist()]
        text = text.tolist()
        out = ["".join(text[i:j]) for i, j in zip(at, at[1:], strict=False)]
        return out, np.stack([n[0], n[1], np.diff(groups, prepend=0), links, np.ones(len(data), np.int64)], 1), codes

    def learn(self, pieces: set[str]) -> None:
        """Aligns pieces that come after a space, or that begin with a newline."""
        if not pieces:
            return
        plain = [x for x in pieces if x[0] != "\n"]
        lines = [x for x in pieces if x[0] == "\n"]
        # B puts a space before what it gets, which lines don't have; A cuts after the newline.
        ahead = self.b.encode(lines, num_threads=1) if lines else []
        if any(self.b_bytes[x[0]] != b" " for x in ahead):
            raise ValueError("tokenizer B joins the space before a text with a newline")
        data = [f" {x}" for x in plain] + lines
        a = [x.ids for x in self.a.encode_batch_fast(data, add_special_tokens=False)]
        b = (self.b.encode(plain, num_threads=1) if plain else []) + [x[1:] for x in ahead]
        texts, figures, codes = self.aligned([x.encode() for x in data], a, b)
        self.known.update(zip(plain + lines, range(len(self.texts), len(self.texts) + len(data)), strict=True))
        self.bytes_known += sum(map(len, data))
        self.texts += texts
        self.figures = np.concatenate([self.figures, figures])
        self.codes = np.concatenate([self.codes, codes])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(figures[:, 3])])

    def documents(self, texts: list[str | None]) -> tuple[list[tuple], np.ndarray]:
        """(n_a, n_b, n_groups, n_links, digest) of each text, and the pair codes of all links side by side."""
        split = [x.replace("\n", " \n").split(" ") if x and self.apart and not IRREGULAR.search(x) else [] for x in texts]
        pieces = list(chain.from_iterable(split))
        new = set(pieces) - self.known.keys()
        if len(self.known) + len(new) > MOST or self.bytes_known > MOST_BYTES:
            self.clear()
            new = set(pieces)
        self.learn(new)
        place = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        ends = starts([len(p) for p in split])
        out, codes = [], []
        for text, i, j in zip(texts, ends, ends[1:], strict=False):
            groups, figures = "", (0, 0, 0, 0)
            if i < j:
                at = place[i:j]
                total = self.figures[at].sum(0)
                if total[4] == j - i:
                    groups, figures = "".join([self.texts[k] for k in at.tolist()]), tuple(total[:4].tolist())
                    n = self.figures[at, 3]
                    codes.append(self.codes[np.repeat(self.begin[at] - starts(n)[:-1], n) + np.arange(figures[3])])
            elif text:
                (groups,), total, own = self.aligned([b" " + text.encode()], [self.a.encode(" " + text, add_special_tokens=False).ids], [self.b.encode(text)])
                figures = tuple(total[0, :4].tolist())
                codes.append(own)
            out.append((*figures, hashlib.sha256(groups[:-1].encode()).hexdigest() if groups else ""))
        return out, np.concatenate(codes) if codes else np.empty(0, np.int64)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_of(a_path: str | None = None, b_path: str | None = None) -> Aligner:
    """The aligner of this Python process."""
    import public_tokenizers

    from quarry.llm.common import TOKENIZER

    key = (a_path or public_tokenizers.path(TOKENIZER), b_path or public_tokenizers.path(PIECES))
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def narrow(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs; the first byte says how many."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + x.astype(kind).tobytes()


def wide(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"u{x[0]}", offset=1).astype(np.int64)


KINDS = pa.schema({"block": pa.int64(), "doc_id": pa.int64(), **{c: pa.int64() for c in ("n_a", "n_b", "n_groups", "n_links")}, "groups_sha256": pa.string(), "at": pa.binary(), "times": pa.binary(), "stripe": pa.int32(), "a": pa.binary(), "b": pa.binary(), "n": pa.binary()})


def by_stripe(codes: np.ndarray, n_b: int, stripes: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of pair codes by stripe, and the stripe of each."""
    stripe = codes // n_b % stripes
    return np.argsort(stripe, kind="stable"), stripe


def linked(docs: DataFrame, stripes: int, block: int = BLOCK, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Rows of documents with their links, as places in their block's list of pairs and how often each occurs; and rows of the blocks' pairs by stripe."""

    def run(batches):
        number = count(task_base())
        for batch in small_batches(batches, block):
            own, this = aligner_of(a_path, b_path), next(number)
            figures, codes = own.documents(batch.column("text").to_pylist())
            pairs, place = np.unique(codes, return_inverse=True)
            row = np.repeat(np.arange(len(figures)), [x[3] for x in figures])
            # A document's different pairs with how often it has them.
            both, times = np.unique(row * max(1, len(pairs)) + place, return_counts=True)
            row, place = both // max(1, len(pairs)), both % max(1, len(pairs))
            ends = np.searchsorted(row, np.arange(len(figures) + 1))
            doc = [[this] * len(figures), batch.column("doc_id").cast(pa.int64()).to_pylist(), *[[x[k] for x in figures] for k in range(5)], *[[narrow(x[i:j]) for i, j in zip(ends, ends[1:], strict=False)] for x in (place, times)]]
            yield pa.RecordBatch.from_arrays([*[pa.array(x, f.type) for x, f in zip(doc, KINDS, strict=False)], *[pa.nulls(len(figures), f.type) for f in list(KINDS)[9:]]], schema=KINDS)
            held = np.bincount(place, minlength=len(pairs))
            order, stripe = by_stripe(pairs, own.n_b, stripes)
            ends = np.searchsorted(stripe[order], np.arange(stripes + 1))
            some = [(s, order[i:j]) for s, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if i < j]
            columns = [[narrow(x[o]) for _, o in some] for x in (pairs // own.n_b, pairs % own.n_b, held)]
            yield pa.RecordBatch.from_arrays([pa.array([this] * len(some), pa.int64()), *[pa.nulls(len(some), f.type) for f in list(KINDS)[1:9]], pa.array([s for s, _ in some], pa.int32()), *[pa.array(x, pa.binary()) for x in columns]], schema=KINDS)

    return docs.select("doc_id", "text").mapInArrow(run, ROWS)


def stripe_counts(rows: DataFrame, keys: list[str], stripes: int, n_a: int, n_b: int) -> DataFrame:
    """Pairs of the groups of these keys, of which the first is the stripe, added up in a dense block each; rows stream in, so a task holds one block and no group."""

    def run(batches):
        held, matrix = None, np.zeros((-(-n_a // stripes), n_b), np.int64)

        def finished():
            a, b = np.nonzero(matrix)
            n = matrix[a, b]
            matrix[a] = 0
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), *[pa.array([narrow(x)], pa.binary()) for x in (a * stripes + held[0], b, n)]], names=["stripe", "a", "b", "n"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            for key, a, b, n in zip(zip(*columns, strict=True), *[batch.column(c) for c in "abn"], strict=True):
                if held is not None and key != held:
                    yield from finished()
                held = key
                np.add.at(matrix, (wide(a.as_py()) // stripes, wide(b.as_py())), wide(n.as_py()))
        if held is not None:
            yield from finished()

    return rows.select(*keys, "a", "b", "n").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, SUMS)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, wide_stripe: int = WIDE, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    own = aligner_of(a_path, b_path)
    n_a, n_b = len(own.a_bytes), own.n_b
    stripes = -(-n_a // wide_stripe)
    rows = written(linked(docs, stripes, block, a_path, b_path), "links", "zstd")
    pairs = rows.where("stripe is not null").select("block", "stripe", "a", "b", "n")
    documents = rows.where("stripe is null").drop("stripe", "a", "b", "n")
    shares = max(1, -(-rows.where("stripe is null").select("block").distinct().count() // share))
    pairs = pairs.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int"))
    sums = pairs if shares == 1 else stripe_counts(pairs, ["stripe", "share"], stripes, n_a, n_b)
    sums = written(stripe_counts(sums, ["stripe"], stripes, n_a, n_b), "pair-counts")

    def scored(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        matrix = np.zeros((-(-n_a // stripes), n_b), np.int64)
        for r in right.to_pylist():
            matrix[wide(r["a"]) // stripes, wide(r["b"])] = wide(r["n"])
        best = matrix.max(axis=1)
        counts, first = [], []
        for r in left.select(["a", "b"]).to_pylist():
            a, b = wide(r["a"]) // stripes, wide(r["b"])
            counts.append(narrow(matrix[a, b]))
            first.append(np.packbits(matrix[a, b] == best[a]).tobytes())
        return pa.table({"of": left["block"].cast(pa.int64()), "stripe": left["stripe"].cast(pa.int32()), "a": left["a"].cast(pa.binary()), "b": left["b"].cast(pa.binary()), "counts": pa.array(counts, pa.binary()), "best": pa.array(first, pa.binary())})

    each = sums.select(F.col("stripe").alias("s"), "a", "b", "n", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("t"))
    answers = pairs.groupBy("stripe", "share").cogroup(each.groupBy("s", "t")).applyInArrow(scored, "of long, stripe int, a binary, b binary, counts binary, best binary")

    def summed(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        codes, counts, best = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
        for r in right.to_pylist():
            codes.append(wide(r["a"]) * n_b + wide(r["b"]))
            counts.append(wide(r["counts"]))
            best.append(np.unpackbits(np.frombuffer(r["best"], np.uint8), count=len(counts[-1])).astype(bool))
        order = np.argsort(np.concatenate(codes))
        counts, best = np.concatenate(counts)[order], np.concatenate(best)[order]
        n_best, total = [], []
        for at, times in zip(left["at"].to_pylist(), left["times"].to_pylist(), strict=True):
            at, times = wide(at), wide(times)
            total.append(int(times @ counts[at]))
            n_best.append(int(times @ best[at]))
        return pa.table({**{c: left[c].cast(pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": left["groups_sha256"].cast(pa.string())})

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(summed, out)
