"""Operator 2: edit-aware token counts over a segment tree of pre-tokens per document.

A text is cut into leaves of about ``leaf`` characters, at places where a pre-token
always begins: a space between two characters that are no white space.  A leaf has its
number of characters and of tokens; each inner node of the tree has its two children's
sums.  An edit finds the leaves that it touches from the root, takes those beside
them along where it comes near their border, encodes this region again and updates
the sums on the way up.  All else is kept.

Nulls and edge cases: a null or empty text has no tokens and one empty leaf; null
edits are none; an edit's place and length are cut to the text, a null insert is
empty; edits are in code points and are made in their order, each on the text that
the one before leaves; repeated rows give a row each; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.bytes_bpe import encoding
from quarry.llm.common import small_batches

LEAF = 256
BORDER = re.compile(r"(?<=\S) (?=\S)")
EDITS = "array<struct<at:int,remove:int,insert:string>>"


def cut(text: str, leaf: int = LEAF) -> list[str]:
    """Leaves of a text; together they are the text."""
    out, at = [], 0
    while len(text) - at > leaf:
        border = BORDER.search(text, at + leaf)
        if not border:
            break
        out.append(text[at : border.start()])
        at = border.start()
    out.append(text[at:])
    return out


class Tree:
    """Sums of characters and tokens over leaves; level 0 is the leaves, the last level the root."""

    def __init__(self, chars: list[int], tokens: list[int]):
        size = 1 << max(0, (len(chars) - 1).bit_length())
        self.levels = [np.zeros((size, 2), np.int64)]
        self.levels[0][: len(chars)] = np.stack([chars, tokens], 1)
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].reshape(-1, 2, 2).sum(1))

    @property
    def total(self) -> tuple[int, int]:
        return tuple(self.levels[-1][0].tolist())

    def find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` (the last that has any beyond the end), and where it begins."""
        at = min(at, max(0, self.total[0] - 1))
        k = begin = 0
        for level in reversed(self.levels[:-1]):
            k *= 2
            if at - begin >= level[k, 0]:
                begin += int(level[k, 0])
                k += 1
        return k, begin

    def put(self, first: int, last: int, chars: int, tokens: int) -> None:
        """Leaf ``first`` gets the figures of a region, the others up to ``last`` become empty."""
        self.levels[0][first : last + 1] = 0
        self.levels[0][first] = chars, tokens
        low, high = first, last
        for k in range(1, len(self.levels)):
            low, high = low // 2, high // 2
            self.levels[k][low : high + 1] = self.levels[k - 1][2 * low : 2 * high + 2].reshape(-1, 2, 2).sum(1)


def edit(text: str, tree: Tree, at: int, remove: int, insert: str, count) -> tuple[str, int]:
    """The edited text, and how many characters were encoded again.  Two characters on either side are looked at, so no border of the region can have changed."""
    at = max(0, min(at, len(text)))
    stop = max(at, min(at + remove, len(text)))
    first, begin = tree.find(max(0, at - 2))
    last, last_begin = tree.find(min(len(text), stop + 2))
    end = last_begin + int(tree.levels[0][last, 0])
    region = text[begin:at] + insert + text[stop:end]
    tree.put(first, last, len(region), count(region))
    return text[:at] + insert + text[stop:], len(region)


def trees(docs: DataFrame, leaf: int = LEAF, ranks: str | None = None) -> DataFrame:
    """(doc_id, text, chars, tokens): the leaves of each document's tree, as they are kept from one edit to the next."""

    def run(batches):
        for batch in small_batches(batches):
            encode, chars, tokens = encoding(ranks).encode_ordinary, [], []
            for text in batch.column("text").to_pylist():
                leaves = cut(text or "", leaf)
                chars.append([len(x) for x in leaves])
                tokens.append([len(encode(x)) for x in leaves])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("text"), *[pa.array(x, pa.list_(pa.int32())) for x in (chars, tokens)]], names=["doc_id", "text", "chars", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, chars array<int>, tokens array<int>")


def recount(kept: DataFrame, edits: Column, ranks: str | None = None) -> DataFrame:
    """Kept trees after edits: (doc_id, n_tokens, n_leaves, n_edits, n_tokens_after, n_chars_after, n_encoded_chars, n_edited text's crc)."""
    import zlib

    def run(batches):
        for batch in small_batches(batches):
            encode, out = encoding(ranks).encode_ordinary, []
            for r in batch.to_pylist():
                text, tree = r["text"] or "", Tree(r["chars"], r["tokens"])
                before, again = tree.total[1], 0
                for e in r["edits"] or ():
                    text, n = edit(text, tree, e["at"] or 0, e["remove"] or 0, e["insert"] or "", lambda x: len(encode(x)))
                    again += n
                out.append((r["doc_id"], before, len(r["chars"]), len(r["edits"] or ()), tree.total[1], len(text), again, zlib.crc32(text.encode("utf-8", "surrogatepass"))))
            names = ("doc_id", "n_tokens", "n_leaves", "n_edits", "n_tokens_after", "n_chars_after", "n_encoded_chars", "text_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return kept.select("doc_id", "text", "chars", "tokens", edits.cast(EDITS).alias("edits")).mapInArrow(run, "doc_id long, n_tokens long, n_leaves long, n_edits long, n_tokens_after long, n_chars_after long, n_encoded_chars long, text_crc32 long")


def standard_edits(text: str = "text") -> Column:
    """Three edits of every document: a heading before it, five characters redacted in its middle, and a mark after it."""
    one = lambda at, remove, insert: F.struct(at.cast("int").alias("at"), F.lit(remove).alias("remove"), F.lit(insert).alias("insert"))
    n = F.coalesce(F.length(text), F.lit(0))
    return F.array(one(F.lit(0), 0, "Document: "), one(F.floor(n / 2), 5, " [redacted] "), one(n + 20, 0, " [end]"))
