"""Byte-level BPE ids for counting and output: ranks of a public vocabulary file, encoded in bulk."""

from __future__ import annotations

import base64

RANKS = "byte_bpe_50k.tiktoken"
#: The vocabulary leaves this id free; it ends a document.
END = 50256

_MADE: dict = {}


def encoding(path: str | None = None, pattern: str | None = None):
    """The encoding of this Python process.  Special tokens have no meaning here: their strings are text."""
    key = (path, pattern)
    if key not in _MADE:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(RANKS), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _MADE[key] = tiktoken.Encoding("own", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _MADE[key]
