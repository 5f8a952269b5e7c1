"""A byte-level BPE tokenizer read from a rank file, once per Python worker."""

from __future__ import annotations

import base64
import functools
import hashlib

import tiktoken

#: Where the vocabulary lies; a parameter everywhere.
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published pre-tokenisation pattern of that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@functools.lru_cache(maxsize=4)
def load(path: str = DEFAULT_RANKS) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def version(path: str = DEFAULT_RANKS) -> str:
    """A digest of the vocabulary and the pattern: another tokenizer has another."""
    with open(path, "rb") as lines:
        return hashlib.sha256(lines.read() + PATTERN.encode()).hexdigest()


def size(path: str = DEFAULT_RANKS) -> int:
    """One more than the largest id."""
    return load(path).max_token_value + 1
