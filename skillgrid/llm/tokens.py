"""Token counts with public byte-pair vocabularies (rank files; the path is a parameter)."""

from __future__ import annotations

import base64
from dataclasses import dataclass
from functools import lru_cache

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary and what is done to a text first; ``version`` names the pair in every table."""

    version: str
    ranks: str = RANKS
    collapse_space: bool = False

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return len(encoding(self.ranks).encode_ordinary(" ".join(text.split()) if self.collapse_space else text))


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoder of a rank file, loaded once per worker process."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
