"""Counting and cutting tokens for prompts, on the driver.

A vocabulary file of ranks (base64 token and rank per line) can be given by its path; without one a
deterministic approximation counts each Han character and each run of four other word characters.
"""

from __future__ import annotations

import base64
import re

_PIECE = re.compile(r"[㐀-鿿豈-﫿]|[^\W㐀-鿿豈-﫿]{1,4}|[^\w\s]|\n")
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter:
    def __init__(self, vocabulary: str | None = None):
        self._encoding = None
        if vocabulary:
            import tiktoken

            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._encoding = tiktoken.Encoding("given", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return len(self._encoding.encode_ordinary(text)) if self._encoding else sum(1 for _ in _PIECE.finditer(text))

    def cut(self, text: str, most: int) -> str:
        """The longest beginning of at most ``most`` tokens."""
        if self._encoding:
            ids = self._encoding.encode_ordinary(text)
            return text if len(ids) <= most else self._encoding.decode(ids[:most])
        for i, m in enumerate(_PIECE.finditer(text)):
            if i == most:
                return text[: m.start()]
        return text
