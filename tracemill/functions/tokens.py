"""Token counters for operators that take one: lists of texts to lists of counts."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

Count = Callable[[list[str]], list[int]]


def words(texts: list[str]) -> list[int]:
    """The default: words and single marks."""
    return [len(re.findall(r"\w+|[^\w\s]", t)) for t in texts]


@lru_cache(maxsize=4)
def _loaded(path: str):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def subwords(path: str) -> Count:
    """A counter by the tokenizer of a JSON file, which every worker reads once; the path must be readable there."""

    def count(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in _loaded(path).encode_batch(list(texts), add_special_tokens=False)]

    return count
