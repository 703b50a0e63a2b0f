"""Code points of many texts at once, with tables of their classes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every code point: lower case (itself where that is several characters), is a letter, is a letter or digit."""
    lower, alpha, alnum = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalnum():
            alnum[i], alpha[i], x = True, c.isalpha(), c.lower()
            if x != c and len(x) == 1:
                lower[i] = ord(x)
    return lower, alpha, alnum


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and each text's offset (one more than texts)."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), off
