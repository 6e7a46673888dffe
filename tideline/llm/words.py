"""Words and word shingles as 64-bit codes, for use inside tasks.

A word is a run of characters other than space and U+0009 to U+000D. In UTF-8
these bytes occur in no longer sequence, and they are the ones ``bytes.split()``
splits at. Null texts have no words.
"""

from __future__ import annotations

import numpy as np
import xxhash


def codes_of(words: list[bytes]) -> np.ndarray:
    """The same 64-bit code for a word everywhere."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text; with ``lower``, A-Z only are lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A pseudo-random permutation of 64-bit codes for each seed."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(codes: np.ndarray, width: int) -> np.ndarray:
    """A code for every ``width`` consecutive words; empty if there are fewer.

    Codes of 1, 2, 4, ... words are joined to those that ``width`` is the sum of.
    """
    n = len(codes) - width + 1
    if n <= 0:
        return codes[:0]
    out, done, part, span = None, 0, codes, 1
    while span <= width:
        if width & span:
            here = part[done : done + n]
            out = here if out is None else mixed(out, -span) + here
            done += span
        if 2 * span <= width:
            part = mixed(part[:-span], span + 1) + part[span:]
        span *= 2
    return mixed(out)


def shingle_set(codes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; with fewer words than ``width``, the whole sequence as one."""
    if 0 < len(codes) < width:
        return windows(codes, len(codes))
    return np.unique(windows(codes, width))
