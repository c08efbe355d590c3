"""Code points of many texts as one numpy array, and classes of characters."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """True at the code point of every letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def uppers() -> np.ndarray:
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), dtype=bool, count=0x110000)


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each [previous end, end)."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return np.diff(total[np.concatenate(([0], ends))])


#: Multiplier of the hash of a run of code points (odd), and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


@lru_cache(maxsize=8)
def powers(base: int, size: int) -> np.ndarray:
    """base ** 0 .. base ** (size - 1), modulo 2^64."""
    out = np.full(size, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def run_hashes(cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each run cp[start:end]: the same for the same code
    points, wherever they stand."""
    size = 1 << max(16, int(len(cp)).bit_length())
    with np.errstate(over="ignore"):
        total = np.empty(len(cp) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((cp + np.uint64(1)) * powers(BASE, size)[:len(cp)], dtype=np.uint64, out=total[1:])  # 0 counts too
        return (total[end] - total[start]) * powers(INVERSE, size)[start]
