"""Vectorised hashing of character windows over whole batches of texts."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def code_points(text: str) -> np.ndarray:
    """The code points of a string."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def text_of(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, factor in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


def windows(codes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every window of ``length`` code points (empty if there is none)."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _Powers.to(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * down[: len(codes)], dtype=np.uint64, out=sums[1:])
    return mix((sums[length:] - sums[:n]) * up[:n] + np.uint64(length))


@lru_cache(maxsize=1)
def folded_table() -> np.ndarray:
    """For every code point its letter or digit without case and width, or 0."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for lo, hi in ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x20000, 0x2EBE0), (0x30000, 0x323AF)):
        table[lo : hi + 1] = np.arange(lo, hi + 1)
    for code in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000)]:
        c = unicodedata.normalize("NFKC", chr(code)).casefold()[:1]
        if c and c.isalnum():
            table[code] = ord(c)
    return table


def folded(text: str) -> np.ndarray:
    """The letters and digits of a text, without case, width, spaces and punctuation."""
    out = folded_table()[code_points(text)]
    return out[out > 0]


def sub_batches(pdf, column: str, chars: int = 1_000_000):
    """A batch in parts of about so many characters, so that arrays over a part stay small; a longer text is a part of its own."""
    total = pdf[column].str.len().fillna(0).to_numpy(dtype="int64").cumsum()
    start = 0
    while start < len(pdf):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + chars, "right")))
        yield pdf.iloc[start:stop]
        start = stop
