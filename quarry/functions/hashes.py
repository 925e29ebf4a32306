"""Hashes and seeded draws that must come out bit by bit, in Python on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

_MASK32, _MASK64 = 2**32 - 1, 2**64 - 1


def fnv1a64(data: bytes, seed: int = 0xCBF29CE484222325) -> int:
    for byte in data:
        seed = (seed ^ byte) * 0x100000001B3 & _MASK64
    return seed


def fnv1a32(text: str) -> int:
    """Over UTF-16 code units."""
    out = 0x811C9DC5
    units = text.encode("utf-16-le")
    for low, high in zip(units[::2], units[1::2], strict=True):
        out = (out ^ (low | high << 8)) * 0x01000193 & _MASK32
    return out


def cache_key(stubs: Iterable[str], revision: int) -> str:
    """The key under which an index of a package stays valid: output revision and stub roots."""
    return f"i{revision}+{fnv1a64('\n'.join(sorted(set(stubs))).encode()):x}"


def mulberry32(seed: int) -> Callable[[], float]:
    """A generator of numbers in [0, 1) from a 32-bit state."""
    state = seed & _MASK32

    def draw() -> float:
        nonlocal state
        state = (state + 0x6D2B79F5) & _MASK32
        x = (state ^ state >> 15) * (state | 1) & _MASK32
        x ^= (x + ((x ^ x >> 7) * (x | 61) & _MASK32)) & _MASK32
        return ((x ^ x >> 14) & _MASK32) / 2**32

    return draw


def shuffled[T](items: Sequence[T], seed: str) -> list[T]:
    """Fisher-Yates from the end, by draws seeded with a text."""
    out, draw = list(items), mulberry32(fnv1a32(seed))
    for last in range(len(out) - 1, 0, -1):
        pick = int(draw() * (last + 1))
        out[last], out[pick] = out[pick], out[last]
    return out
