"""Token and word boundaries and hashes over whole batches of texts at once, on their UTF-8 bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd number and of its inverse, modulo 2 ** 64."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base)
            row[0] = 1
            both.append(np.cumprod(row, dtype=np.uint64))
        _powers[size] = (both[0], both[1])
    up, down = _powers[size]
    return up[:n], down[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of every span of ``values`` (uint64): equal spans hash alike wherever they stand."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mixed((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


@dataclass
class Spans:
    """Spans of bytes of several texts: where they begin and end in ``buffer``, and which text they are of."""

    buffer: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    text: np.ndarray
    firsts: np.ndarray  # of each text, in the buffer


def runs(texts: list[bytes], kinds: np.ndarray) -> Spans:
    """Longest runs of bytes of one kind (``kinds``: kind of each byte, 0 for what separates), within a text."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    kind = kinds[buffer]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = np.concatenate([[0], edge]) if len(buffer) else np.zeros(0, np.int64)
    stop = np.concatenate([edge, [len(buffer)]]) if len(buffer) else start
    held = kind[start] != 0
    start, stop = start[held], stop[held]
    firsts = np.cumsum(sizes) - sizes
    return Spans(buffer, start, stop, np.searchsorted(firsts, start, "right") - 1, firsts)
