"""Keyed permutations of [0, n) in numpy: a four-round Feistel network on an even number of bits, walked until inside."""

from __future__ import annotations

import numpy as np

ROUNDS = 4


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.SeedSequence(seed).generate_state(ROUNDS, np.uint64)]


def _network(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for k in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, k) & mask), left
        else:
            left, right = right, left ^ (_mix(right, k) & mask)
    return (left << np.uint64(half)) | right


def permuted(x: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The image of each x below n < 2^62; back: its pre-image."""
    if not 0 < n < 1 << 62:
        raise ValueError("n must be from 1 to 2^62")
    half = max(1, -(-(n - 1).bit_length() // 2)) if n > 1 else 1
    keys, out = _keys(seed), _network(x.astype(np.uint64), half, _keys(seed), back)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], half, keys, back)
    return out.astype(np.int64)
