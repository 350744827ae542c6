"""Variable-length integers, seven bits a byte, least significant first; vectorised.

Rising keys of one size are kept as steps whose low bytes stand as they are, since only their
high part varies in length.
"""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of unsigned values, and how many each takes."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    rest = v >> np.uint64(7)
    while rest.any():
        size += rest > 0
        rest >>= np.uint64(7)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        more = size > k
        byte = (v[more] >> np.uint64(7 * k)) & np.uint64(127)
        out[at[more] + k] = byte | np.where(size[more] > k + 1, 128, 0).astype(np.uint64)
    return out, size


def decode(data: bytes | np.ndarray) -> np.ndarray:
    """All values of encoded bytes as uint64."""
    b = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, memoryview)) else data
    last = np.flatnonzero(b < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    size, out = last - first + 1, np.zeros(len(last), np.uint64)
    for k in range(int(size.max(initial=0))):
        more = size > k
        out[more] |= (b[first[more] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    return out


def encode_low(values: np.ndarray, low: int) -> np.ndarray:
    """The `low` low bytes of each value, one row a value."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low]


def decode_low(data: bytes, low: int) -> np.ndarray:
    wide = np.zeros((len(data) // low, 8), np.uint8)
    wide[:, :low] = np.frombuffer(data, np.uint8).reshape(-1, low)
    return wide.view("<u8").ravel()
