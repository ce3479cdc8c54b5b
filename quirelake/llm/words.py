"""Hashes of the words of texts, in numpy over bytes: no object for each word."""

from __future__ import annotations

import numpy as np

_TABLE = np.random.default_rng(77).integers(1, 2**63, 256, dtype="u8") | np.uint64(1)
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that part words: white space; or all ASCII but letters and digits.
WHITE_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
NOT_LETTERS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, ODD, "u8")
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype="u8")


POWERS = _powers(4096)


def word_hashes(raw: np.ndarray, separators: np.ndarray = NOT_LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of the first byte) of each word of the bytes."""
    inside = ~separators[raw]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edge = np.concatenate([[0], edge])
    if len(edge) % 2:
        edge = np.concatenate([edge, [len(raw)]])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.array([], "u8"), starts
    place = np.arange(len(raw), dtype="i4")
    place -= np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(raw)]]))).astype("i4")
    with np.errstate(over="ignore"):
        letters = _TABLE[raw]
        letters *= POWERS[place & 4095]
        letters[~inside] = 0
        h = np.add.reduceat(letters, starts) + (ends - starts).astype("u8") * ODD
    return mixed(h), starts
