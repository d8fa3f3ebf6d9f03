"""The binary Golay code of length 23: every word lies within three bits of exactly one of its 4096 codewords."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS, CHECK_BITS = 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, which generates the code.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for i in range(BITS - 1, CHECK_BITS - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK_BITS)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of the upper twelve bits, and the error of at most three bits that each remainder stands for."""
    upper = np.array([_remainder(m << CHECK_BITS) for m in range(1 << 12)], np.int32)
    errors = np.zeros(1 << CHECK_BITS, np.int32)
    for n in (1, 2, 3):
        for places in combinations(range(BITS), n):
            e = sum(1 << p for p in places)
            errors[_remainder(e)] = e
    return upper, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The index, 0 to 4095, of the codeword nearest to each word."""
    upper, errors = _tables()
    words = words.astype(np.int32)
    rest = upper[words >> CHECK_BITS] ^ (words & ((1 << CHECK_BITS) - 1))
    return ((words ^ errors[rest]) >> CHECK_BITS).astype(np.int64)


#: A word decodes to its own codeword and, with one bit changed, to at most five others.
NEAR = 6


def nearby(words: np.ndarray, bits: int) -> np.ndarray:
    """(n, 6) indices that a word, or the word with any one of its lower ``bits`` changed, decodes to; -1 fills up.

    Two words that differ in at most one bit: the index of one is among the nearby indices of the other.
    """
    changed = words[:, None] ^ np.concatenate([[0], 1 << np.arange(bits)])[None, :]
    found = np.sort(decode(changed.ravel()).reshape(changed.shape), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = 1 << 12
    found = np.sort(found, axis=1)[:, :NEAR]
    found[found == 1 << 12] = -1
    return found
