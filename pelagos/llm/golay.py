"""The binary Golay code of length 23: 4,096 codewords, each 23-bit word within distance 3 of exactly one.

For fuzzy hashing, a word's keys are the indices of all codewords within distance 4: its own nearest
codeword and, where that is at distance 3, five more. Two words that differ in one bit always share a
key, because the nearest codeword of either is within distance 4 of the other; so do any that differ in two.
"""

from __future__ import annotations

import functools
from itertools import combinations

import numpy as np

LENGTH, CHECKS = 23, 11
# Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
NO_KEY = 0xFFFF


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder modulo the generator."""
    rest = np.array(words, np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ GENERATOR << bit - CHECKS, rest)
    return rest


@functools.cache
def _leaders() -> np.ndarray:
    """For each syndrome the error pattern of at most three bits that has it."""
    masks = [sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(LENGTH), n)]
    masks = np.array(masks, np.int64)
    out = np.zeros(1 << CHECKS, np.int64)
    out[syndrome(masks)] = masks
    return out


@functools.cache
def _codewords() -> np.ndarray:
    """By index: the top 12 bits are the index itself (the code is systematic)."""
    top = np.arange(1 << LENGTH - CHECKS, dtype=np.int64) << CHECKS
    return top | syndrome(top)


@functools.cache
def key_table(bits: int) -> np.ndarray:
    """(2**bits, 6) key indices of every ``bits``-bit word, put in front of zeros; the first is its nearest codeword, NO_KEY fills up."""
    words = np.arange(1 << bits, dtype=np.int64) << LENGTH - bits
    leaders = _leaders()[syndrome(words)]
    nearest = words ^ leaders
    out = np.full((len(words), 6), NO_KEY, np.uint16)
    out[:, 0] = nearest >> CHECKS
    light = _codewords()
    light = light[np.bitwise_count(light) == 7]
    around = {int(m): light[light & m == m] for m in np.unique(leaders[np.bitwise_count(leaders) == 3])}
    for mask, more in around.items():
        at = np.flatnonzero(leaders == mask)
        out[at, 1:] = (nearest[at, None] ^ more[None, :]) >> CHECKS
    return out
