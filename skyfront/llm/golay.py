"""The binary Golay code (23, 12): tables made by rule, and fuzzy keys of 23-bit words.

Every 23-bit word lies within 3 bits of exactly one codeword. Two words that differ in at
most one bit always share a key when a word's keys are its nearest codeword and, if that is
3 bits away, also the five codewords at 4 bits: one flipped bit either keeps the nearest
codeword or moves the word from 3 to 4 bits away from it.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
BITS, CHECK = 23, 11


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the upper 12 bits; leader of each coset; leaders' 5 companions of weight 4 (0: none)."""
    power = []
    x = 1
    for _ in range(BITS):
        power.append(x)
        x <<= 1
        if x >> CHECK & 1:
            x ^= GENERATOR
    upper = np.zeros(1 << 12, np.int32)
    for i in range(12):
        upper ^= np.where(np.arange(1 << 12) >> i & 1, power[CHECK + i], 0).astype(np.int32)
    leader, companions = np.zeros(1 << CHECK, np.int32), np.zeros((1 << CHECK, 5), np.int32)
    filled = np.zeros(1 << CHECK, np.int64)
    for weight in range(1, 5):
        for places in combinations(range(BITS), weight):
            s = 0
            for p in places:
                s ^= power[p]
            word = sum(1 << p for p in places)
            if weight < 4:
                leader[s] = word
            elif int(leader[s]).bit_count() == 3:
                companions[s, filled[s]] = word
                filled[s] += 1
    return upper, leader, companions


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit word six codeword indices (12 bits) and which of them count."""
    upper, leader, companions = tables()
    words = words.astype(np.int32)
    s = upper[words >> CHECK] ^ (words & ((1 << CHECK) - 1))
    keys = np.empty((len(words), 6), np.int64)
    keys[:, 0] = (words ^ leader[s]) >> CHECK
    keys[:, 1:] = (words[:, None] ^ companions[s]) >> CHECK
    use = np.ones((len(words), 6), bool)
    use[:, 1:] = companions[s] != 0
    return keys, use
