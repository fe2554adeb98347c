"""The perfect binary Golay code of length 23: decoding, and keys that nearby words share."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
#: The generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def syndrome(words: np.ndarray) -> np.ndarray:
    """The remainder by the generator polynomial."""
    rest = words.astype(np.int64)
    for shift in range(LENGTH - 1, CHECK - 1, -1):
        rest = np.where(rest >> shift & 1, rest ^ (GENERATOR << (shift - CHECK)), rest)
    return rest


@cache
def errors() -> np.ndarray:
    """For each of the 2,048 remainders the only error of three bits or fewer that has it."""
    patterns = np.array([sum(1 << i for i in bits) for n in range(4) for bits in combinations(range(LENGTH), n)])
    table = np.zeros(1 << CHECK, dtype=np.int64)
    table[syndrome(patterns)] = patterns
    return table


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword that lies within three bits of each word."""
    return (words ^ errors()[syndrome(words)]) >> CHECK


def shared_keys(words: np.ndarray) -> np.ndarray:
    """A row of 24 codeword indices for each word, sorted, with -1 where an index repeats.

    They belong to the word and to its 23 neighbours at one bit. Two words that differ in two bits or fewer have a common
    word within one bit of both, so that they share an index. There are one or six different indices.
    """
    near = np.concatenate([[0], 1 << np.arange(LENGTH, dtype=np.int64)])
    found = np.sort(codeword_index(words[:, None] ^ near[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found
