"""Fuzzy keys for 64-bit fingerprints from the binary Golay code [23, 12, 7].

The code is perfect: each 23-bit word has exactly one codeword within three
bits.  A fingerprint is cut into segments: 21, 21 and 22 bits for a radius of three
bits, four of 16 for a radius of five.  If two fingerprints differ in at most that many
bits, some two segments differ in at most one bit each: else all but one would differ
in two at least, which makes 4 of three segments and 6 of four.

A segment's keys are the indices (12 bits) of the codewords that its own value and all
values one bit away decode to: one key if the value is within two bits of its codeword,
else about six.  The index that a segment itself decodes to is then among the keys of
every segment one bit away, so a key made of two segments' indices (24 bits and the
pair's number) is common to any two fingerprints that must be compared.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: a generator polynomial of the code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101
#: By radius: start and width of the segments.
SEGMENTS = {3: ((0, 21), (21, 21), (42, 22)), 5: ((0, 16), (16, 16), (32, 16), (48, 16))}


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders by message (4096), and error patterns by remainder (2048)."""
    rem = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        rem = np.where(rem >> bit & 1, rem ^ (GENERATOR << (bit - 11)), rem)
    errors = np.zeros(1 << 11, dtype=np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            word = sum(1 << p for p in places)
            errors[rem[word >> 11] ^ (word & 0x7FF)] = word
    return rem, errors


def index(words: np.ndarray) -> np.ndarray:
    """The index of the codeword nearest to each 23-bit word."""
    rem, errors = tables()
    return (words ^ errors[rem[words >> 11] ^ (words & 0x7FF)]) >> 11


def segment_keys(fingerprints: np.ndarray, start: int, width: int) -> np.ndarray:
    """(n, width + 1) codeword indices, sorted by row, repeats set to -1."""
    value = (fingerprints.view(np.uint64) >> np.uint64(start)).astype(np.int64) & ((1 << width) - 1)
    found = np.sort(index(value[:, None] ^ np.array([0, *(1 << i for i in range(width))])[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def fuzzy_keys(fingerprints: np.ndarray, radius: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs of int64 fingerprints; rows within `radius` bits share a key."""
    each = [segment_keys(fingerprints, *s) for s in SEGMENTS[radius]]
    rows, keys = [], []
    for number, (i, j) in enumerate(combinations(range(len(each)), 2)):
        ri, ci = np.nonzero(each[i] >= 0)
        rj, cj = np.nonzero(each[j] >= 0)
        ki, kj = each[i][ri, ci], each[j][rj, cj]
        count = np.bincount(rj, minlength=len(fingerprints))
        first = np.concatenate(([0], np.cumsum(count)[:-1]))
        times = count[ri]
        left = np.repeat(np.arange(len(ri)), times)
        step = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        right = first[ri[left]] + step
        rows.append(ri[left])
        keys.append(number << 24 | ki[left] << 12 | kj[right])
    return np.concatenate(rows), np.concatenate(keys)
