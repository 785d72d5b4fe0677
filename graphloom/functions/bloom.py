"""A bloom filter over symbol names, built by Spark and probed anywhere.

Positions are h1 + i * h2 with two XXH64 values; set bits are combined per
64-bit word with `bit_or`, so what reaches the driver is the filter itself.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.01


def shape(symbols: int, rate: float = RATE) -> tuple[int, int]:
    """Bits and hash functions for names and qualified names of so many symbols."""
    n = max(2 * symbols, 64)
    m = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    return m, min(max(math.ceil(m / n * math.log(2)), 2), 16)


def _hashes(text: str) -> tuple[int, int]:
    data = text.encode()
    h1 = xxhash.xxh64_intdigest(data, 42)
    return h1, xxhash.xxh64_intdigest(data + b"#", 42) | 1


@dataclass
class Bloom:
    m: int
    k: int
    bits: bytearray

    @classmethod
    def empty(cls, symbols: int) -> Bloom:
        m, k = shape(symbols)
        return cls(m, k, bytearray(-(-m // 64) * 8))

    def positions(self, text: str) -> list[int]:
        h1, h2 = _hashes(text)
        h1, h2 = h1 % self.m, h2 % self.m
        return [(h1 + i * h2) % self.m for i in range(self.k)]

    def add(self, text: str) -> None:
        for p in self.positions(text):
            self.bits[p >> 3] |= 1 << (p & 7)

    def __contains__(self, text: str) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self.positions(text))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQQ", self.k, self.m, len(self.bits)) + bytes(self.bits)

    @classmethod
    def from_bytes(cls, data: bytes) -> Bloom | None:
        """None if the bytes are too few: callers then take every name for possible."""
        if len(data) < 24:
            return None
        k, m, size = struct.unpack_from("<QQQ", data)
        if len(data) < 24 + size:
            return None
        return cls(m, k, bytearray(data[24 : 24 + size]))


def build_bloom(symbols: DataFrame) -> Bloom:
    """The filter of all names and qualified names."""
    n = symbols.count()
    bloom = Bloom.empty(n)
    m = F.lit(bloom.m)
    unsigned = lambda h: ((F.shiftrightunsigned(h, 1) % m) * 2 + h.bitwiseAND(F.lit(1))) % m
    names = symbols.select(F.explode(F.array("name", "qualified_name")).alias("s")).distinct()
    h2 = F.xxhash64(F.concat("s", F.lit("#"))).bitwiseOR(F.lit(1))
    hashed = names.select(unsigned(F.xxhash64("s")).alias("a"), unsigned(h2).alias("b"))
    places = hashed.select(F.explode(F.array(*[(F.col("a") + F.lit(i) * F.col("b")) % m for i in range(bloom.k)])).alias("p"))
    words = places.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    for r in words.toLocalIterator():
        struct.pack_into("<q", bloom.bits, r.w * 8, r.bits)
    return bloom
