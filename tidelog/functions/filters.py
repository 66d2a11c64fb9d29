"""Filter policies: how runs say that they can't have a key. They save reads and never change a result."""

from __future__ import annotations

import hashlib
import math
from abc import ABC, abstractmethod


class FilterPolicy(ABC):
    name: str

    @abstractmethod
    def writer_options(self, column: str) -> dict[str, str]:
        """Options for the Parquet writer."""

    @abstractmethod
    def create(self, keys: list[bytes]) -> bytes:
        """A filter of these keys."""

    @abstractmethod
    def may_match(self, key: bytes, made: bytes) -> bool:
        """False only for keys that the filter was not made from."""


class BloomPolicy(FilterPolicy):
    """Parquet's own Bloom filters on the key, and a plain Bloom filter for keys in memory."""

    name = "bloom"

    def __init__(self, bits_per_key: int = 10, expected_keys: int = 1_000_000):
        self.bits_per_key, self.expected_keys = max(1, bits_per_key), expected_keys
        self.probes = min(30, max(1, round(self.bits_per_key * math.log(2))))

    @property
    def false_positive_rate(self) -> float:
        return (1 - math.exp(-self.probes / self.bits_per_key)) ** self.probes

    def writer_options(self, column: str) -> dict[str, str]:
        return {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.expected.ndv#{column}": str(self.expected_keys), f"parquet.bloom.filter.fpp#{column}": f"{self.false_positive_rate:.6f}"}

    def _bits(self, key: bytes, size: int):
        h = hashlib.blake2b(key, digest_size=16).digest()
        a, b = int.from_bytes(h[:8], "little"), int.from_bytes(h[8:], "little") | 1
        return ((a + i * b) % size for i in range(self.probes))

    def create(self, keys: list[bytes]) -> bytes:
        size = max(64, len(keys) * self.bits_per_key)
        size += -size % 8
        bits = bytearray(size // 8)
        for key in keys:
            for i in self._bits(key, size):
                bits[i >> 3] |= 1 << (i & 7)
        return bytes(bits)

    def may_match(self, key: bytes, made: bytes) -> bool:
        return bool(made) and all(made[i >> 3] >> (i & 7) & 1 for i in self._bits(key, 8 * len(made)))
