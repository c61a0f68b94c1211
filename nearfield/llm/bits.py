"""A Bloom filter in segments. A key belongs to one segment by its top bits, so each task builds whole segments from the keys shuffled to it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

SEGMENTS = 4096
_TOP = np.uint64(52)
PROBES = 2


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment(keys: np.ndarray) -> np.ndarray:
    return (keys >> _TOP).astype(np.int32)


def size_for(keys: int, per_key: int, most: int) -> int:
    """Bits: whole words in each segment, at least `per_key` a key, but not over `most`."""
    unit = SEGMENTS * 64
    return unit * max(1, min(-(-per_key * keys // unit), most // unit))


def places(keys: np.ndarray, level: int, probe: int, segment_bits: int) -> np.ndarray:
    """Bits of a segment, of under 2^32."""
    spread = mix(keys + np.uint64((level * PROBES + probe + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return (spread >> np.uint64(32)) * np.uint64(segment_bits) >> np.uint64(32)


class Bits:
    """All segments of a filter of so many bits, or `count` of them from `first` on."""

    def __init__(self, bits: int, first: int = 0, count: int = SEGMENTS):
        self.segment_bits, self.first = bits // SEGMENTS, first
        self.data = np.zeros(count * self.segment_bits // 8, np.uint8)

    def put(self, segment: int, data: bytes) -> None:
        size = self.segment_bits // 8
        at = (segment - self.first) * size
        self.data[at : at + size] |= np.frombuffer(data, np.uint8)

    def has(self, keys: np.ndarray, level: int = 1) -> np.ndarray:
        out = np.ones(len(keys), bool)
        base = ((keys >> _TOP) - np.uint64(self.first)) * np.uint64(self.segment_bits)
        for probe in range(PROBES):
            at = base + places(keys, level, probe, self.segment_bits)
            out &= (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """For each key the last level before the first that is missing."""
        out = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        level = 1
        while len(left) and level <= 60:
            left = left[self.has(keys[left], level)]
            out[left] = level
            level += 1
        return out

    def fill(self) -> float:
        return float(np.bitwise_count(self.data).sum()) / (8 * len(self.data))


def segments(summed: DataFrame, bits: int) -> DataFrame:
    """The filter as a table: segment, data, ones (bits that are set). summed: segment, key, levels; dealt by segment, each key in one row or several."""
    size = bits // SEGMENTS

    def run(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            number, key, top = (np.asarray(batch.column(i)) for i in range(3))
            key = key.view(np.uint64)
            local = np.unique(number)
            block = np.zeros((len(local), size // 8), np.uint8)
            row = np.searchsorted(local, number)
            for level in range(1, int(top.max(initial=0)) + 1):
                some = top >= level
                for probe in range(PROBES):
                    at = places(key[some], level, probe, size)
                    np.bitwise_or.at(block, (row[some], (at >> np.uint64(3)).astype(np.int64)), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            for s, data in zip(local.tolist(), block, strict=True):
                held[s] = held[s] | data if s in held else data.copy()
        for s, data in held.items():
            ones = int(np.bitwise_count(data).sum())
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data.tobytes()], pa.binary()), pa.array([ones], pa.int64())], names=["segment", "data", "ones"])

    return summed.select("segment", "key", "levels").mapInArrow(run, "segment int, data binary, ones long")


def build(summed: DataFrame, bits: int) -> Bits:
    """The whole filter of the same table. The driver gets the filter, never the keys."""
    own = Bits(bits)
    for r in segments(summed, bits).select("segment", "data").collect():
        own.put(r["segment"], r["data"])
    return own
