"""Word n-gram hashes and bounded bit tables that sift n-grams before an exact step."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)
SHIFT = np.uint64(29)
#: A bit table never has more than 2 ** MOST_BITS bits (64 MB).
MOST_BITS = 29


class WordHashes(dict):
    """Hashes of words by their bytes; forgets all of them beyond `limit` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 5)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(codes: np.ndarray) -> np.ndarray:
    codes = (codes ^ (codes >> SHIFT)) * MIX
    return codes ^ (codes >> SHIFT)


def gram_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the `length` words from every place on; empty where there are too few."""
    places = len(words) - length + 1
    if places < 1:
        return np.zeros(0, np.uint64)
    code = np.zeros(places, np.uint64)
    for i in range(length):
        code = mixed(code ^ words[i:i + places])
    return code


def lowest(codes: np.ndarray, span: int) -> np.ndarray:
    """The smallest of every `span` neighbours, by doubling."""
    have = 1
    while have < span:
        step = min(have, span - have)
        codes = np.minimum(codes[:len(codes) - step], codes[step:])
        have += step
    return codes


def _probes(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    far = np.uint64(64 - bits)
    return codes >> far, (codes * MIX) >> far


def may_hold(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """True for every hash put into `table`, and for a few others."""
    bits = len(table).bit_length() + 5
    found = np.ones(len(codes), bool)
    for place in _probes(codes, bits):
        found &= (table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return found


class Sieve:
    """`mixed` and `may_hold` for one hash at a time, on plain numbers."""

    def __init__(self, table: np.ndarray):
        self.far, self.table = 64 - (len(table).bit_length() + 5), memoryview(table)

    @staticmethod
    def mixed(code: int) -> int:
        code = ((code ^ (code >> 29)) * int(MIX)) & 0xFFFFFFFFFFFFFFFF
        return code ^ (code >> 29)

    def may_hold(self, code: int) -> bool:
        for place in (code >> self.far, ((code * int(MIX)) & 0xFFFFFFFFFFFFFFFF) >> self.far):
            if not self.table[place >> 6] >> (place & 63) & 1:
                return False
        return True


def bit_table(hashes: DataFrame, column: str) -> np.ndarray:
    """Bits of all `column` values (long) of `hashes`, 32 or more a value.

    Beyond 2 ** MOST_BITS bits the table fills up and sifts less; it never misses a value, so the
    exact step behind it sees more rows then, and the result stays the same.
    """
    bits = min(MOST_BITS, max(16, (32 * hashes.count()).bit_length()))

    def run(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.concatenate(_probes(codes, bits))
            slot, bit = (place >> np.uint64(6)).view(np.int64), np.uint64(1) << (place & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(bit.view(np.int64))], ["slot", "bit"])

    rows = hashes.select(column).mapInArrow(run, "slot long, bit long")
    rows = rows.groupBy("slot").agg(F.expr("bit_or(bit)").alias("bit")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[rows.column("slot").to_numpy()] = rows.column("bit").to_numpy().view(np.uint64)
    return table
