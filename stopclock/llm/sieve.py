"""A fixed-size membership filter that tasks apply before a shuffle; a join after it makes the result exact."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stopclock.llm.words import mixed

#: 2**24 bits, 2 MB however many keys there are: with too many keys it lets more rows pass, never fewer.
BITS = 24


def sieve_of(keys: DataFrame, column: str) -> np.ndarray:
    """Bytes of the filter over a column of longs."""
    schema = "word int, bits long"

    def slots(batches):
        import pyarrow as pa

        for batch in batches:
            slot = np.unique(_slot(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)))
            word = (slot >> np.uint64(6)).astype(np.int32)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            bit = np.uint64(1) << (slot & np.uint64(63))
            bits = np.bitwise_or.reduceat(bit, first) if len(bit) else bit
            yield pa.RecordBatch.from_arrays([pa.array(word[first]), pa.array(bits.view(np.int64))], ["word", "bits"])

    words = keys.select(column).where(f"{column} is not null").mapInArrow(slots, schema).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for word, bits in words.collect():  # at most 2**18 rows
        out[word] = np.uint64(bits & (2**64 - 1))
    return out


def _slot(keys: np.ndarray) -> np.ndarray:
    return mixed(keys + np.uint64(0x51ED270B)) >> np.uint64(64 - BITS)


def passing(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    slot = _slot(keys.view(np.uint64))
    return (sieve[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
