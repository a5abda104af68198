"""Small helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repochron.session import stage

__all__ = ["bit_at", "bit_count_for", "bits_of", "in_bits", "list_of", "lower_ascii", "map_batches", "read", "stage"]

UPPER, LOWER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: largest bit table that is sent to the executors: 2**27 bits are 16 MB
MAX_BITS = 1 << 27


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(text, UPPER, LOWER_CASE)


def bit_at(position: Column) -> Column:
    """A BIGINT with one bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def bit_count_for(keys: int) -> int:
    """A power of two of about 16 bits a key, never over ``MAX_BITS``."""
    return min(MAX_BITS, max(1 << 12, 1 << (16 * max(keys, 1)).bit_length()))


def bits_of(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bit table of 64-bit hashes, built by a partial aggregation; at most ``bits / 64`` rows reach the driver.

    Every key is in it.  A key that was never put in may pass (a Bloom filter with two probes).
    """
    probes = keys.select(F.explode(F.array(F.col(column), F.shiftrightunsigned(column, 32))).alias("p")).select(F.col("p").bitwiseAND(F.lit(bits - 1)).alias("p"))
    words = probes.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(bit_at(F.col("p").bitwiseAND(F.lit(63)))).alias("v"))
    table = np.zeros(bits // 64, np.uint64)
    got = words.toArrow()
    table[got["w"].to_numpy()] = got["v"].to_numpy().view(np.uint64)
    return table


def in_bits(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which 64-bit hashes may be in a table of ``bits_of``."""
    last = np.uint64(len(table) * 64 - 1)
    found = np.ones(len(hashes), bool)
    for shift in (np.uint64(0), np.uint64(32)):
        p = (hashes >> shift) & last
        found &= (table[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def list_of(lengths: np.ndarray, values: pa.Array | np.ndarray) -> pa.ListArray:
    """An Arrow list column from the lengths and the joined values of its rows."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over single batches."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from make(batch)

    return df.mapInArrow(over, schema)
