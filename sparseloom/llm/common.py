"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparseloom.storage import materialize, shared_path

__all__ = ["BitFilter", "bit_filter", "hash128", "materialize", "own_exchange", "read_table", "shared_path", "sliced", "small_batches", "texts"]

#: Rows of one Arrow batch handed to Python; long texts make small batches the safer choice.
BATCH_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Keep Arrow batches small for the session that runs df, unless it asks for smaller ones."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, and of about so many bytes where several rows have them: what a worker makes of texts is bounded whatever the session's batch size."""
    for b in batches:
        step = max(1, min(rows, b.num_rows * size // max(1, b.nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def own_exchange(sums: DataFrame, *keys: str) -> DataFrame:
    """Sums by keys (64-bit numbers, never null) that are about to meet the rows they were made from.

    Spark would join them where they were summed up, all rows of a hot key in one task.
    With its keys computed anew the (small) table of sums is exchanged for the join, as
    the rows are, and adaptive execution can split a hot key.
    """
    return sums.withColumns({k: F.bitwise_not(F.bitwise_not(k)) for k in keys})


def texts(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text alone, a null text as the empty one; other columns are left behind, or packed in carried."""
    carried = (F.struct(*(docs[c].alias(c) for c in carry)).alias("carried"),) if carry else ()
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *carried)


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes; equal pairs are taken for equal values."""
    return F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)


class BitFilter:
    """A set of 64-bit hashes as bits: never misses a member, lets some others pass. Its size has a bound whatever it holds."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.shift, self.packed = np.uint64(64 - bits), packed

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> self.shift).astype(np.int64)
        return (self.packed[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) > 0


def bit_filter(hashes: DataFrame, column: str, most_bits: int = 28, least_bits: int = 12) -> BitFilter:
    """The filter of a column of evenly spread 64-bit hashes: about 16 bits for each, 2**least_bits at least and at most 2**most_bits (32 MB) in all.

    What comes to the driver are words of 64 bits, at most 2**(most_bits - 6) of them.
    Beyond the bound more hashes pass than should; the exact test follows in a join.
    """
    n = hashes.count()
    bits = min(most_bits, max(least_bits, (16 * n + 1).bit_length()))
    place = F.shiftrightunsigned(column, 64 - bits)
    word = F.shiftright(place, 6)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 AS int))")
    rows = hashes.groupBy(word.alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    packed = np.zeros(1 << (bits - 6), np.int64)
    packed[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return BitFilter(bits, packed.view(np.uint8))
