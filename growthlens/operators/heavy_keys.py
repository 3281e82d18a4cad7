"""Per-key results where a few keys hold most rows: dense accumulators over equal splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.session import ship

#: Stand-ins for "no time seen" in the accumulators.
NEVER, ALWAYS = np.iinfo(np.int64).max, np.iinfo(np.int64).min

#: Blocks of arrays: at least, and for each partition that the session shuffles into.
LEAST_BLOCKS, BLOCKS_A_PARTITION = 256, 4


def scattered(codes: np.ndarray, size: int, n: np.ndarray | None, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums (n None: one each), least and greatest by code, in dense arrays."""
    counts = np.bincount(codes, minlength=size).astype(np.int64) if n is None else np.zeros(size, np.int64)
    if n is not None:
        np.add.at(counts, codes, n)
    least, most = np.full(size, NEVER), np.full(size, ALWAYS)
    np.minimum.at(least, codes, low)
    np.maximum.at(most, codes, high)
    return counts, least, most


class Accumulators:
    """Counts, least and greatest moment of each key of one dictionary, in dense arrays.

    Batches are reduced to arrays of their own and put together only when they hold as many keys as
    the whole, so a key is hashed a few times, not once per batch.
    """

    def __init__(self, least: int = 65_536) -> None:
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []
        self.whole, self.waiting, self.least = 0, 0, least

    def add(self, keys: pa.Array, n: np.ndarray | None, low: np.ndarray, high: np.ndarray) -> None:
        """Take in rows (n None: one each)."""
        self.parts.append(self.reduced(keys, n, low, high))
        self.waiting += len(self.parts[-1][0])
        if self.waiting > max(self.least, self.whole):
            self.merge()

    @staticmethod
    def reduced(keys: pa.Array, n: np.ndarray | None, low: np.ndarray, high: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        encoded = keys.dictionary_encode(null_encoding="encode")
        return encoded.dictionary, *scattered(encoded.indices.to_numpy(zero_copy_only=False), len(encoded.dictionary), n, low, high)

    def merge(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, counts, least and greatest of all rows so far."""
        if len(self.parts) > 1:
            self.parts = [self.reduced(pa.concat_arrays([p[0] for p in self.parts]), *(np.concatenate([p[k] for p in self.parts]) for k in (1, 2, 3)))]
        self.whole, self.waiting = len(self.parts[0][0]) if self.parts else 0, 0
        return self.parts[0] if self.parts else (pa.array([], pa.string()), *(np.zeros(0, np.int64) for _ in range(3)))


def key_totals(df: DataFrame, key_fields: list[str], moment: str | None = None, blocks: int | None = None, most_keys: int = 1_000_000) -> DataFrame:
    """Rows, first and last moment of every value of each of several key columns.

    Returns key_field (the column's name), key_value (the value as a string; null is a value),
    n_rows, first_at and last_at (null where no moment is known or ``moment`` is None). Each column's
    n_rows add up to the table's rows. An empty table gives no rows; other columns are ignored.

    Every input split encodes its keys in a dictionary of its own and counts by bincount and scatter
    into dense arrays, so a key with a third of all rows costs no more than any other rows. The
    arrays are cut into blocks by the key's hash and shuffled as such; per block they are summed
    into one dense array. A split that meets over ``most_keys`` keys hands over its arrays and starts anew.

    Scale: what is shuffled are a split's distinct keys, at most; nothing is broadcast or collected. A
    block's arrays are summed as they stream in, so a task holds the block's distinct keys only. There
    are BLOCKS_A_PARTITION ``blocks`` for each of the session's shuffle partitions, and at least LEAST_BLOCKS; no row
    depends on their number.
    """
    if blocks is None:
        blocks = max(LEAST_BLOCKS, BLOCKS_A_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(
        *(F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(key_fields)),
        (F.unix_micros(F.col(moment).cast("timestamp")) if moment else F.lit(None).cast("long")).alias("at"),
    )
    schema = "field int, block int, keys array<string>, n array<bigint>, low array<bigint>, high array<bigint>"

    def handed(field: int, acc: Accumulators) -> Iterator[pa.RecordBatch]:
        own, *sums = acc.merge()
        hashes = pd.util.hash_array(own.fill_null("").to_numpy(zero_copy_only=False), categorize=False)
        block = (hashes % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0]) if len(order) else np.zeros(0, int)
        offsets = pa.array(np.r_[cuts, len(order)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (own.take(pa.array(order)), *(pa.array(a[order]) for a in sums))]
        if len(cuts):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), field, np.int32)), pa.array(block[order][cuts]), *lists], names=["field", "block", "keys", "n", "low", "high"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Accumulators() for _ in key_fields]
        for batch in batches:
            at = batch.column("at")
            low = at.fill_null(int(NEVER)).to_numpy(zero_copy_only=False)
            high = at.fill_null(int(ALWAYS)).to_numpy(zero_copy_only=False)
            for i, acc in enumerate(own):
                keys = batch.column(f"k{i}")
                acc.add(keys, None, low, high)
                if acc.whole + acc.waiting > most_keys and len(acc.merge()[0]) > most_keys:
                    yield from handed(i, acc)
                    own[i] = Accumulators()
        for i, acc in enumerate(own):
            yield from handed(i, acc)

    def total(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, field = Accumulators(), 0
        for part in parts:
            field = part.column("field")[0].as_py()
            acc.add(part.column("keys").flatten(), *(part.column(c).flatten().to_numpy() for c in ("n", "low", "high")))
        known = lambda a, none: pa.array(a, mask=a == none)
        keys, n, low, high = acc.merge()
        fields = pa.array(np.full(len(keys), field, np.int32))
        yield pa.RecordBatch.from_arrays([fields, keys, pa.array(n), known(low, NEVER), known(high, ALWAYS)], names=["field", "key_value", "n_rows", "low", "high"])

    ship(df.sparkSession)
    totals = rows.mapInArrow(count, schema).groupBy("field", "block").applyInArrow(total, "field int, key_value string, n_rows bigint, low bigint, high bigint")
    name = F.element_at(F.array(*map(F.lit, key_fields)), F.col("field") + 1)
    return totals.select(name.alias("key_field"), "key_value", "n_rows", F.timestamp_micros("low").alias("first_at"), F.timestamp_micros("high").alias("last_at"))
