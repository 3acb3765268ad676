"""A sieve of fixed size that keeps rows out of a shuffle when their key cannot match."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a sieve: 2 MB to broadcast, however many keys it holds. A full one lets every row pass.
BITS = 1 << 24


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).to_numpy().astype(np.int32).tobytes()], pa.binary())], ["at"])


class Sieve:
    """One bit per bucket of the keys' hashes: passes every row whose key is among them, and few others."""

    def __init__(self, keys: DataFrame, *columns: str) -> None:
        at = keys.select(F.pmod(F.xxhash64(*columns), F.lit(BITS)).alias("at")).distinct()
        bits = np.zeros(BITS, bool)
        for row in at.mapInArrow(_pack, "at binary").toLocalIterator():
            bits[np.frombuffer(row["at"], np.int32)] = True
        self.bits = keys.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def passes(self, *columns: str) -> Column:
        bits = self.bits

        @F.pandas_udf("boolean")
        def run(hashes: pd.Series) -> pd.Series:
            at = hashes.to_numpy()
            return pd.Series((bits.value[at >> 3] >> (7 - (at & 7))) & 1 == 1)

        return run(F.pmod(F.xxhash64(*columns), F.lit(BITS)))
