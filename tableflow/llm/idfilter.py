"""A bit filter of row keys, for tasks that read texts.

A semi join of a text table with a few of its keys would shuffle every text.
The filter is broadcast instead, and only texts that it lets through are
shuffled into the exact join behind it.  It grows with the number of keys up to
`MOST` bits; beyond that it lets more other rows through, and the exact join
has more to do, but never a different result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableflow.llm.common import ROW
from tableflow.llm.flat import mix

LEAST, MOST = 16, 26  # log2 of the number of bits
_U = np.uint64


def _places(ids: np.ndarray, size: int) -> list[np.ndarray]:
    x = ids.astype(np.int64).view(_U)
    return [(mix(x + _U(k)) >> _U(64 - size)).astype(np.int64) for k in (1, 2)]


@dataclass(frozen=True)
class IdFilter:
    size: int
    bits: np.ndarray

    @property
    def sharp(self) -> bool:
        """Whether under one in a hundred other ids gets through."""
        return float(np.bitwise_count(self.bits).sum()) < 0.1 * (1 << self.size)

    def maybe(self, ids: np.ndarray) -> np.ndarray:
        """Which ids may be in the filter; all that were put in are."""
        ok = np.ones(len(ids), bool)
        for at in _places(ids, self.size):
            ok &= (self.bits[at >> 6] >> (at & 63).astype(_U)) & _U(1) == 1
        return ok


def id_filter(ids: DataFrame) -> IdFilter:
    """The filter of ids (ROW).  At most 2**(MOST - 6) words of it come to the
    driver, whatever the number of ids."""
    n = ids.count()
    size = int(min(max(LEAST, (16 * max(1, n)).bit_length()), MOST))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.concatenate(_places(batch.column(ROW).to_numpy(zero_copy_only=False), size))
            words, at = np.unique(every >> 6, return_inverse=True)
            bits = np.zeros(len(words), _U)
            np.bitwise_or.at(bits, at, _U(1) << (every & 63).astype(_U))
            yield pa.RecordBatch.from_pydict({"word": pa.array(words), "bits": pa.array(bits.view(np.int64))})

    words = ids.select(ROW).mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), _U)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(_U)
    return IdFilter(size, bits)
