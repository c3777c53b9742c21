"""Words of many texts at once in numpy and Arrow, and bitmaps of keys that a task can look up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A bitmap has 2 ** BITS bits, 16 MiB, however many keys there are: more keys only make it turn away less.
BITS = 27


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def runs(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Maximal runs of bytes where `inside` holds: starts, ends, the number of each one's value, and the values in the order of their numbers."""
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    return starts, ends, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bitmap(keys: DataFrame, bits: int = BITS) -> np.ndarray:
    """The bitmap of the column `key`, made on the executors; the driver gets at most 2 ** bits bits of it."""
    place = f"(key & {(1 << bits) - 1})"
    rows = keys.groupBy(F.expr(f"cast(shiftright({place}, 6) as int)").alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast({place} & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out


def marked(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (unsigned) has its bit set; true for all keys that the bitmap was made of."""
    place = keys & np.uint64(len(words) * 64 - 1)
    return (words.view(np.uint64)[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
