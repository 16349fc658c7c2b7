"""Bloom filters in shards of a fixed number of bits, whose number follows the number of keys."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import cut

SHARD_BITS = 1 << 24
BITS_PER_KEY = 12
PROBES = 4


def shards_for(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // SHARD_BITS))


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return (h >> np.uint64(40)) % np.uint64(shards)


def probes(h: np.ndarray) -> np.ndarray:
    """Bit numbers in its shard, one row for each of the probes."""
    step = tv.mix(h + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(SHARD_BITS - 1) for i in range(PROBES)]).astype(np.uint32)


def freeze(marked: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(marked).tobytes(), 1)


def thaw(shards: int, packed: list[tuple[int, bytes]]) -> np.ndarray:
    """The bits of all shards in a row; a shard that is missing is empty."""
    bits = np.zeros(shards * SHARD_BITS // 8, np.uint8)
    for shard, raw in packed:
        bits[shard * SHARD_BITS // 8 : (shard + 1) * SHARD_BITS // 8] = np.frombuffer(zlib.decompress(raw), np.uint8)
    return bits


def holds(h: np.ndarray, at: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes the filter holds; ``at`` is the number of the shard in ``bits``."""
    found = np.ones(len(h), bool)
    for p in probes(h):
        where = at.astype(np.int64) * (SHARD_BITS // 8) + (p >> np.uint32(3))
        found &= (bits[where] >> (7 - (p & np.uint32(7))).astype(np.uint8)) & 1 == 1
    return found


def key_filter(keys: DataFrame, count: int, most_bytes: int = 64 << 20) -> Callable[[Column], Column] | None:
    """A predicate that is true of each of the ``count`` longs of ``keys`` and of few others; None if it would take more than ``most_bytes``."""
    shards = shards_for(count)
    if shards * SHARD_BITS // 8 > most_bytes:
        return None

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = tv.mix(batch.column(0).to_numpy().view(np.uint64))
            at = shard_of(h, shards)
            some = np.unique(at)
            bits = [np.unique(probes(h[at == s])).tobytes() for s in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(bits, pa.binary())], names=["shard", "at"])

    def merge(parts: pa.Table) -> pa.Table:
        marked = np.zeros(SHARD_BITS, bool)
        for at in parts.column("at"):
            marked[np.frombuffer(at.as_buffer(), np.uint32)] = True
        return pa.table({"shard": parts.column("shard").slice(0, 1), "bits": pa.array([freeze(marked)], pa.binary())})

    merged = keys.mapInArrow(fill, "shard long, at binary").groupBy("shard").applyInArrow(merge, "shard long, bits binary")
    held = keys.sparkSession.sparkContext.broadcast([(r.shard, bytes(r.bits)) for r in merged.collect()])
    thawed: list[np.ndarray] = []

    def has(key: pa.Array) -> pa.Array:
        if not thawed:
            thawed.append(thaw(shards, held.value))
        h = tv.mix(key.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64))
        return pa.array(holds(h, shard_of(h, shards), thawed[0]))

    has.__annotations__ = {"key": pa.Array, "return": pa.Array}
    return F.arrow_udf(has, "boolean").asNondeterministic()  # else a filter on it may be copied to where no Python runs
