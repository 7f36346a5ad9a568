"""Which 64-bit keys occur twice or more in a corpus: an exact-side filter that moves four bytes a key.

Tasks send each shard the low 32 bits of their distinct keys, packed and sorted.  Shards grow in number with
the input, so a shard holds a few million keys however large the corpus is, and a key seen once is taken for
repeated only if another key of its shard has the same low bits (about one in a thousand): a caller may treat
some lone keys as repeated, never the other way round.  Tasks gather ``HELD`` keys before they send, and more the
more shards there are, so that a row never holds a few keys only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from moundworks.llm.store import Store, every_shard, put

SHARD_KEYS = 4_000_000
HELD, ROW_KEYS, MOST_HELD = 1_000_000, 64, 8_000_000
SCHEMA = "shard int, once binary, more binary, counts binary"
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


def shards_for(n_keys: float) -> int:
    return max(8, int(n_keys // SHARD_KEYS) + 1)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys in a sorted array."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(keys)))


def placed(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard above a key's low half, in one number."""
    return ((keys >> HALF) % np.uint64(n_shards)) << HALF | (keys & LOW)


def pack(keys: np.ndarray, n_shards: int) -> pa.RecordBatch:
    """Rows of SCHEMA for the keys of some documents, each key once per document that has it."""
    both = np.sort(placed(keys, n_shards))
    at, n = runs(both)
    both = both[at]
    shard, low = (both >> HALF).astype(np.int32), both.astype(np.uint32)
    first, size = runs(shard)
    rows = []
    for a, k in zip(first.tolist(), size.tolist(), strict=True):
        own, times = low[a : a + k], n[a : a + k]
        rows.append((int(shard[a]), own[times == 1].tobytes(), own[times > 1].tobytes(), times[times > 1].astype(np.uint32).tobytes()))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=["shard", "once", "more", "counts"])


def packed(parts: Iterator[np.ndarray], n_shards: int) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA for keys that come in parts."""
    most, held, n = min(max(HELD, ROW_KEYS * n_shards), MOST_HELD), [], 0
    for keys in parts:
        held.append(keys)
        n += len(keys)
        if n >= most:
            yield pack(np.concatenate(held), n_shards)
            held, n = [], 0
    if n:
        yield pack(np.concatenate(held), n_shards)


def merge(rows: DataFrame, folder: str, n_shards: int, counted: bool = False) -> int:
    """Write each shard's repeated keys, sorted, to ``folder``, with their counts if asked; returns how many there are."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        once, more = (np.frombuffer(b"".join(rows[c]), np.uint32) for c in ("once", "more"))
        if counted:
            times = np.frombuffer(b"".join(rows["counts"]), np.uint32)
            both = np.sort(np.concatenate([once.astype(np.uint64) << HALF | np.uint64(1), more.astype(np.uint64) << HALF | times]))
            low = (both >> HALF).astype(np.uint32)
            at, n = runs(low)
            n = np.add.reduceat(both & LOW, at) if len(at) else n
            arrays = {"low": low[at[n > 1]], "n": np.minimum(n[n > 1], LOW).astype(np.uint32)}
        else:
            low = np.sort(np.concatenate([once, more, more]))  # what a task has twice counts twice
            at, n = runs(low)
            arrays = {"low": low[at[n > 1]]}
        put(folder, f"repeated-{key[0]}", **arrays)
        return pd.DataFrame({"n": [len(arrays["low"])]})

    return every_shard(rows, n_shards).groupBy("shard").applyInPandas(run, "n long").agg({"n": "sum"}).first()[0] or 0


class Repeated:
    """The stored keys, sought a shard at a time."""

    def __init__(self, folder: str, n_shards: int) -> None:
        self.store, self.n_shards = Store(folder), n_shards

    def contains(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        for _, own, _, found in self._found(keys):
            out[own] = found
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """How often each key occurs, 1 if it is not stored."""
        out = np.ones(len(keys), np.uint32)
        for have, own, at, found in self._found(keys):
            out[own[found]] = have["n"][at[found]]
        return out

    def _found(self, keys: np.ndarray) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
        for s, own in by_shard(((keys >> HALF) % np.uint64(self.n_shards)).astype(np.int64), self.n_shards):
            have = self.store.get(f"repeated-{s}")
            if len(have["low"]):
                sought = np.sort((keys[own] & LOW) << HALF | np.arange(len(own), dtype=np.uint64))  # in order, each with its place
                low = (sought >> HALF).astype(np.uint32)
                at = np.minimum(np.searchsorted(have["low"], low), len(have["low"]) - 1)
                yield have, own[(sought & LOW).astype(np.int64)], at, have["low"][at] == low


def by_shard(shard: np.ndarray, n_shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that occurs and the places where it does."""
    order = np.argsort(shard.astype(np.uint16) if n_shards <= 1 << 16 else shard, kind="stable")
    at, n = runs(shard[order])
    for a, k in zip(at.tolist(), n.tolist(), strict=True):
        yield int(shard[order[a]]), order[a : a + k]
