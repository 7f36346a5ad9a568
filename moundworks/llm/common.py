"""Helpers the corpus operators share: the shared folder, batches of texts, hashing, word counts.

Nothing here keeps data on one machine.  Whatever several stages need is written below the folder that
the cluster names in ``spark.checkpoint.dir`` and is read back from there, so a lost executor costs one
task retry and never a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.sources.shared import discard as discard
from moundworks.sources.shared import materialise as materialise
from moundworks.sources.shared import shared_folder as shared_dir

#: Words are runs of anything but ASCII whitespace (Java regular expression).
WORD = r"[^\x20\x09-\x0D]+"


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of phases whose result is already in the shared folder."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def texts(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes, None for null."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: int, limit: int = 8 << 20):
    """Cut a record batch into pieces whose text column holds about ``limit`` bytes, at least a row each."""
    size = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))])
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(size, size[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def h64(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: the splitmix64 finaliser


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * M1
    x = x ^ (x >> np.uint64(27))
    x = x * M2
    return x ^ (x >> np.uint64(31))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket(key: Column, n: int) -> Column:
    """A bucket from 0 to n - 1 by hash."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
