"""Arrays in the shared folder: a file per shard, mapped while it is in use.

A file holds the named arrays of one shard behind a small header.  Workers map it where the folder is a file
system and read it into memory where it is an object store, of either no more than ``OPEN`` files at a time, so
descriptors, mappings and memory stay bounded however many shards there are.  Nothing is copied to a worker's
own disk.  ``every_shard`` gives each shard a row, so that each has a file, if an empty one: a file that is not
there is an error and never means "nothing found".
"""

from __future__ import annotations

import json
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN = 64
ALIGN = 64


def put(folder: str, name: str, **arrays: np.ndarray) -> None:
    """Write some arrays as one file; a rename makes a retried task harmless."""
    arrays = {k: np.ascontiguousarray(v) for k, v in arrays.items()}
    fields, at = {}, 0
    for k, v in arrays.items():
        fields[k] = (v.dtype.str, v.shape, at)
        at += -(-v.nbytes // ALIGN) * ALIGN
    head = json.dumps(fields).encode()
    head = head.ljust(-(-(len(head) + 8) // ALIGN) * ALIGN - 8)
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for v in arrays.values():
            if v.nbytes:
                out.write(memoryview(v).cast("B"))
                out.write(bytes(-v.nbytes % ALIGN))
    fs.move(part, f"{path}/{name}")


class Store:
    """Reads what ``put`` wrote; the files used last stay mapped."""

    def __init__(self, folder: str, limit: int = OPEN) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.limit, self.open = limit, OrderedDict()

    def get(self, name: str) -> dict[str, np.ndarray]:
        if name in self.open:
            self.open.move_to_end(name)
        else:
            while len(self.open) >= self.limit:
                self.open.popitem(last=False)  # the mapping goes with its last array
            self.open[name] = self._arrays(f"{self.path}/{name}")
        return self.open[name]

    def _arrays(self, file: str) -> dict[str, np.ndarray]:
        if isinstance(self.fs, pafs.LocalFileSystem):
            data = np.memmap(file, np.uint8, "r")
        else:
            with self.fs.open_input_file(file) as source:
                data = np.frombuffer(source.read_buffer(), np.uint8)
        start = 8 + int.from_bytes(data[:8].tobytes(), "little")
        out = {}
        for k, (kind, shape, at) in json.loads(data[8:start].tobytes()).items():
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            out[k] = data[start + at : start + at + size].view(kind).reshape(shape)
        return out


def every_shard(packed: DataFrame, n_shards: int) -> DataFrame:
    """packed (shard and binary columns) and an empty row for each shard."""
    empty = packed.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"), *[F.lit(b"").alias(c) for c in packed.columns if c != "shard"])
    return packed.unionByName(empty)
