"""Words of many texts at once: where they lie and a 64-bit hash of each, by array operations only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from moundworks.llm.common import mix

#: Tables for ``bytes.translate``: A-Z lower-cased; all that parts words becomes a space.
SPACED = bytes(32 if c in b" \t\n\r\x0b\x0c" else c + 32 if 65 <= c <= 90 else c for c in range(256))
ALPHANUMERIC = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
LONG = 256  # bytes from which a word is hashed on its own
_SEED = np.uint64(0x9E3779B97F4A7C15)


def hashed_words(rows: list[bytes | None], table: bytes = SPACED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts, text after text, and the number of words of each text."""
    return located_words(rows, table)[:2]


def located_words(rows: list[bytes | None], table: bytes = SPACED) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """The same, and the translated bytes with each word's start in them and its size.

    A word's bytes are taken eight at a time; equal words have equal hashes whatever stands around them.
    """
    joined = b" ".join([b"", *(t or b"" for t in rows), b""])
    text = (joined + bytes(8)).translate(table)
    n = len(joined)
    gap = np.frombuffer(text, np.uint8)[:n] == 32
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, size = edges[0::2], edges[1::2] - edges[0::2]
    ends = np.cumsum([len(t or b"") + 1 for t in rows], dtype=np.int64) if rows else np.zeros(0, np.int64)
    count = np.diff(np.searchsorted(starts, np.concatenate([[0], ends])))
    eight = np.ndarray(n, "<u8", text, strides=(1,))

    def chunk(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        return eight[at] << ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)

    out = mix(chunk(starts, size) ^ (size.astype(np.uint64) * _SEED))
    more, k = np.flatnonzero(size > 8), 8
    while len(more) and k < LONG:
        out[more] = mix(out[more] + mix(chunk(starts[more] + k, size[more] - k) + np.uint64(k)))
        k += 8
        more = more[size[more] > k]
    for w in more.tolist():
        out[w] = xxhash.xxh3_64_intdigest(text[starts[w] : starts[w] + size[w]])
    return out, count, text, starts, size


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's number among the distinct ones, by first appearance, and where each distinct one appears first."""
    codes = pa.array(hashes).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    most = np.maximum.accumulate(codes) if len(codes) else codes
    return codes, np.flatnonzero(np.diff(most, prepend=-1))


def strings(text: bytes, starts: np.ndarray, size: np.ndarray) -> pa.Array:
    """The words at some places as one array of strings."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    if offsets[-1] >= 1 << 31:
        raise ValueError("more than 2 GB of words at once")
    data = np.frombuffer(text, np.uint8)[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))
