"""Line de-duplication by a sharded minimal perfect hash.

1. Every worker hashes the normalised lines of its documents to 128 bits (64 for the place, 64 as the
   fingerprint); a Spark aggregation finds per hash the smallest and largest document and the count.
2. The hashes found in two documents or more are dealt into shards.  Each shard becomes a minimal perfect
   hash (levels of bit arrays with ranks, no keys kept) over three arrays: fingerprint, count, smallest
   document.  A line of one document only needs no place: its fingerprint mismatches, so it is kept.
3. Documents memory-map the shards in the shared folder and probe them; no line is joined or shuffled again.

Defined cases: a null text stays null and counts as one empty line; an empty text is one empty line; rows
with a null ``doc_id`` neither cause a removal nor lose lines; rows that repeat a ``doc_id`` are one document;
lines and texts of any length are taken whole; columns of the input named as those of ``ADDED`` are replaced, all others
pass through unchanged; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundworks.llm.common import discard, materialise, mix, shared_dir, slices, source_table, texts
from moundworks.llm.repeated import by_shard
from moundworks.llm.store import Store, put

MIN_CHARS = 10
SHARD_KEYS = 1_000_000
MASK = (1 << 64) - 1
ADDED = ("n_lines", "n_dropped", "most_copies")


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without outer ASCII whitespace, A-Z lower-cased; None if it has too few code points."""
    key = line.strip()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key.lower()


def digest(key: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(key)
    return x >> 64, x & MASK


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """place, mark, doc_id: one row per distinct long line of each document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 1):
                place, mark, doc = [], [], []
                for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                    if text and i is not None:
                        keys = {key for line in text.split(b"\n") if (key := line_key(line, min_chars))}
                        for p, m in map(digest, keys):
                            place.append(p)
                            mark.append(m)
                            doc.append(i)
                cols = [np.array(place, np.uint64).view(np.int64), np.array(mark, np.uint64).view(np.int64), np.array(doc, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["place", "mark", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "place long, mark long, doc_id long")


def _at(place: np.ndarray, mark: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix(place + mix(mark + np.uint64(level * 0x9E3779B97F4A7C15 & MASK))) % np.uint64(size)


def build_hash(place: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, ranks, level sizes, and each key's slot: slots are 0 .. n-1, each used once.

    Level by level a key takes the bit its hash points to if no other key points there; the rest go on.
    """
    left, levels, sizes = np.arange(len(place)), [], []
    where = np.zeros(len(place), np.int64)  # bit number over all levels
    base = 0
    while len(left):
        if len(sizes) > 200:
            raise ValueError("the keys of a minimal perfect hash must be distinct")
        size = max(64, -(-2 * len(left) // 64) * 64)
        at = _at(place[left], mark[left], len(sizes), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        placed = alone[at]
        where[left[placed]] = base + at[placed]
        left, base = left[~placed], base + size
    words = np.concatenate(levels) if levels else np.zeros(0, np.uint64)
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))])[:-1].astype(np.uint32) if len(words) else np.zeros(0, np.uint32)
    return words, ranks, np.array(sizes, np.int64), _rank(words, ranks, where)


def _rank(words: np.ndarray, ranks: np.ndarray, bit: np.ndarray) -> np.ndarray:
    word = bit >> 6
    below = (np.uint64(1) << (bit & 63).astype(np.uint64)) - np.uint64(1)
    return ranks[word].astype(np.int64) + np.bitwise_count(words[word] & below)


def probe_hash(words: np.ndarray, ranks: np.ndarray, sizes: np.ndarray, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Each key's slot; -1 where no level has its bit (surely not a member)."""
    slot, left, base = np.full(len(place), -1, np.int64), np.arange(len(place)), 0
    for level, size in enumerate(sizes.tolist()):
        bit = base + _at(place[left], mark[left], level, size).astype(np.int64)
        found = (words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
        slot[left[found]] = _rank(words, ranks, bit[found])
        left, base = left[~found], base + size
    return slot


def build_shards(repeated: DataFrame, folder: str, n_shards: int) -> None:
    """One minimal perfect hash and its arrays per shard, written to ``folder``; a shard without lines is written too."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.is_valid(rows["place"]))
        place, mark, first, n = (rows[c].to_numpy() for c in ("place", "mark", "first", "n"))
        place, mark = place.view(np.uint64), mark.view(np.uint64)
        words, ranks, sizes, slot = build_hash(place, mark)
        marks, counts, firsts = np.empty(len(rows), np.uint64), np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        marks[slot], counts[slot], firsts[slot] = mark, n, first
        put(folder, f"lines-{key[0].as_py()}", words=words, ranks=ranks, sizes=sizes, marks=marks, counts=counts, firsts=firsts)
        return pa.table({"n": [len(rows)]})

    empty = repeated.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("shard"), *[F.lit(None).cast("long").alias(c) for c in repeated.columns])
    dealt = repeated.withColumn("shard", F.pmod("place", F.lit(n_shards)).cast("int")).unionByName(empty)
    dealt.groupBy("shard").applyInArrow(run, "n long").agg({"n": "sum"}).collect()


class Shards:
    """The stored shards, probed one after another."""

    def __init__(self, folder: str, n_shards: int) -> None:
        self.store, self.n = Store(folder), n_shards

    def find(self, place: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Found or not, the smallest document that holds the line, and how many documents hold it."""
        found, first, count = np.zeros(len(place), bool), np.zeros(len(place), np.int64), np.ones(len(place), np.int64)
        for s, own in by_shard(np.mod(place.view(np.int64), self.n), self.n):
            have = self.store.get(f"lines-{s}")
            slot = probe_hash(have["words"], have["ranks"], have["sizes"], place[own], mark[own])
            own, slot = own[slot >= 0], slot[slot >= 0]
            same = have["marks"][slot] == mark[own]
            found[own[same]], first[own[same]], count[own[same]] = True, have["firsts"][slot[same]], have["counts"][slot[same]]
        return found, first, count


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Drop lines that a document with a smaller id holds too; adds n_lines (before), n_dropped and most_copies.

    most_copies is the greatest number of documents that share one of the text's lines, 1 if none is shared.
    """
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    seen = line_hashes(docs, min_chars).groupBy("place", "mark").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    folder, work = shared_dir(spark, "line-hash"), shared_dir(spark, "line-keys")
    repeated = materialise(seen.where("first < last").select("place", "mark", "first", "n"), "lines", work)
    n_shards = repeated.count() // SHARD_KEYS + 1
    build_shards(repeated, folder, n_shards)
    discard(spark, work)
    names = docs.columns
    i_id, i_text = names.index("doc_id"), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = Shards(folder, n_shards)
        for whole in batches:
            for batch in slices(whole, i_text):
                ids = batch.column(i_id).to_pylist()
                split = [None if t is None else t.split(b"\n") for t in texts(batch.column(i_text))]
                where, marks = [], []
                for r, lines in enumerate(split):
                    if lines and ids[r] is not None:
                        for k, line in enumerate(lines):
                            if key := line_key(line, min_chars):
                                where.append((r, k))
                                marks.append(digest(key))
                drop: dict[int, set[int]] = {}
                most = np.ones(len(split), np.int64)
                if where:
                    pairs = np.array(marks, np.uint64)
                    found, first, count = shards.find(pairs[:, 0].copy(), pairs[:, 1].copy())
                    np.maximum.at(most, np.array([r for r, _ in where]), count)
                    for j in np.flatnonzero(found).tolist():
                        r, k = where[j]
                        if first[j] < ids[r]:
                            drop.setdefault(r, set()).add(k)
                kept = [lines if lines is None else b"\n".join(lines if r not in drop else [x for k, x in enumerate(lines) if k not in drop[r]]) for r, lines in enumerate(split)]
                cols = list(batch.columns)
                cols[i_text] = pa.array(kept, pa.binary()).cast(pa.string())
                cols += [pa.array([1 if x is None else len(x) for x in split], pa.int64()), pa.array([len(drop.get(r, ())) for r in range(len(split))], pa.int64()), pa.array(most)]
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *ADDED])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ADDED)])
    return docs.mapInArrow(run, schema)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, UNNEST(string_split(coalesce(text, ''), chr(10))) AS line,
    UNNEST(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS dropped FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
