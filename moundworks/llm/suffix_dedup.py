"""Removal of byte strings that an earlier document holds: a difference cover and blockwise suffix sorting.

1. Cover sample: positions whose remainder by 31 lies in a six-element difference cover.  For any two
   positions some shift below 31 takes both into the sample, so two equal 50-byte strings share an equal
   20-byte string at sample positions at one shift.  Which sample strings recur in the corpus is found by
   ``repeated``.  A position with no recurring sample string among its next 31 cannot begin a repeated 50-byte
   string and drops out: that is most of the text.
2. The rest is cut at anchors, the least 20-byte hash of each 50-byte string: equal strings have the same
   anchor at the same place.  The bytes around an anchor that its strings cover (at most 80) are its context.
   A task settles a context that it has already met in a smaller document; the others go to suffix buckets by
   the anchor's hash, some hundred thousand each, so no more than a bucket is ever sorted at once.  An anchor
   with very many different contexts (a common passage's edges), as a sixteenth of the documents shows, has each of
   its 50-byte strings sent to a bucket by the string's own hash instead, once per task while documents rise.
3. A bucket's anchors are sorted once by the bytes from the anchor on and once by those before it, backwards.
   Shared prefix lengths turn either order into classes for every length, so each of the 31 strings around an
   anchor is a pair of class numbers, compared exactly; the smallest document of each pair is then known.
   Ties longer than 50 bytes never matter, so the cover's ranks are needed only as "recurs or not".
4. The removed ranges are merged per document, written as sorted arrays and looked up by the tasks that read
   the documents once more; texts are never shuffled.

Defined cases: a null text is an empty one; texts under 50 bytes keep everything; rows with a null id neither
cause a removal nor lose bytes; rows that share an id never affect each other; columns of docs other than
doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.common import discard, free_shuffles, h64, mix, shared_dir, slices, source_table, texts
from moundworks.llm.repeated import SCHEMA, Repeated, merge, packed, runs, shards_for
from moundworks.llm.store import Store, put

WIDTH = 50
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)  # every difference modulo 31 is one of two members
GRAM = WIDTH - PERIOD + 1
SLICE = 1 << 19
BUCKET_CHARS = 1_500_000
KNOWN = 1 << 19
KNOWN_STRINGS = 1 << 18
HOT, SAMPLED = 8_000, 16  # contexts of an anchor that is split by string, estimated from one of so many documents
PLACE = np.uint64((1 << 31) - 1)
_SAMPLED = np.isin(np.arange(PERIOD), COVER)
_BASES = mix(np.array([3, 5], np.uint64)) | np.uint64(1)
_BACK = [np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES]
_VALUES = [mix(np.arange(256, dtype=np.uint64) + np.uint64(k)) for k in (1000, 2000)]
ROWS = 20_000


_KEPT_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The powers 0 to n - 1 of a base, modulo 2 ** 64; those of a usual slice are kept."""
    if int(base) not in _KEPT_POWERS or len(_KEPT_POWERS[int(base)]) < n:
        made = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, SLICE + (1 << 16)), base)]))
        if n > 4 * SLICE:
            return made[:n]
        _KEPT_POWERS[int(base)] = made
    return _KEPT_POWERS[int(base)][:n]


class Slice:
    """Some texts end to end, padded so that every position has 20 bytes."""

    def __init__(self, rows: list[bytes | None]) -> None:
        data = [t or b"" for t in rows]
        self.size = np.array([len(t) for t in data], np.int64)
        self.starts = np.cumsum(self.size) - self.size
        self.bytes = b"".join(data)
        self.n = len(self.bytes)
        padded = self.bytes + bytes(32)
        self.eight = np.ndarray(self.n + 24, "<u8", padded, strides=(1,))
        self.four = np.ndarray(self.n + 24, "<u4", padded, strides=(1,))
        self.sums: list[np.ndarray] = []
        self.raw = np.frombuffer(padded, np.uint8)
        self.row = np.repeat(np.arange(len(data), dtype=np.int32), self.size)
        self.at = np.arange(self.n, dtype=np.int64) - self.starts[self.row]
        self.left = self.size[self.row] - self.at  # bytes from here to the document's end

    def grams(self, places: np.ndarray) -> np.ndarray:
        """Hashes of the 20 bytes at some places."""
        return mix(self.eight[places] + mix(self.eight[places + 8] + mix(self.four[places + 16].astype(np.uint64))))

    def sample(self) -> np.ndarray:
        return np.flatnonzero(_SAMPLED[self.at % PERIOD] & (self.left >= GRAM))

    def digests(self, start: np.ndarray, end: np.ndarray, also: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit digests of the bytes from start to end and of one more number; the same wherever the bytes stand."""
        if self.n and not self.sums:
            self.sums = [np.concatenate([[np.uint64(0)], np.cumsum(v[self.raw[: self.n]] * _powers(b, self.n))]) for b, v in zip(_BASES, _VALUES, strict=True)]
        more = mix((end - start + 256 * also).astype(np.uint64))
        one, two = (mix((total[end] - total[start]) * _powers(back, self.n)[start] + more) for total, back in zip(self.sums or [more, more], _BACK, strict=True))
        return one, two


def cover_sample(docs: DataFrame, folder: str) -> int:
    """Write which sample strings recur; returns the number of shards."""
    chars = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_shards = shards_for(chars * len(COVER) / PERIOD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (Slice(texts(batch.column(1))) for whole in batches for batch in slices(whole, 1, SLICE))
        yield from packed((part.grams(part.sample()) for part in parts), n_shards)

    merge(docs.mapInArrow(run, SCHEMA), folder, n_shards)
    return n_shards


def candidates(part: Slice, known: Repeated) -> np.ndarray:
    """Places whose 50-byte string may recur: a sample string inside it does."""
    if part.n < WIDTH:
        return np.zeros(0, np.int64)
    sample = part.sample()
    recurs = np.zeros(part.n + 1, np.int32)
    recurs[sample[known.contains(part.grams(sample))] + 1] = 1
    recurs = np.cumsum(recurs, dtype=np.int32)
    ends = np.minimum(np.arange(part.n) + PERIOD, part.n)
    return np.flatnonzero((recurs[ends] > recurs[:-1]) & (part.left >= WIDTH))


def anchors(part: Slice, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places with one anchor: first and last place, anchor, and the anchor's hash."""
    if not len(places):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    edge = np.zeros(part.n + PERIOD + 1, np.int32)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + PERIOD, -1)
    used = np.flatnonzero(np.cumsum(edge)[: part.n] > 0)
    key = np.full(part.n + 2 * PERIOD, np.iinfo(np.uint64).max, np.uint64)
    key[used] = (part.grams(used) & ~PLACE) | used.astype(np.uint64)  # leftmost of equal hashes
    least = key
    for step in (1, 2, 4, 8):
        least = np.minimum(least[:-step], least[step:])
    least = np.minimum(least[: part.n], least[15 : 15 + part.n])  # over 31 places
    anchor = (least[places] & PLACE).astype(np.int64)
    new = np.ones(len(places), bool)
    new[1:] = (places[1:] != places[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (part.row[places[1:]] != part.row[places[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places)) - 1
    anchor = anchor[first]
    return places[first], places[last], anchor, part.grams(anchor)


def text_tag(text: bytes | None) -> int:
    """Tells texts of one document id apart."""
    return h64(text or b"") & 0x7FFFFFFF


class Met:
    """Strings met of late, each with the least document that had it: a table of fixed size in which new ones replace old ones."""

    def __init__(self, size: int) -> None:
        self.first, self.second, self.doc = np.zeros(size, np.uint64), np.zeros(size, np.uint64), np.full(size, np.iinfo(np.int64).max)

    def before(self, first: np.ndarray, second: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        """Has a smaller document had the string of these digests?  Documents rise; what is new is remembered."""
        if not len(first):
            return np.zeros(0, bool)
        slot = (first % np.uint64(len(self.first))).astype(np.int64)
        known = (self.first[slot] == first) & (self.second[slot] == second)
        least = np.where(known, self.doc[slot], np.iinfo(np.int64).max)
        order = np.argsort(first, kind="stable")
        at, n = runs(first[order])
        head = np.empty(len(first), np.int64)
        head[order] = np.repeat(order[at], n)
        new = order[at]
        new = new[doc_id[new] < least[new]]
        self.first[slot[new]], self.second[slot[new]], self.doc[slot[new]] = first[new], second[new], doc_id[new]
        return np.where(second[head] == second, np.minimum(least, doc_id[head]), least) < doc_id


def hot_anchors(docs: DataFrame, folder: str, n_shards: int) -> int:
    """Write the hashes of anchors that would send HOT contexts or more; any choice of anchors gives the same result.

    Returns the number of shards that they are in, 0 if there are none.
    """
    n_tasks = docs.rdd.getNumPartitions()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met, before = Repeated(folder, n_shards), Met(KNOWN), 0
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                part = Slice([b"" if i is None else t for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)])
                first, last, anchor, gram = anchors(part, candidates(part, known))
                one, two = part.digests(first, last + WIDTH, anchor - first)
                new = ~met.before(one, two, part.row[first].astype(np.int64) + before)
                before += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(gram[new].view(np.int64)), pa.array(one[new].view(np.int64))], names=["anchor", "digest"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).mapInArrow(run, "anchor long, digest long")
    sent = F.least(F.col("count") * SAMPLED, F.lit(n_tasks).cast("long"))  # a task settles what it has met
    sums = sample.groupBy("anchor", "digest").count().groupBy("anchor").agg(F.sum(sent).alias("sent"))
    n_hot = shards_for((docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) / HOT if HOT else 0)

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed((np.repeat(batch.column(0).to_numpy().view(np.uint64), 2) for batch in batches), n_hot)

    found = merge(sums.where(F.col("sent") >= HOT).select("anchor").mapInArrow(twice, SCHEMA), f"{folder}/hot", n_hot)
    return n_hot if found else 0


CONTEXTS = "bucket int, context binary, before int, doc_id long, tag int, start int, size int"


def contexts(docs: DataFrame, folder: str, n_shards: int, n_buckets: int, n_hot: int) -> DataFrame:
    """Contexts of CONTEXTS to be sorted, and (without context) ranges already known to go.

    tag: the text's; start: where the context begins in the document; size: bytes of a range without context.
    A string of a hot anchor is a context of its own that begins with its anchor; n_hot is what ``hot_anchors`` returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, met, met_strings, hot = Repeated(folder, n_shards), Met(KNOWN), Met(KNOWN_STRINGS), Repeated(f"{folder}/hot", n_hot)
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                rows = zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)
                rows = sorted(((i, t) for i, t in rows if i is not None), key=lambda r: r[0])  # smaller documents settle others
                ids, rows = np.array([i for i, _ in rows], np.int64), [t for _, t in rows]
                part = Slice(rows)
                first, last, anchor, gram = anchors(part, candidates(part, known))
                tags = np.zeros(len(rows), np.int64)
                for r in np.flatnonzero(np.bincount(part.row[first], minlength=len(rows))).tolist():
                    tags[r] = text_tag(rows[r])
                one, two = part.digests(first, last + WIDTH, anchor - first)
                gone = met.before(one, two, ids[part.row[first]])
                split = ~gone & hot.contains(gram) if n_hot else np.zeros(len(gram), bool)
                count = (last - first + 1)[split]
                string = np.repeat(first[split] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                at, three, four = string, *part.digests(string, string + WIDTH, 0 * string)
                settled = met_strings.before(three, four, ids[part.row[at]])
                whole_ones = ~gone & ~split
                start, end = (np.concatenate([x[whole_ones], y[~settled]]) for x, y in ((first, at), (last + WIDTH, at + WIDTH)))
                before = np.concatenate([(anchor - first)[whole_ones], np.zeros((~settled).sum(), np.int64)])
                bucket = np.concatenate([gram[whole_ones], three[~settled]]) % np.uint64(n_buckets)
                yield from context_batches(part, start, end, before, bucket, ids, tags)
                start, end = merged(part.row, *(np.concatenate([x[gone], y[settled]]) for x, y in ((first, at), (last + WIDTH, at + WIDTH))))
                row = part.row[start]
                cols = [(ids[row] + tags[row]) % n_buckets, None, 0 * start, ids[row], tags[row], start - part.starts[row], end - start]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(row), k) if c is None else pa.array(c).cast(k) for c, k in zip(cols, KINDS, strict=True)], names=NAMES)

    return docs.mapInArrow(run, CONTEXTS)


KINDS = (pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
NAMES = [x.split()[0] for x in CONTEXTS.split(", ")]


def context_batches(part: Slice, start: np.ndarray, end: np.ndarray, before: np.ndarray, bucket: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of CONTEXTS for the bytes from start to end of a slice."""
    for k in range(0, len(start), ROWS):
        a, size = start[k : k + ROWS], (end - start)[k : k + ROWS]
        ends = np.cumsum(size)
        data = part.raw[np.repeat(a - (ends - size), size) + np.arange(ends[-1])]
        context = pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data)])
        row = part.row[a]
        cols = [bucket[k : k + ROWS].astype(np.int32), None, before[k : k + ROWS], ids[row], tags[row], a - part.starts[row], 0 * a]
        yield pa.RecordBatch.from_arrays([context if c is None else pa.array(c).cast(t) for c, t in zip(cols, KINDS, strict=True)], names=NAMES)


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of a slice, those of one row that touch made one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] > reach[:-1]) | (row[start[1:]] != row[start[:-1]])
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


def _order(sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows, and the number of leading bytes each shares with the one before it."""
    n, width = sides.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = sides
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    same = sides[order[1:]] == sides[order[:-1]]
    shared = np.where(same.all(axis=1), width, np.argmin(same, axis=1)) if n > 1 else np.zeros(0, np.int64)
    return order, np.concatenate([[0], shared])


def _classes(order: np.ndarray, shared: np.ndarray, length: int) -> np.ndarray:
    """A number for each row, equal for rows that share their first ``length`` bytes."""
    out = np.empty(len(order), np.int64)
    new = shared < length
    if len(new):
        new[0] = False
    out[order] = np.cumsum(new)
    return out


def sides(flat: np.ndarray, size: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of contexts that lie end to end: WIDTH bytes from each anchor on, and PERIOD - 1 before it, backwards; zero where none are."""
    span, total = PERIOD - 1, len(flat)
    anchor = np.cumsum(size) - size + before
    ahead = np.lib.stride_tricks.sliding_window_view(np.concatenate([flat, np.zeros(WIDTH, np.uint8)]), WIDTH)
    back = np.lib.stride_tricks.sliding_window_view(np.concatenate([flat[::-1], np.zeros(span, np.uint8)]), span)
    right, left = ahead[anchor], back[total - anchor]
    right[np.arange(WIDTH) >= (size - before)[:, None]] = 0
    left[np.arange(span) >= before[:, None]] = 0
    return right, left


def settle(right: np.ndarray, left: np.ndarray, size: np.ndarray, before: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """Per anchor and shift: does its 50-byte string that begins ``shift`` bytes earlier occur in a smaller document?"""
    n = len(size)
    after, back = _order(right), _order(left)
    gone = np.zeros((n, PERIOD), bool)
    for shift in range(PERIOD):
        has = np.flatnonzero((before >= shift) & (size - before + shift >= WIDTH))
        if len(has):
            both = _classes(*back, shift)[has] * n + _classes(*after, WIDTH - shift)[has]
            order = np.argsort(both)
            first, count = runs(both[order])
            gone[has[order], shift] = doc_id[has[order]] > np.repeat(np.minimum.reduceat(doc_id[has[order]], first), count)
    return gone


def alike(right: np.ndarray, left: np.ndarray, size: np.ndarray, before: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, one for each context and of its least document, and for each row the place among them of its context."""
    words = np.zeros((len(size), 12), np.uint64)
    words.view(np.uint8).reshape(len(size), -1)[:, :WIDTH] = right
    words.view(np.uint8).reshape(len(size), -1)[:, 56 : 56 + PERIOD - 1] = left
    words[:, 11] = size * 256 + before
    digest = np.zeros(len(size), np.uint64)
    for k in range(12):
        digest = mix(digest + words[:, k])
    order = np.lexsort((doc_id, digest))
    first, count = runs(digest[order])
    one, of = order[first], np.empty(len(size), np.int64)
    of[order] = np.repeat(np.arange(len(first)), count)
    odd = np.flatnonzero((words != words[one[of]]).any(axis=1))  # other contexts of the same digest stand for themselves
    of[odd] = len(one) + np.arange(len(odd))
    return np.concatenate([one, odd]), of


def sort_bucket(rows: pa.Table) -> pa.Table:
    """doc_id, tag, start, end of the bytes to remove."""
    known = rows.filter(pc.is_null(rows["context"]))
    settled = [known[c].to_numpy() for c in ("doc_id", "tag", "start", "size")]
    out = [[settled[0], settled[1], settled[2], settled[2] + settled[3]]]
    rows = rows.filter(pc.is_valid(rows["context"])).combine_chunks()
    if len(rows):
        context = rows["context"].chunk(0)
        size = pc.binary_length(context).to_numpy().astype(np.int64)
        begin = int(np.frombuffer(context.buffers()[1], np.int32)[context.offset])
        flat = np.frombuffer(context.buffers()[2], np.uint8)[begin : begin + size.sum()]
        before, doc_id, tag, start = (rows[c].to_numpy().astype(np.int64) for c in ("before", "doc_id", "tag", "start"))
        right, left = sides(flat, size, before)
        one, of = alike(right, left, size, before, doc_id)
        gone = settle(right[one], left[one], size[one], before[one], doc_id[one])[of]
        shifts = np.arange(PERIOD)
        has = (before[:, None] >= shifts) & ((size - before)[:, None] + shifts >= WIDTH)
        gone |= has & (doc_id > doc_id[one][of])[:, None]
        at, shift = np.nonzero(gone)
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (shift[1:] != shift[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            anchor = (start + before)[at[first]]
            out.append([doc_id[at[first]], tag[at[first]], anchor - shift[last], anchor - shift[first] + WIDTH])
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pa.table([pa.array(c).cast(k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "tag", "start", "end"])


def doc_key(doc_id: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """One key for a document's id and text."""
    return mix(mix(doc_id.astype(np.int64).view(np.uint64)) + tag.astype(np.uint64))


def store_ranges(ranges: DataFrame, folder: str, n_files: int) -> None:
    """Merge each document's ranges and write them as sorted arrays; a file without ranges is written too."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.is_valid(rows["doc_id"]))
        doc_id, tag, start, end = (rows[c].to_numpy().astype(np.int64) for c in ("doc_id", "tag", "start", "end"))
        doc = doc_key(doc_id, tag)
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        shift = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))[: len(doc)] * np.int64(1 << 32)  # keeps documents apart in a running maximum
        reach = np.maximum.accumulate(end + shift)
        new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])[: len(doc)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc))[: len(first)] - 1
        put(folder, f"ranges-{key[0].as_py()}", docs=doc[first], ranges=np.stack([start[first], reach[last] - shift[last]], axis=1))
        return pa.table({"n": [len(first)]})

    n = F.lit(n_files).cast("long")
    file = F.pmod(F.pmod("doc_id", n) + F.col("tag"), n)  # equal texts are spread by their ids
    none = ranges.sparkSession.range(n_files).select(F.col("id").cast("int").alias("file"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in ranges.schema])
    ranges.withColumn("file", file.cast("int")).unionByName(none).groupBy("file").applyInArrow(run, "n long").agg({"n": "sum"}).collect()


def dedup_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary), kept_sha256: a row per row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    folder, ranges = shared_dir(spark, "suffix"), shared_dir(spark, "ranges")
    n_shards = cover_sample(docs, folder)
    free_shuffles(spark)
    chars = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n_buckets = chars // BUCKET_CHARS + 8
    hot = hot_anchors(docs, folder, n_shards)
    free_shuffles(spark)
    sorted_rows = contexts(docs, folder, n_shards, n_buckets, hot).groupBy("bucket").applyInArrow(sort_bucket, "doc_id long, tag int, start int, end int")
    n_files = chars // (1 << 26) + 16
    store_ranges(sorted_rows, ranges, n_files)
    discard(spark, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(ranges)
        for whole in batches:
            for batch in slices(whole, 1, SLICE):
                ids, rows = batch.column(0).to_pylist(), texts(batch.column(1))
                gone: dict[int, list] = {}
                files = {r: (i + text_tag(t)) % n_files for r, (i, t) in enumerate(zip(ids, rows, strict=True)) if i is not None and t and len(t) >= WIDTH}
                for r in sorted(files, key=files.get):
                    stored = store.get(f"ranges-{files[r]}")
                    key = doc_key(np.array([ids[r]]), np.array([text_tag(rows[r])]))[0]
                    gone[r] = stored["ranges"][np.searchsorted(stored["docs"], key, "left") : np.searchsorted(stored["docs"], key, "right")].tolist()
                out = []
                for r, (i, text) in enumerate(zip(ids, rows, strict=True)):
                    text, kept, end = text or b"", [], 0
                    for a, b in gone.get(r, ()):
                        kept.append(text[end:a])
                        end = b
                    kept.append(text[end:])
                    rest = b"".join(kept)
                    out.append((i, len(text), len(text) - len(rest), len(gone.get(r, ())), rest, hashlib.sha256(rest).hexdigest()))
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(source_table(spark, sf_dir, "documents")).drop("kept")


OP4_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), w AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, UNNEST(range(0, n - 49)) AS i FROM d)
), f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT w.doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY w.doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new
  FROM w JOIN f ON w.s = f.s WHERE first < w.doc_id
), island AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit
), span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM island GROUP BY doc_id, g
), cut AS (
  SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM span
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(d.n) FROM d LEFT JOIN span ON d.doc_id = span.doc_id GROUP BY d.doc_id
), kept AS (
  SELECT d.doc_id, coalesce(string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x), '') AS k FROM d JOIN cut ON d.doc_id = cut.doc_id GROUP BY d.doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(s.removed, 0) AS n_removed, coalesce(s.n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id
LEFT JOIN (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS n_spans FROM span GROUP BY doc_id) s ON d.doc_id = s.doc_id
"""
