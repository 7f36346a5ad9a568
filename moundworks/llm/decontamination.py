"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` turns the documents into segments: a segment holds the postings of every term of some hundred
thousand words (sorted term hashes, pointers, positions), and is one row of a Parquet table in the shared
folder.  Segments are the unit of recovery and of memory; nothing is shuffled.

``store_windows`` deals the benchmark into blocks of bounded size and writes each block's distinct windows to the shared
folder; ``store_counts`` adds how often its terms occur in the corpus, from one scan of the index.  ``search`` scans the
index once more: a task takes block after block and looks at those windows only whose rarest term the segment has.
A window is looked up from its rarest term on: its postings, shifted to the window's start, are intersected with the
next rarest term's shifted postings and so on until none or all 13 terms are left.  ``slop`` 0 gives exact phrases; a
positive slop gives proximity matches, in which every term lies within that many words of its place relative to the
rarest term's.

Defined cases: null or wordless texts have no words and no windows; an item of fewer than 13 words is one
window; repeated items count once; items with a null id hit words but are named '' in the list; repeated or
null document ids are judged row by row; texts of any length are taken whole; empty tables give no hits or no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.common import materialise, shared_dir, slices, source_table, texts
from moundworks.llm.repeated import runs
from moundworks.llm.store import Store, put
from moundworks.llm.words import ALPHANUMERIC, hashed_words

WINDOW = 13
BLOCK_CHARS = 2_000_000
SEGMENT = "doc_ids array<long>, tags array<long>, starts binary, terms binary, pointers binary, postings binary"


def build_index(docs: DataFrame) -> DataFrame:
    """One row per segment; starts: word number at which each document begins, and the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 2, 6 << 20):
                words, count = hashed_words(texts(batch.column(2)), ALPHANUMERIC)
                starts = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
                order = np.argsort(words, kind="stable")
                words = words[order]
                first = runs(words)[0]
                terms, pointers = words[first], np.append(first, len(words)).astype(np.int64)
                packed = [starts.tobytes(), terms.tobytes(), pointers.tobytes(), order.astype(np.uint32).tobytes()]
                ids = [pa.array([batch.column(k).to_pylist()], pa.list_(pa.int64())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *(pa.array([p], pa.binary()) for p in packed)], names=[x.split()[0] for x in SEGMENT.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
    return materialise(rows.mapInArrow(run, SEGMENT), "index", compression="zstd")


def windows_of(names: list[str], rows: list[bytes | None]) -> dict[str, np.ndarray]:
    """The distinct windows of some items: words (as places in the vocabulary, -1 after the end), and the items that have each."""
    words, count = hashed_words(rows, ALPHANUMERIC)
    found: dict[bytes, set[int]] = {}
    for i, (n, end) in enumerate(zip(count.tolist(), np.cumsum(count).tolist(), strict=True)):
        own = words[end - n : end]
        for k in range(max(n - WINDOW + 1, min(n, 1))):
            found.setdefault(own[k : k + WINDOW].tobytes(), set()).add(i)
    vocabulary = np.sort(np.frombuffer(b"".join(found), np.uint64))
    vocabulary = vocabulary[runs(vocabulary)[0]]
    terms = np.full((len(found), WINDOW), -1, np.int32)
    for row, window in zip(terms, found, strict=True):
        own = np.searchsorted(vocabulary, np.frombuffer(window, np.uint64))
        row[: len(own)] = own
    encoded = [n.encode() for n in names]
    return {
        "vocabulary": vocabulary,
        "terms": terms,
        "edges": np.cumsum([0, *(len(x) for x in found.values())]),
        "items": np.array([i for x in found.values() for i in sorted(x)], np.int64),
        "names": np.frombuffer(b"".join(encoded), np.uint8),
        "name_edges": np.cumsum([0, *map(len, encoded)]),
    }


def store_windows(benchmark: DataFrame, folder: str) -> int:
    """Write the windows of each block of the benchmark; returns the number of blocks."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = chars // BLOCK_CHARS + 1
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).alias("block"))
    empty = benchmark.sparkSession.range(n_blocks).select(F.lit("").alias("item"), F.lit(None).cast("string").alias("text"), F.col("id").alias("block"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        made = windows_of(rows["item"].to_pylist(), texts(rows["text"].combine_chunks()))
        put(folder, f"windows-{key[0].as_py()}", **made)
        return pa.table({"n": [len(made["terms"])]})

    items.unionByName(empty).groupBy("block").applyInArrow(run, "n long").agg({"n": "sum"}).collect()
    return n_blocks


def store_counts(index: DataFrame, folder: str, n_blocks: int) -> None:
    """Write how often each block's terms occur in the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        for batch in batches:
            for terms, pointers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms, size = np.frombuffer(terms, np.uint64), np.diff(np.frombuffer(pointers, np.int64))
                for block in range(n_blocks):
                    at, there = _find(terms, store.get(f"windows-{block}")["vocabulary"])
                    used = np.flatnonzero(there)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), block)), pa.array(used), pa.array(size[at[used]])], names=["block", "term", "n"])

    def write(key: tuple, rows: pa.Table) -> pa.Table:
        block, rows = key[0].as_py(), rows.filter(pc.is_valid(rows["term"]))
        counts = np.zeros(len(Store(folder).get(f"windows-{block}")["vocabulary"]), np.int64)
        counts[rows["term"].to_numpy()] = rows["n"].to_numpy()
        put(folder, f"counts-{block}", counts=counts)
        return pa.table({"n": [len(counts)]})

    found = index.select("terms", "pointers").mapInArrow(run, "block long, term long, n long").groupBy("block", "term").agg(F.sum("n").alias("n"))
    empty = index.sparkSession.range(n_blocks).select(F.col("id").alias("block"), *[F.lit(None).cast("long").alias(c) for c in ("term", "n")])
    found.unionByName(empty).groupBy("block").applyInArrow(write, "n long").agg({"n": "sum"}).collect()


class Windows:
    """A block's windows by their rarest term."""

    def __init__(self, stored: dict[str, np.ndarray], counts: np.ndarray) -> None:
        self.vocabulary, self.terms, self.edges, self.items = (stored[c] for c in ("vocabulary", "terms", "edges", "items"))
        whole, at = stored["names"].tobytes(), stored["name_edges"].tolist()
        self.names = [whole[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]
        often = np.append(counts, np.iinfo(np.int64).max)[self.terms]  # what is past the end comes last
        self.order = np.argsort(often, axis=1, kind="stable").astype(np.int8)
        rarest = np.take_along_axis(self.terms, self.order[:, :1].astype(np.int64), 1)[:, 0] if len(self.terms) else np.zeros(0, np.int32)
        self.by_rarest = np.argsort(rarest, kind="stable")
        first, size = runs(rarest[self.by_rarest])
        self.rarest, self.first, self.size = rarest[self.by_rarest][first], first, size

    def possible(self, there: np.ndarray) -> np.ndarray:
        """Windows all of whose terms are there."""
        own = np.flatnonzero(there[self.rarest])
        windows = np.concatenate([self.by_rarest[self.first[k] : self.first[k] + self.size[k]] for k in own.tolist()]) if len(own) else own
        return windows[np.append(there, True)[self.terms[windows]].all(axis=1)]


def _find(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(terms):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    return at, terms[at] == wanted


def matches(postings_of: Callable[[int], np.ndarray], terms: list[int], order: list[int], slop: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of a window's matches and their documents: offset-adjusted postings intersected from the rarest term on."""
    place = postings_of(terms[order[0]])
    doc = np.searchsorted(starts, place, side="right") - 1
    start = place - order[0]
    for k in order[1:]:
        postings = postings_of(terms[k])
        least, most = np.maximum(start + k - slop, starts[doc]), np.minimum(start + k + slop, starts[doc + 1] - 1)
        at = np.minimum(np.searchsorted(postings, least), len(postings) - 1)
        found = (postings[at] >= least) & (postings[at] <= most)
        start, doc = start[found], doc[found]
        if not len(start):
            break
    return start, doc


def search(index: DataFrame, folder: str, n_blocks: int, slop: int = 0) -> DataFrame:
    """A row per document: doc_id, tag, n_words, hits (merged word ranges), items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, held = Store(folder), {}
        for batch in batches:
            for row in batch.to_pylist():
                terms, starts, pointers, postings = (np.frombuffer(row[c], t) for c, t in (("terms", np.uint64), ("starts", np.int64), ("pointers", np.int64), ("postings", np.uint32)))
                n = len(row["doc_ids"])
                hits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
                items: list[set[str]] = [set() for _ in range(n)]
                for block in range(n_blocks):
                    if block not in held:
                        held = {block: Windows(store.get(f"windows-{block}"), store.get(f"counts-{block}")["counts"])}
                    windows, lists = held[block], {}
                    at, there = _find(terms, windows.vocabulary)

                    def postings_of(term: int, lists: dict = lists, at: np.ndarray = at, pointers: np.ndarray = pointers, postings: np.ndarray = postings) -> np.ndarray:
                        if term not in lists:
                            lists[term] = postings[pointers[at[term]] : pointers[at[term] + 1]].astype(np.int64)
                        return lists[term]

                    for w in windows.possible(there).tolist():
                        own = [t for t in windows.terms[w].tolist() if t >= 0]
                        found, doc = matches(postings_of, own, windows.order[w, : len(own)].tolist(), slop, starts)
                        if len(found):
                            names = [windows.names[i] for i in windows.items[windows.edges[w] : windows.edges[w + 1]].tolist()]
                            least, most = np.maximum(found - slop - starts[doc], 0), np.minimum(found + len(own) + slop, starts[doc + 1]) - starts[doc]
                            for s, e, d in zip(least.tolist(), most.tolist(), doc.tolist(), strict=True):
                                hits[d].append((s, e))
                                items[d].update(names)
                ranges = [[{"start": a, "end": b} for a, b in _merge(h)] for h in hits]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["tags"], pa.int64()), pa.array(np.diff(starts)),
                     pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                    names=["doc_id", "tag", "n_words", "hits", "items"],
                )

    return index.mapInArrow(run, "doc_id long, tag long, n_words long, hits array<struct<start:long,end:long>>, items array<string>")


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def covered(hits: Column) -> Column:
    """Words covered by ranges, overlaps once."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, h: F.struct(F.greatest(a["end"], h["end"]).alias("end"), (a["n"] + F.greatest(h["end"] - F.greatest(a["end"], h["start"]), F.lit(0))).alias("n"))
    return F.aggregate(F.array_sort(hits), zero, step)["n"]


def contamination(docs: DataFrame, benchmark: DataFrame, slop: int = 0) -> DataFrame:
    """doc_id, tag (hash of the text), n_words, hits, items, n_hit, contaminated: a row per row of docs."""
    index, folder = build_index(docs), shared_dir(docs.sparkSession, "windows")
    n_blocks = store_windows(benchmark, folder)
    store_counts(index, folder, n_blocks)
    found = search(index, folder, n_blocks, slop).withColumn("n_hit", covered(F.col("hits")))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(source_table(spark, sf_dir, "documents"), source_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[i:i + 12], ' ') AS phrase
  FROM (SELECT item_id, w, UNNEST(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, size, UNNEST(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) sizes)
), m AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, phrase)
), hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, UNNEST(range(i, i + size)) AS pos FROM m) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_tag"]), "left_anti")
