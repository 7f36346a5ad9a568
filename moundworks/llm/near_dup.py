"""N-gram Jaccard join by parity sketches.

A document is the set of its 64-bit shingle hashes; equal sets are one class (node).  Toggling one bit per
shingle gives a parity sketch: the Hamming distance of two sketches never exceeds the symmetric difference of
the sets.  Sets that link differ in at most a third of the smaller one's size, so with the sketch cut into
more blocks than that, a linked pair has an equal block: an equi-join on (size band, block, bits) finds all.

1. Shingles that occur once in the corpus only add to differences: a set with over a quarter of those links
   with nothing and drops out (``repeated``; the test errs on the side of keeping).
2. The remaining classes are cut into blocks.  All-zero blocks carry nothing; as linked sets share all but a
   bounded number of their non-zero blocks, the rarest few of a class's blocks are enough (a prefix filter in
   order of frequency), so blocks of a common passage are not joined on.  A class with too few non-zero blocks
   sends all, zero ones too: if neither side of a pair has enough, both do, so no pair is lost.
3. Of blocks with the same members one is enough.  In each block's group only pairs with a few of its members
   are verified on the exact sets (memory-mapped); links join classes into components.  Then, in groups of several
   components, members outside the group's largest component meet all others, some hundred by some hundred at a
   time: a pair is verified if its cores and the Hamming distance of its sketches allow a link.  Pairs inside the
   largest component need no look, so a group of thousands of copies costs a few times as many pairs as it has
   members.

A class is known by a 64-bit hash of its set; two sets of one hash (some hundred pairs among 1e11 sets) would count as
one.  Defined cases: null, empty or blank texts have an empty set, link with nothing and are their own component; a
text of fewer than five words is one shingle; rows with one set are one class whatever their ids, repeated rows
included; a null id is never a component's id unless no member has one; texts of any length are taken whole; an
empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.common import discard, free_shuffles, materialise, mix, shared_dir, slices, source_table, texts
from moundworks.llm.components import components
from moundworks.llm.repeated import SCHEMA, Repeated, merge, packed, runs, shards_for
from moundworks.llm.store import Store, put
from moundworks.llm.words import hashed_words

WIDTH = 5
ODD = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)
BASE = 4 / 3  # sizes of linked sets differ by this factor at most: 1 / 0.75


def sets(rows: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of each text, sorted and distinct, text after text; and the number of each text."""
    words, count = hashed_words(rows)
    h = np.zeros(max(len(words) - WIDTH + 1, 0), np.uint64)
    for k in range(WIDTH):
        h += words[k : k + len(h)] * ODD[k]
    h = mix(h)
    parts, starts = [], np.cumsum(count) - count
    for a, n in zip(starts.tolist(), count.tolist(), strict=True):
        part = h[a : a + n - WIDTH + 1] if n >= WIDTH else mix(np.sum(words[a : a + n] * ODD[:n], keepdims=True) + np.uint64(n))[: min(n, 1)]
        part.sort()
        parts.append(part)
    keys = np.concatenate(parts) if parts else h
    text = np.repeat(np.arange(len(rows)), [len(p) for p in parts])
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    return keys[new], np.bincount(text[new], minlength=len(rows))


def nodes_of(keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The class of each set: a hash of all its shingles; 0 for an empty one."""
    out, full = np.zeros(len(size), np.uint64), np.flatnonzero(size)
    if len(full):
        at = (np.cumsum(size) - size)[full]
        total, parity = np.add.reduceat(mix(keys), at), np.bitwise_xor.reduceat(mix(keys + np.uint64(1)), at)
        out[full] = mix(size[full].astype(np.uint64) + total * np.uint64(3) + parity)
    return out.view(np.int64)


def repeated_shingles(docs: DataFrame, folder: str) -> int:
    """Write the repeated shingles to ``folder``; returns the number of shards."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n_shards = shards_for(chars / 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from packed((sets(texts(batch.column(0)))[0] for whole in batches for batch in slices(whole, 0)), n_shards)

    merge(docs.select("text").mapInArrow(run, SCHEMA), folder, n_shards)
    return n_shards


FILE_KEYS = 4_000_000
SKETCH_BITS = 2048
CELL = 256  # members of a group that meet as many others at a time
CENTRES = 4


def put_sets(folder: str, file: int, held: list[np.ndarray]) -> None:
    """Write some sets, and one parity sketch of each over all bands."""
    size = np.array([len(k) for k in held], np.int64)
    sketch = []
    for a in range(0, len(held), 500):
        h = mix(np.concatenate(held[a : a + 500]) + np.uint64(1 << 40))
        own = size[a : a + 500]
        at = np.repeat(np.arange(len(own)), own) * SKETCH_BITS + (h % np.uint64(SKETCH_BITS)).astype(np.int64)
        odd = (np.bincount(at, minlength=len(own) * SKETCH_BITS) & 1).astype(np.uint8)
        sketch.append(np.packbits(odd).view(np.uint64).reshape(len(own), -1))
    put(folder, f"sets-{file}", keys=np.concatenate(held), sketch=np.concatenate(sketch))


def classes(docs: DataFrame, folder: str, n_shards: int) -> DataFrame:
    """doc_id, n, node, core (shingles that others may have), and where the set and its sketch lie (file, start, place) if it
    may link; a task writes a class's set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sent = Repeated(folder, n_shards), set()
        file_id, held, n_held = secrets.randbits(62), [], 0
        for whole in batches:
            for batch in slices(whole, 1):
                keys, size = sets(texts(batch.column(1)))
                ends = np.cumsum(size)
                twice = np.concatenate([[0], np.cumsum(known.contains(keys))])
                twice = twice[ends] - twice[ends - size]
                nodes = nodes_of(keys, size)
                file: list[int | None] = [None] * len(size)
                start, place = [0] * len(size), [0] * len(size)
                for r in np.flatnonzero((size > 0) & (4 * twice >= 3 * size)).tolist():
                    node = int(nodes[r])
                    if node not in sent:
                        if len(sent) > 1_000_000:
                            sent.clear()
                        sent.add(node)
                        file[r], start[r], place[r] = file_id, n_held, len(held)
                        held.append(keys[ends[r] - size[r] : ends[r]].copy())
                        n_held += int(size[r])
                if n_held >= FILE_KEYS:
                    put_sets(folder, file_id, held)
                    file_id, held, n_held = secrets.randbits(62), [], 0
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(nodes, mask=size == 0), pa.array(twice), pa.array(file, pa.int64()), pa.array(start, pa.int64()), pa.array(place, pa.int64())], names=["doc_id", "n", "node", "core", "file", "start", "place"])
        if held:
            put_sets(folder, file_id, held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n long, node long, core long, file long, start long, place long")


STORED = ("node", "n", "core", "file", "start", "place")


def stored_sets(store: Store, batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The columns (STORED, a row each) and keys (set after set) of the classes of a batch, some at a time."""
    table = np.stack([batch.column(c).to_numpy() for c in STORED])
    size, file, start = (table[STORED.index(c)].tolist() for c in ("n", "file", "start"))
    at = 0
    while at < len(size):
        end, n = at, 0
        while end < len(size) and (end == at or n + size[end] <= limit):
            n += size[end]
            end += 1
        keys = [store.get(f"sets-{file[k]}")["keys"][start[k] : start[k] + size[k]] for k in range(at, end)]
        yield table[:, at:end], np.concatenate(keys)
        at = end


def band_sizes(band: int) -> tuple[int, int]:
    """Least and greatest set size of a band."""
    return int(np.ceil(BASE**band - 1e-9)), int(np.ceil(BASE ** (band + 1) - 1e-9)) - 1


def band_of(n: int) -> int:
    band = int(np.log(n) / np.log(BASE))
    while band_sizes(band)[1] < n:
        band += 1
    while band_sizes(band)[0] > n:
        band -= 1
    return band


def bound_on_difference(n: int, band: int) -> int:
    """The most elements by which a set of n differs from one that it links with, if the smaller is in the band."""
    return n // 3 if band_of(n) == band else (n + band_sizes(band)[1]) // 7


EVERY = 2**31 - 1


@dataclass(frozen=True)
class Blocks:
    """Block keys of some sets (STORED) in one band each (``count`` of each set), and how many of a set's rarest are enough."""

    sets: np.ndarray
    enough: np.ndarray
    count: np.ndarray
    keys: np.ndarray


def block_keys(table: np.ndarray, keys: np.ndarray, below: int) -> Blocks:
    """Join keys of the sets' parity-sketch blocks in their own band, or in the band below it (1).

    A shingle toggles one of a block's 2 ** 32 bits.  The sketch is sparse, so a block is kept as the XOR of
    codes of its set bits: toggling a bit twice cancels, and blocks are equal if and only if their codes are.
    Linked sets differ in ``bound`` blocks at most (either side has its own bound), so all but ``bound`` of the
    non-zero ones are shared; in any order common to all sets, the first ``bound + 1`` of each then share one.
    """
    size = table[1]
    each = {n: band_of(n) - below for n in set(size.tolist())}
    band = np.array([each[n] for n in size.tolist()], np.int64)
    if (band < 0).any():
        there = band >= 0
        keys, table, size, band = keys[np.repeat(there, size)], table[:, there], size[there], band[there]
    bound = np.array([bound_on_difference(n, b) for n, b in zip(size.tolist(), band.tolist(), strict=True)], np.int64)
    blocks = np.array([3 * band_sizes(b)[0] + 8 for b in band.tolist()], np.int64)
    base = np.cumsum(blocks) - blocks
    of = np.repeat(np.arange(len(size)), size)
    h = mix(keys + (band[of] + 1).astype(np.uint64))
    slot = base[of].astype(np.uint64) + h % blocks[of].astype(np.uint64)
    order = np.sort(slot << np.uint64(32) | np.arange(len(keys), dtype=np.uint64))
    code = mix(h >> np.uint64(32))[(order & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    slot = (order >> np.uint64(32)).astype(np.int64)
    first = runs(slot)[0]
    sketch, slot = (np.bitwise_xor.reduceat(code, first), slot[first]) if len(first) else (code, slot)
    slot, sketch = slot[sketch != 0], sketch[sketch != 0]
    of = np.searchsorted(base, slot, side="right") - 1
    used = np.bincount(of, minlength=len(size))
    enough = bound + 1
    few = np.flatnonzero(used <= bound)
    if len(few):  # these send every block, zero ones too
        enough[few] = EVERY
        rest = ~np.isin(of, few)
        every = np.concatenate([np.arange(base[k], base[k] + blocks[k]) for k in few.tolist()])
        filled = np.zeros(len(every), np.uint64)
        filled[np.searchsorted(every, slot[~rest])] = sketch[~rest]
        slot, sketch = np.concatenate([slot[rest], every]), np.concatenate([sketch[rest], filled])
        order = np.argsort(slot)
        slot, sketch = slot[order], sketch[order]
        of = np.searchsorted(base, slot, side="right") - 1
        used = np.bincount(of, minlength=len(size))
    made = mix(mix(sketch + band[of].astype(np.uint64)) + (slot - base[of]).astype(np.uint64))
    return Blocks(table, enough, used, made)


def block_rows(kept: DataFrame, folder: str, make: Callable[[], Callable[[Iterator[Blocks]], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """What a task's ``make()`` makes of the blocks of batches of classes.

    Every class is sketched in its own band (as the smaller set) and in the band below (as the larger one).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder)
        yield from make()(block_keys(*part, below) for batch in batches for part in stored_sets(store, batch) for below in (0, 1))

    return kept.select(*STORED).mapInArrow(run, schema)


BLOCKS = ", ".join(f"{c} long" for c in ("sig", *STORED))


def signatures(kept: DataFrame, folder: str) -> DataFrame:
    """Rows of BLOCKS: each class's rarest blocks in either band, as far as they are needed and others have them.

    How many classes have a block is counted first and stored; a class then looks up its own blocks' counts.
    """
    keys = kept.agg(F.sum("n")).first()[0] or 0
    n_shards, found = shards_for(2 * keys), f"{folder}/blocks"
    merge(block_rows(kept, folder, lambda: lambda parts: packed((p.keys for p in parts), n_shards), SCHEMA), found, n_shards, counted=True)

    def rows() -> Callable[[Iterator[Blocks]], Iterator[pa.RecordBatch]]:
        known = Repeated(found, n_shards)

        def of(parts: Iterator[Blocks]) -> Iterator[pa.RecordBatch]:
            for p in parts:
                n = known.counts(p.keys)
                of = np.repeat(np.arange(len(p.count)), p.count)
                left = p.enough - np.bincount(of[n == 1], minlength=len(p.count))  # blocks of one class are the rarest and join nothing
                own = np.flatnonzero((n > 1) & (left[of] > 0))
                own = own[np.lexsort((p.keys[own], n[own], of[own]))]
                first, size = runs(of[own])
                own = own[np.arange(len(own)) - np.repeat(first, size) < left[of[own]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (p.keys[own].view(np.int64), *p.sets[:, of[own]])], names=["sig", *STORED])

        return of

    return block_rows(kept, folder, rows, BLOCKS)


def verify(pairs: DataFrame, where: DataFrame, folder: str) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity is 0.75 or more."""
    side = lambda s: where.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("file").alias(f"f{s}"), F.col("start").alias(f"s{s}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store(folder, 500)
        for rows in batches:
            at = zip(*(rows[c].tolist() for c in ("fa", "sa", "na", "fb", "sb", "nb")), strict=True)
            linked = [_linked(store.get(f"sets-{fa}")["keys"][sa : sa + na], store.get(f"sets-{fb}")["keys"][sb : sb + nb]) for fa, sa, na, fb, sb, nb in at]
            yield rows.loc[np.array(linked, bool), ["a", "b"]] if len(rows) else rows[["a", "b"]]

    return full.mapInPandas(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if len(x) > len(y):
        x, y = y, x
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    same = int(np.count_nonzero(y[at] == x))
    return 4 * same >= 3 * (len(x) + len(y) - same)


def block_groups(kept: DataFrame, folder: str) -> DataFrame:
    """sig, the columns STORED and small of the blocks that several classes share; of blocks with the same members only one stays.

    Sets of sizes a and b that link share 3 / 7 of a + b, all of it core.  So a set whose core is under 6 / 7 of it
    links with smaller sets only (small is false), and a block without a small member has no pair to offer.
    """
    rows = materialise(signatures(kept, folder).withColumn("small", F.col("core") * 7 >= F.col("n") * 6), "blocks", folder)
    members = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")
    groups = rows.groupBy("sig").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("size"), F.max("small").alias("any"), members).where("least < most AND any")
    one = groups.groupBy("least", "most", "size", "members").agg(F.min("sig").alias("sig")).select("sig")
    return materialise(rows.join(one, "sig"), "groups", folder)


def star_pairs(groups: DataFrame) -> DataFrame:
    """Pairs of each group's members with a few centres.

    A member whose blocks are shared most is the likeliest to link with the others (among edited copies of a
    text, the least edited one); the other centres are the best of three random halves of the group.
    """
    sizes = groups.groupBy("sig").agg(F.count("*").alias("size"))
    scores = groups.join(sizes, "sig").groupBy("node").agg(F.sum("size").alias("score"))
    scored = groups.join(scores, "node")
    inside = lambda k: F.lit(True) if k == 0 else F.pmod(F.xxhash64("node", F.lit(k)), F.lit(2)) == 0
    centres = [F.max(F.struct(F.when(inside(k), F.col("score")).otherwise(0).alias("s"), F.col("node"))).alias(f"c{k}") for k in range(CENTRES)]
    chosen = scored.groupBy("sig").agg(*centres).select("sig", *[F.col(f"c{k}.node").alias(f"c{k}") for k in range(CENTRES)])
    pairs = groups.join(chosen, "sig").select("node", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(CENTRES)]))).alias("c")).where("node <> c")
    return pairs.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def cross_links(groups: DataFrame, joined: DataFrame, folder: str) -> DataFrame:
    """Links (a, b) between members of one group that are in different components.

    Members outside a group's largest component are dealt into cells of CELL and meet all its members, cell by cell, so a
    task never holds more of a group than two cells.
    """
    rooted = groups.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = rooted.groupBy("sig", "root").agg(F.count("*").alias("own")).groupBy("sig").agg(F.sum("own").alias("size"), F.max(F.struct("own", "root")).alias("top"))
    parts = parts.where(F.col("size") > F.col("top.own")).select("sig", F.col("top.root").alias("top"), *[F.ceil(c / CELL).cast("int").alias(n) for c, n in ((F.col("size"), "cells"), (F.col("size") - F.col("top.own"), "lone_cells"))])
    mixed = rooted.join(parts, "sig").withColumn("lone", F.col("root") != F.col("top"))
    own = lambda n: F.pmod(F.xxhash64("node", "sig"), F.col(n)).cast("int")
    cells = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = [*STORED, "small", "root", "lone"]
    asked = mixed.where("lone").select("sig", own("lone_cells").alias("i"), cells("cells").alias("j"), *columns, F.lit(True).alias("asks"))
    there = mixed.select("sig", cells("lone_cells").alias("i"), own("cells").alias("j"), *columns, F.lit(False).alias("asks"))
    met = asked.unionByName(there).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Store(folder, 500)
        for cell in cells_of(batches):
            a, b = ({c: v[cell["asks"] == s] for c, v in cell.items()} for s in (True, False))
            links = near_pairs(a, b, store)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long").distinct()


def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of one (sig, i, j) after another, from batches in which they follow each other."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        rows = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns, strict=True)}
        if not batch.num_rows:
            continue
        if held and any(held[0][c][0] != rows[c][0] for c in ("sig", "i", "j")):
            yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held = []
        new = np.zeros(batch.num_rows, bool)
        for c in ("sig", "i", "j"):
            new[1:] |= rows[c][1:] != rows[c][:-1]
        edges = np.flatnonzero(new).tolist()
        for a, e in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            held.append({c: v[a:e] for c, v in rows.items()})
            if e < batch.num_rows:
                yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                held = []
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def near_pairs(a: dict[str, np.ndarray], b: dict[str, np.ndarray], store: Store) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (lesser node, greater node) of members of two cells in different components."""
    both = lambda c: (a[c][:, None], b[c][None, :])
    (na, nb), (ca, cb), (ra, rb), (ia, ib) = both("n"), both("core"), both("root"), both("node")
    may = (ra != rb) & (~b["lone"][None, :] | (ia < ib)) & (4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb))
    may &= (7 * np.minimum(ca, cb) >= 3 * (na + nb)) & np.where(na < nb, a["small"][:, None], np.where(na > nb, b["small"][None, :], True))
    x, y = np.nonzero(may)
    sketch = lambda s, at: np.stack([store.get(f"sets-{f}")["sketch"][p] for f, p in zip(s["file"][at].tolist(), s["place"][at].tolist(), strict=True)])
    if len(x):
        used_x, used_y = np.unique(x), np.unique(y)
        left, right = sketch(a, used_x), sketch(b, used_y)
        at_x, at_y = np.searchsorted(used_x, x), np.searchsorted(used_y, y)
        near = np.zeros(len(x), bool)
        for k in range(0, len(x), 20_000):
            apart = np.bitwise_count(left[at_x[k : k + 20_000]] ^ right[at_y[k : k + 20_000]]).sum(axis=1, dtype=np.int64)
            near[k : k + 20_000] = 7 * apart <= a["n"][x[k : k + 20_000]] + b["n"][y[k : k + 20_000]]
        x, y = x[near], y[near]
    keys = lambda s, k: store.get(f"sets-{s['file'][k]}")["keys"][s["start"][k] : s["start"][k] + s["n"][k]]
    linked = np.array([_linked(keys(a, i), keys(b, j)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], bool)
    first, second = a["node"][x[linked]], b["node"][y[linked]]
    return np.minimum(first, second), np.maximum(first, second)


def contracted(joined: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """node, root after some more links between the components of ``joined``."""
    root = lambda s: joined.select(F.col("node").alias(s), F.col("root").alias(f"r{s}"))
    between = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = materialise(components(between, folder), "merged", folder)
    new = merged.withColumnRenamed("node", "old").withColumnRenamed("root", "new")
    moved = joined.join(new, joined["root"] == new["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    return moved.unionByName(merged.join(joined.select("node"), "node", "left_anti"))  # classes that were alone before


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (class; null for an empty set), component_id: one row per row of docs."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "near-dup")  # what only the steps below need
    n_shards = repeated_shingles(docs, folder)
    free_shuffles(spark)
    rows = materialise(classes(docs, folder, n_shards), "classes")
    place = F.min(F.struct(*STORED[1:])).alias("p")
    kept = materialise(rows.where("file IS NOT NULL").groupBy("node").agg(place).select("node", "p.*").repartition(n_shards, "node"), "kept", folder)
    groups = block_groups(kept, folder)
    free_shuffles(spark)
    first = materialise(verify(star_pairs(groups), kept, folder), "links", folder)
    joined = materialise(components(first, folder), "joined", folder)
    second = materialise(cross_links(groups, joined, folder), "links", folder)
    roots = materialise(joined if second.isEmpty() else contracted(joined, second, folder), "roots")
    discard(spark, folder)
    free_shuffles(spark)
    return placed_rows(rows.select("doc_id", "n", "node"), roots)


SALTS = 64


def placed_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, component_id of rows (doc_id, n, node).

    Least ids are found per class and salt, then per class and per component, and go back to rows by class and salt:
    neither a large class nor the empty sets land in one task.
    """
    key = F.coalesce("node", F.xxhash64("doc_id"))
    rows = rows.withColumns({"_key": key, "_salt": F.when(F.col("node").isNull(), SALTS).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))})
    parts = rows.where("node IS NOT NULL").groupBy("_key", "_salt").agg(F.min("doc_id").alias("least"))
    each = parts.groupBy("_key").agg(F.min("least").alias("least")).join(roots.withColumnRenamed("node", "_key"), "_key", "left")
    each = each.withColumn("root", F.coalesce("root", "_key"))
    whole = each.groupBy("root").agg(F.min("least").alias("component_id"))
    known = parts.select("_key", "_salt").join(each.join(whole, "root").select("_key", "component_id"), "_key")
    found = rows.join(known, ["_key", "_salt"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), "node", F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source_table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS shingle
  FROM (SELECT doc_id, w, UNNEST(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2
  ) p JOIN n u ON p.a = u.doc_id JOIN n v ON p.b = v.doc_id WHERE 100 * shared >= 75 * (u.n + v.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id
"""


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest id; rows that repeat an id and text become one, the
    first by the JSON of their other columns; rows without an id stay where no linked document has an id."""
    found = jaccard_components(docs)
    keep = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("_keep")).distinct()
    left = docs.join(keep, docs["doc_id"].eqNullSafe(keep["_keep"]), "left_semi")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if not rest:
        return left.distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    one = left.groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return one.select(*[F.col(c if c in ("doc_id", "text") else f"row.`{c}`").alias(c) for c in docs.columns])
