"""Source divergence audit: how the sources of a language differ in their terms, by chunk factorization.

Most of a corpus' white-space chunks occur again and again, so texts are not tokenized; their chunks are:

1. Documents are cut into slices of some megabytes.  A slice keeps, per document, the numbers and counts of its chunks, and
   the list of its distinct chunks (A-Z lower-cased): a sparse matrix and its dictionary.
2. The dictionaries are dealt by chunk, so that all slices' copies of a chunk meet in one part, and there each distinct chunk
   is cut into terms once.  The number of parts follows that of the chunks (``PART`` of them a part).
3. Terms go back to their slice, and each slice turns its matrix into documents and occurrences per (lang, source, term);
   these are dealt by term and summed over slices.  A document lies in one slice, so it counts once.

What crosses the network is packed rows of a slice's chunks, and later terms, that belong to a part: each once per slice, not
per word or document.  No group grows with the corpus's words: a slice is bounded by bytes, a part by ``PART`` chunks and,
for each, an entry per slice (terms: per slice and source).  Chunks are matched as strings between slices and by 64-bit hashes within one.

Divergences are exact integers.  For two sources of a language the sum over all kept terms is split: terms that both have
are counted by their pair of counts, those of one source by their count, against the other's smallest p, and terms that
neither has are one number.  Pairs of sources are made where a term's sources already lie together; they are those of
the result.

Defined cases: null text, lang and source are ''; a group without terms has count 0 for each kept term; with no kept term a
divergence is 0; empty tables give no rows; repeated rows are documents of their own; texts are taken whole, whatever
their length, and a chunk without white space is kept whole; ties in value go by item in UTF-8 order; further columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from moundworks.llm.common import bucket, discard, materialise, shared_dir, slices, source_table, texts
from moundworks.llm.words import SPACED, located_words, numbered, strings

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, RANKS, SCALE = 3, 200, 1_000_000_000
SLICE = 16 << 20
SALTS = 16
SLICES = "slice long, langs array<string>, sources array<string>, group_of binary, entries binary, ids binary, more binary, n_chunks long, chunks array<string>"
PART = 1 << 20  # chunks of all slices that one task cuts into terms
#: A-Z lower-cased, all that is not of a term as a space (for ``bytes.translate``).
TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: bytes, most: int) -> Iterator[bytes]:
    """A text, cut at white space where it is longer than so many bytes."""
    start = 0
    while len(text) - start > most:
        end = max(text.rfind(c, start + 1, start + most) for c in (b" ", b"\n"))
        if end < 0:  # a very long chunk: up to the next white space
            found = [p for p in (text.find(c, start + most) for c in (b" ", b"\n")) if p >= 0]
            if not found:
                break
            end = min(found)
        yield text[start:end]
        start = end
    yield text[start:]


class Matrix:
    """Chunk counts of the documents of one slice."""

    def __init__(self) -> None:
        self.docs, self.hashes, self.counts, self.words, self.marks = [], [], [], [], []

    def add(self, first: int, rows: list[bytes]) -> None:
        """Counts of texts, or a piece of one, numbered from first."""
        hashes, n, text, starts, size = located_words(rows, SPACED)
        codes, at = numbered(hashes)
        keys, counts = np.unique(np.repeat(np.arange(len(rows)), n) * max(len(at), 1) + codes, return_counts=True)
        self.docs.append(keys // max(len(at), 1) + first)
        self.hashes.append(hashes[at][keys % max(len(at), 1)])
        self.counts.append(counts)
        self.words.append(strings(text, starts[at], size[at]))
        self.marks.append(hashes[at])

    def arrays(self, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Per document its number of entries; per entry its chunk's place (rising within a document) and count; the chunks by
        hash."""
        docs, counts, marks, hashes = (np.concatenate(x) for x in (self.docs, self.counts, self.marks, self.hashes))
        known, first = np.unique(marks, return_index=True)
        keys = docs * max(len(known), 1) + np.searchsorted(known, hashes)
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        if len(self.docs) > 1 and len(keys):  # a document may have come in pieces
            start = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, counts = keys[start], np.add.reduceat(counts, start)
        return np.bincount(keys // max(len(known), 1), minlength=n_docs), keys % max(len(known), 1), counts, pa.concat_arrays(self.words).take(pa.array(first))


def deflated(values: np.ndarray) -> bytes:
    """Numbers below 2 ** 28 in as many bytes as each needs, seven bits a byte."""
    values = values.astype(np.int64)
    size = 1 + sum((values >= 1 << (7 * k)).astype(np.int64) for k in (1, 2, 3))
    at, out = np.cumsum(size) - size, np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        some = np.flatnonzero(size > k)
        out[at[some] + k] = (values[some] >> (7 * k)) & 127 | np.where(size[some] > k + 1, 128, 0)
    return out.tobytes()


def inflated(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    for k in range(4):
        some = np.flatnonzero(last - first >= k)
        out[some] |= (raw[first[some] + k] & 127).astype(np.int64) << (7 * k)
    return out


def steps(ids: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Each place less the one before it in the same document."""
    out = np.diff(ids, prepend=0)
    start = (np.cumsum(entries) - entries)[entries > 0]
    out[start] = ids[start]
    return out


def places(steps: np.ndarray, entries: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(steps)])
    return total[1:] - np.repeat(total[np.cumsum(entries) - entries], entries)


def factored(docs: DataFrame, size: int, folder: str) -> DataFrame:
    """The slices (``SLICES``) of documents, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            for part in slices(whole, 2, size):
                made, given = Matrix(), [t or b"" for t in texts(part.column(2))]
                if len(given) > 1 or len(given[0]) <= size:
                    made.add(0, given)
                else:
                    for piece in pieces(given[0], size):
                        made.add(0, [piece])
                entries, ids, counts, words = made.arrays(len(given))
                groups: dict[tuple[str, str], int] = {}
                of = np.array([groups.setdefault(g, len(groups)) for g in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], np.int32)
                many = np.flatnonzero(counts > 1)
                more = np.stack([many, counts[many]], axis=1).astype(np.int64).tobytes()  # most counts are 1
                binary = [pa.array([x], pa.binary()) for x in (deflated(of), deflated(entries), deflated(steps(ids, entries)), more)]
                chunks = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)
                named = [pa.array([[g[k] for g in groups]], pa.list_(pa.string())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([number]), *named, *binary, pa.array([len(words)]), chunks], names)
                number += 1

    names = [c.split()[0] for c in SLICES.split(", ")]
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return materialise(docs.select(text("lang"), text("source"), text("text")).mapInArrow(run, SLICES), "slices", folder, compression="zstd")


def by_part(slices: DataFrame, parts: int) -> DataFrame:
    """part, slice, first, chunks: each slice's dictionary, which is in the order of hashes, cut by ranges of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = located_words([b" ".join(words.values.cast(pa.binary()).to_pylist())], SPACED)[0]
                found, start = np.unique(part_of(hashes, parts), return_index=True)
                lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(hashes)), pa.int32()), words.values)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([number] * len(found), pa.int64()), pa.array(start, pa.int32()), lists], ["part", "slice", "first", "chunks"])

    return slices.select("slice", "chunks").mapInArrow(run, "part long, slice long, first int, chunks array<string>")


def cut(rows: pa.Table) -> pa.Table:
    """slice, first, per, terms: of the chunks of one part, each distinct one cut once, the number of terms and the terms in order."""
    chunks = rows.column("chunks").combine_chunks()
    lengths, flat = chunks.value_lengths().to_numpy(), chunks.flatten().dictionary_encode()
    _, n, text, starts, size = located_words(flat.dictionary.cast(pa.binary()).to_pylist(), TERMS)
    terms, first = strings(text, starts, size), np.cumsum(n) - n
    of = flat.indices.to_numpy().astype(np.int64)
    per = n[of]
    own = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    listed = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
    columns = [*(rows.column(c).combine_chunks() for c in ("slice", "first")), listed(ends, pa.array(per, pa.int32())), listed(np.concatenate([[0], np.cumsum(per)])[ends], terms.take(pa.array(np.repeat(first[of], per) + own)))]
    return pa.Table.from_arrays(columns, ["slice", "first", "per", "terms"])


def slice_counts(matrix: pa.Table, found: pa.Table, parts: int) -> pa.Table:
    """Terms of one slice, dealt by their hash (``COUNTS``, a row per part), from its matrix (one row) and its chunks' terms."""
    if not matrix.num_rows or not found.num_rows:
        return COUNTS.empty_table()
    row = {c: matrix.column(c)[0].as_py() for c in matrix.column_names if c != "own"}
    group_of, entries = inflated(row["group_of"]), inflated(row["entries"])
    ids = places(inflated(row["ids"]), entries)
    counts, more = np.ones(len(ids), np.int64), np.frombuffer(row["more"], np.int64).reshape(-1, 2)
    counts[more[:, 0]] = more[:, 1]
    found = found.take(pa.array(np.argsort(found.column("first").to_numpy())))  # so that chunks come in their order
    per, terms = found.column("per").combine_chunks().flatten().to_numpy().astype(np.int64), found.column("terms").combine_chunks().flatten().dictionary_encode()
    start, times = np.cumsum(per) - per, per[ids]
    own = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    term = terms.indices.to_numpy()[np.repeat(start[ids], times) + own]
    doc = np.repeat(np.repeat(np.arange(len(entries)), entries), times)
    each = pa.table({"doc": doc, "term": term, "n": np.repeat(counts, times)}).group_by(["doc", "term"], use_threads=False).aggregate([("n", "sum")])
    whole = pa.table({"group": group_of[each.column("doc").to_numpy()], "term": each.column("term"), "n": each.column("n_sum")})
    whole = whole.group_by(["group", "term"], use_threads=False).aggregate([("n", "count"), ("n", "sum")])
    group, term, docs, n = (whole.column(c).to_numpy() for c in ("group", "term", "n_count", "n_sum"))
    part = part_of(located_words([b" ".join(terms.dictionary.cast(pa.binary()).to_pylist())], SPACED)[0], parts)[term]
    order = np.lexsort((group, term, part))
    part, group, term = part[order], group[order], term[order]
    start = np.flatnonzero(np.diff(part, prepend=-1))
    pairs, local = np.unique(part * len(row["langs"]) + group, return_inverse=True)  # each part's own groups
    own = np.searchsorted(pairs // len(row["langs"]), part[start])
    named = [pa.array(row[c], pa.string()).take(pa.array(pairs % len(row["langs"]))) for c in ("langs", "sources")]
    of = local - np.repeat(own, np.diff(np.append(start, len(part))))
    cut_at = lambda at, n, values: pa.ListArray.from_arrays(pa.array(np.append(at, n), pa.int32()), values)
    values = [pa.array(of, pa.int32()), terms.dictionary.take(pa.array(term)), pa.array(docs[order]), pa.array(n[order])]
    return pa.Table.from_arrays([pa.array(part[start]), *(cut_at(own, len(pairs), x) for x in named), *(cut_at(start, len(part), x) for x in values)], schema=COUNTS)


COUNTS = pa.schema([("part", pa.int64()), ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("group", pa.list_(pa.int32())), ("term", pa.list_(pa.string())), ("docs", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
ENTRY = pa.struct([("source", pa.string()), ("n", pa.int64())])


def summed(rows: pa.Table, least: int) -> pa.Table:
    """lang, term, whole, by: all slices' counts of the terms of one part, without those in too few documents."""
    lists = {c: rows.column(c).combine_chunks() for c in rows.column_names if c != "part"}
    flat = {c: x.flatten() for c, x in lists.items()}
    sizes = lists["langs"].value_lengths().to_numpy().astype(np.int64)
    group = flat["group"].to_numpy() + np.repeat(np.cumsum(sizes) - sizes, lists["group"].value_lengths().to_numpy())
    langs, sources, terms = (flat[c].dictionary_encode() for c in ("langs", "sources", "term"))
    each = pa.table({"lang": langs.indices.to_numpy()[group], "source": sources.indices.to_numpy()[group], "term": terms.indices, "docs": flat["docs"], "n": flat["n"]})
    each = each.group_by(["lang", "term", "source"], use_threads=False).aggregate([("docs", "sum"), ("n", "sum")])
    lang, term, source, docs, n = (each.column(c).to_numpy().astype(np.int64) for c in ("lang", "term", "source", "docs_sum", "n_sum"))
    key, size = lang * max(len(terms.dictionary), 1) + term, max(len(terms.dictionary), 1)
    order = np.argsort(key, kind="stable")
    key, source, docs, n = key[order], source[order], docs[order], n[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    total, whole = (np.add.reduceat(x, start) if len(x) else x for x in (docs, n))
    good = total >= least
    lengths = np.diff(np.append(start, len(key)))
    inside = np.repeat(good, lengths)
    entry = pa.StructArray.from_arrays([sources.dictionary.take(pa.array(source[inside])), pa.array(n[inside])], fields=list(ENTRY))
    by = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths[good])]), pa.int32()), entry)
    return pa.table({"lang": langs.dictionary.take(pa.array(key[start][good] // size)), "term": terms.dictionary.take(pa.array(key[start][good] % size)), "whole": whole[good], "by": by})


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The range, of so many, that a hash lies in."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS, size: int = SLICE, part: int = PART) -> DataFrame:
    """lang, term, whole (its occurrences) and by (source, n) of the terms in enough documents of their language; in the
    shared folder."""
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "audit")
    made = factored(docs, size, folder)
    n_chunks = made.agg(F.sum("n_chunks")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_chunks // part))
    back = by_part(made, parts).groupBy("part").applyInArrow(cut, "slice long, first int, per array<int>, terms array<string>")  # a chunk has a row per slice at most
    matrix = made.select(F.col("slice").alias("own"), *[c for c in made.columns if c not in ("slice", "chunks", "n_chunks")])
    counts = lambda matrix, found: slice_counts(matrix, found, parts)
    each = matrix.groupBy("own").cogroup(back.groupBy("slice")).applyInArrow(counts, "part long, langs array<string>, sources array<string>, group array<int>, term array<string>, docs array<long>, n array<long>")  # a group is a slice
    whole = each.groupBy("part").applyInArrow(lambda rows: summed(rows, least), "lang string, term string, whole long, by array<struct<source: string, n: long>>")
    kept = materialise(whole, "kept")
    discard(spark, folder)
    return kept


def div(a: Column, b: Column) -> Column:
    """Whole-number division of what is not negative."""
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """The smoothed share in billionths, from 1; total is N + V.  Decimals where count * 10^9 would pass a long."""
    small = div((count + 1) * F.lit(SCALE).cast("long"), total)
    return F.lit(1) + F.when(count < 9 * SCALE, small).otherwise(div((count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total))


def divergence(p: Column, q: Column) -> Column:
    return div((p - q) * (p - q), q)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every (lang, source) with V, N + V of it and of its language, and p0, its p of a kept term without occurrences; in the
    shared folder."""
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("whole").alias("lang_n"))
    by_group = entries(kept).groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = docs.select(text("lang"), text("source")).distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["v", "lang_n", "group_n"])
    total = F.nullif(F.col("group_n") + F.col("v"), F.lit(0))
    return materialise(groups.select("lang", "source", "v", total.alias("total"), (F.col("lang_n") + F.col("v")).alias("lang_total"), share(F.lit(0).cast("long"), total).alias("p0")), "groups")


def entries(kept: DataFrame) -> DataFrame:
    """lang, term, whole, source, n."""
    return kept.select("lang", "term", "whole", F.explode("by").alias("e")).select("lang", "term", "whole", "e.source", "e.n")


def source_pairs(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, item (another source), value: the divergence of source from item over all kept terms."""
    side = lambda s: groups.select("lang", F.col("source").alias(s), F.col("total").alias(f"{s}_total"), F.col("p0").alias(f"{s}0"))
    f, c = divergence, F.col
    a, b = side("a"), side("b")
    none = a.join(b, "lang").where("a <> b").join(groups.groupBy("lang").agg(F.max("v").alias("v")), "lang")
    none = none.select("lang", c("a").alias("source"), c("b").alias("item"), (c("v") * F.coalesce(f(c("a0"), c("b0")), F.lit(0))).alias("value"))
    # terms of one source: as if no other had them; equal counts are one
    alone = entries(kept).groupBy("lang", c("source").alias("a"), c("n").alias("na")).agg(F.count("*").alias("m"))
    alone = alone.join(a, ["lang", "a"]).join(b, "lang").where("a <> b").withColumn("pa", share(c("na"), c("a_total")))
    alone = alone.groupBy("lang", "a", "b").agg(F.sum(c("m") * (f(c("pa"), c("b0")) - f(c("a0"), c("b0")))).alias("ab"), F.sum(c("m") * (f(c("b0"), c("pa")) - f(c("b0"), c("a0")))).alias("ba"))
    # terms of two sources: what they have beyond that; equal pairs of counts are one
    beyond = lambda x, y: f(c(f"p{x}"), c(f"p{y}")) - f(c(f"p{x}"), c(f"{y}0")) - f(c(f"{x}0"), c(f"p{y}")) + f(c(f"{x}0"), c(f"{y}0"))
    two = kept.where(F.size("by") > 1).select("lang", "by", F.explode("by").alias("x")).select("lang", "x", F.explode("by").alias("y")).where("x.source < y.source")
    two = two.groupBy("lang", c("x.source").alias("a"), c("y.source").alias("b"), c("x.n").alias("na"), c("y.n").alias("nb")).agg(F.count("*").alias("m"))
    two = two.join(a, ["lang", "a"]).join(b, ["lang", "b"]).withColumns({"pa": share(c("na"), c("a_total")), "pb": share(c("nb"), c("b_total"))})
    two = two.groupBy("lang", "a", "b").agg(F.sum(c("m") * beyond("a", "b")).alias("ab"), F.sum(c("m") * beyond("b", "a")).alias("ba"))
    ways = F.explode(F.array(F.struct(c("a").alias("source"), c("b").alias("item"), c("ab").alias("value")), F.struct(c("b").alias("source"), c("a").alias("item"), c("ba").alias("value")))).alias("x")
    turned = [x.select("lang", ways).select("lang", "x.*") for x in (alone, two)]
    return none.unionByName(turned[0]).unionByName(turned[1]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def top_terms(groups: DataFrame, kept: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, item, value of the terms that a source has more of than its language, the most telling ones first."""
    known = entries(kept).join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("total")), "q": share(F.col("whole"), F.col("lang_total"))})
    rows = known.where("p > q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"), bucket(F.col("term"), SALTS).alias("_salt"))
    order = (F.desc("value"), F.asc("item"))
    first = rows.withColumn("_r", F.row_number().over(W.partitionBy("lang", "source", "_salt").orderBy(*order))).where(F.col("_r") <= ranks)
    return first.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= ranks).drop("_r", "_salt")


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS, size: int = SLICE) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank: each source against the other sources of its language, and
    its most telling terms."""
    kept = kept_terms(docs, least, size)
    groups = group_sizes(docs, kept)
    pairs = source_pairs(groups, kept)
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))  # a row per source
    columns = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(top_terms(groups, kept, ranks), "term"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(source_table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms
  FROM documents
), words AS (SELECT k, lang, source, UNNEST(terms) AS term FROM d
), whole AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT k) >= 3
), sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM whole GROUP BY lang
), occurring AS (SELECT DISTINCT lang, source FROM d
), counted AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN whole ON w.lang = whole.lang AND w.term = whole.term GROUP BY w.lang, w.source, w.term
), dense AS (
  SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, t.n AS whole_n, s.v, s.n AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS group_n
  FROM occurring g JOIN whole t ON g.lang = t.lang JOIN sizes s ON s.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term
), shares AS (
  SELECT lang, source, term, n, 1 + (CAST(n + 1 AS HUGEINT) * 1000000000) // (group_n + v) AS p, 1 + (CAST(whole_n + 1 AS HUGEINT) * 1000000000) // (lang_n + v) AS q FROM dense
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0) AS BIGINT) AS value
  FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
), terms AS (
  SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
