"""Token counts: a cache of counts by content and tokenizer digest.

Every text is brought to a normal form and known by the form's SHA-256.  Digests join the counts that the cache holds for
this version of the tokenizer; texts of digests that it does not hold are encoded, each distinct one once, and appended.  A
version is the digest of the tokenizer's file, the library's release and the normal form.

Two texts share a digest only if the library must give them as many tokens.  For a tokenizer that drops white space and
lower-cases (as its file says) the form closes up ASCII white space and lower-cases A-Z; the latter is left out where the
text is not in Unicode's composed form before and after (a mark may compose with a letter in one case only) or holds ``<|``
(special strings are matched as they are written).  For every other tokenizer the form is the text itself.  Where white space is dropped no
token crosses it, so a text's count is the sum over its white-space chunks: a task encodes each chunk once (chunks are
known by 64-bit hashes within a task), which also bounds what a very long text takes; a worker remembers its last chunks (``MEMO``).

Texts are never joined row by row: digests (32 bytes) are.  One shuffle carries texts, those to be encoded, each once per
task that has it; while few digests are missing (``FEW``) they are broadcast and only their texts move.  A hot digest is one
row after the first aggregation; the last join, rows against counts, is a plain equi-join that adaptive execution splits.

The cache is a Parquet folder partitioned by tokenizer version; appends of overlapping runs may repeat a digest, so it is
read by distinct digest.  Workers read the tokenizer from their own path and compare its version: another file is an error.

Defined cases: a null text is empty and has no tokens; an empty table gives no rows and appends nothing; repeated rows
are counted row by row and encoded once; a chunk without white space is encoded whole, at some hundred bytes a byte; of
the input's columns all but ``text`` pass through, those named like an output column (``OUT``) are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from importlib.metadata import version as release

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundworks.llm.common import materialise, shared_dir, slices, source_table, texts
from moundworks.llm.words import located_words, numbered, strings

FORM = "1"  # of the normal form: raise it when what ``normal`` gives changes
LIMIT = 2048
FEW = 100_000  # digests of 32 bytes: some 6 MB as a broadcast table
MEMO = 4 << 20  # chunks whose counts a worker remembers, at 16 bytes
SLICE = 8 << 20
OUT = ("n_bytes", "n_tokens", "digest")
CACHE = "digest binary, n_tokens long, tokenizer string"
#: Tables for ``bytes.translate``: A-Z lower-cased; white space as spaces.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANKS = bytes(32 if c in b"\t\n\r\x0b\x0c" else c for c in range(256))


def path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed vocabulary file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def library(file: str) -> str:
    return "sentencepiece" if file.endswith(".model") else "tokenizers"


def version(file: str) -> str:
    """What counts depend on beside the text, as one digest."""
    with open(file, "rb") as source:
        held = hashlib.sha256(source.read())
    held.update(f"|{library(file)}|{release(library(file))}|{FORM}".encode())
    return held.hexdigest()


def folds(file: str) -> bool:
    """Whether the tokenizer lower-cases and drops white space, so that neither changes a count."""
    if library(file) != "tokenizers":
        return False
    with open(file, encoding="utf-8") as source:
        made = json.load(source)
    steps = lambda part, key: [] if part is None else part[key] if part["type"] == "Sequence" else [part]
    before = [s["type"] for s in steps(made["normalizer"], "normalizers")]
    first = (steps(made["pre_tokenizer"], "pretokenizers") or [{"type": ""}])[0]
    removes = first["type"] == "Split" and first["invert"] and first["behavior"] == "Removed" and r"[^\s" in first["pattern"].get("Regex", "")
    return removes and before == ["NFC", "Replace", "Lowercase"] and not made["post_processor"]


def normal(text: bytes | None, fold: bool) -> bytes:
    """The text, null as empty, in the form whose digest stands for it."""
    if not fold or not text:
        return text or b""
    closed = b" ".join(text.split())
    lower = closed.translate(LOWER)
    if b"<|" in closed or not closed.isascii() and not all(unicodedata.is_normalized("NFC", x.decode()) for x in (closed, lower)):
        return closed
    return lower


def with_digests(rows: DataFrame, fold: bool, keep: bool) -> DataFrame:
    """The columns of rows (text among them, to be left out or kept in normal form), n_bytes and digest."""
    names = [c for c in rows.columns if keep or c != "text"]
    at, places = rows.columns.index("text"), [rows.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, at, SLICE):
                given = texts(part.column(at))
                forms = [normal(t, fold) for t in given]
                columns = [pa.array(forms, pa.binary()).cast(pa.string()) if k == at else part.column(k) for k in places]
                made = [pa.array([len(t or b"") for t in given], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in forms], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, *made], [*names, "n_bytes", "digest"])

    kept = [rows.schema[c] if c != "text" else T.StructField("text", T.StringType()) for c in names]
    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("digest", T.BinaryType())]))


def encoder(file: str) -> Callable[[list[str]], list[int]]:
    """Numbers of tokens of some texts, without begin, end or added special tokens."""
    if library(file) == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        return lambda some: [len(ids) for ids in model.encode(some, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(file)
    model.no_truncation()
    model.no_padding()
    return lambda some: [len(found) for found in model.encode_batch_fast(some, add_special_tokens=False)]


class Chunks:
    """Counts texts by their white-space chunks; each distinct chunk is encoded once, the last ones are remembered."""

    def __init__(self, encode: Callable[[list[str]], list[int]]) -> None:
        self.encode, self.keys, self.counts = encode, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def __call__(self, rows: list[bytes]) -> np.ndarray:
        hashes, n_chunks, text, starts, size = located_words(rows, BLANKS)
        codes, first = numbered(hashes)
        order = np.argsort(hashes[first])
        inverse = np.argsort(order)[codes]  # into the sorted distinct hashes
        first = first[order]
        distinct = hashes[first]
        found, there, place = self._known(distinct)
        new = np.flatnonzero(~there)
        for k in range(0, len(new), 10_000):
            some = first[new[k : k + 10_000]]
            found[new[k : k + 10_000]] = self.encode(strings(text, starts[some], size[some]).to_pylist())
        if len(self.keys) + len(new) > MEMO:
            self.keys, self.counts = distinct, found
        else:
            self.keys, self.counts = np.insert(self.keys, place[new], distinct[new]), np.insert(self.counts, place[new], found[new])
        ends = np.cumsum(n_chunks)
        total = np.concatenate([[0], np.cumsum(found[inverse])])
        return total[ends] - total[ends - n_chunks]

    def _known(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, which of them are known, and where each key stands or belongs."""
        place = np.searchsorted(self.keys, keys)
        found, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        if len(self.keys):
            at = np.minimum(place, len(self.keys) - 1)
            there = self.keys[at] == keys
            found[there] = self.counts[at[there]]
        return found, there, place


_counters: dict[str, Chunks] = {}  # of this worker, by tokenizer version


def counted(rows: DataFrame, file: str) -> DataFrame:
    """digest and n_tokens of rows of digest and text."""
    wanted, chunked = version(file), folds(file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version(file) != wanted:
            raise ValueError(f"{file} on this worker is another tokenizer than the driver's")
        if chunked:
            count = _counters.get(wanted) or _counters.setdefault(wanted, Chunks(encoder(file)))
        else:
            encode = encoder(file)
            count = lambda some: np.array(encode([t.decode() for t in some]), np.int64)
        for whole in batches:
            for part in slices(whole, 1, SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count([t or b"" for t in texts(part.column(1))]), pa.int64())], ["digest", "n_tokens"])

    return rows.select("digest", "text").mapInArrow(run, "digest binary, n_tokens long")


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """digest and n_tokens that the cache holds for a tokenizer version, once each."""
    try:
        rows = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, file: str | None = None, cache: str | None = None, few: int = FEW) -> DataFrame:
    """docs without text, with n_bytes (UTF-8), digest (of the normal form) and n_tokens.

    cache: a shared folder that lives on between runs; without one each call starts with an empty cache.
    """
    spark, file = docs.sparkSession, file or path()
    cache, tokenizer, fold = cache or shared_dir(spark, "token-cache"), version(file), folds(file)
    kept = F.struct(*[c for c in docs.columns if c not in (*OUT, "text")], F.lit(0).alias("_"))
    keyed = materialise(with_digests(docs.select(kept.alias("_row"), "text"), fold, False), "digests")
    known = stored(spark, cache, tokenizer)
    missing = materialise(keyed.select("digest").distinct().join(known.select("digest"), "digest", "left_anti"), "missing")
    n_missing = missing.count()
    if n_missing:
        rows = with_digests(docs.select("text"), fold, True).select("digest", "text")
        small = n_missing <= few  # counted: as many digests of 32 bytes
        if small:
            rows = rows.join(F.broadcast(missing), "digest", "left_semi")
        once = rows.groupBy("digest").agg(F.first("text").alias("text"))
        if not small:
            once = once.join(missing, "digest", "left_semi")  # both lie by digest already
        counted(once, file).withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    counts = materialise(stored(spark, cache, tokenizer).join(keyed.select("digest").distinct(), "digest", "left_semi"), "counts")
    rows = keyed.join(counts, "digest")  # two scans: adaptive execution may split a hot digest
    return rows.select("_row.*", "n_bytes", "digest", "n_tokens").drop("_")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = count_tokens(source_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
