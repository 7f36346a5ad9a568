"""Language identification by error-correcting output codes.

Every language gets a codeword of bits.  One binary n-gram classifier per bit tells, from hashed byte
trigrams, on which side of the bit a text's language lies.  Its weights are log odds of the trigrams'
frequencies on either side, each language counting alike, so one pass of counting over all training rows
(a Spark aggregation with one row per language and bin) fits all of them.  A text's language is the codeword
with the least loss, each bit weighed by how well that bit separates that language; a small lead over the
runner-up, or hard bits nearer to no codeword than half the code's distance, marks the answer as ambiguous.

The counts that come to the driver are BINS numbers per language: a language list of some thousand labels at most is
assumed, so clean the labels first where anyone may write them.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text if nothing
could be learned; with one language learned every other text is that language; equal losses go to the first language in
code-point order; repeated rows count as often as they occur; texts of any length are taken whole; a null id counts as
the text '' for the fold; an empty table gives no rows; input columns named like an output column are replaced, others
pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundworks.llm.common import slices, source_table, texts

BINS = 1 << 14
TRIALS = 200
SHARPNESS = 10.0
_SPACE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Bins of the byte trigrams of the letters, lower-cased, words parted by one space."""
    clean = b" " + b" ".join(text.translate(_SPACE).split()) + b" "
    b = np.frombuffer(clean, np.uint8).astype(np.uint32)
    return ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(18)


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    clean = text.translate(_SPACE)
    return any(97 <= c <= 122 for c in clean[:64]) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1 and 1: every split for up to 7 languages (2 ** (n - 1) - 1 bits), else of ``TRIALS`` random codes of
    10 log2 n bits the one whose nearest two codewords are farthest apart."""
    if n <= 7:
        splits = [[1 if k == 0 or k in side else -1 for k in range(n)] for size in range(n - 1) for side in combinations(range(1, n), size)]
        return np.array(splits, np.int8).T.reshape(n, -1)
    bits, random = int(np.ceil(10 * np.log2(n))), np.random.default_rng(seed)
    codes = (random.choice(np.array([-1, 1], np.int8), (n, bits)) for _ in range(TRIALS))
    return max(codes, key=least_distance)


def least_distance(code: np.ndarray) -> int:
    """The least Hamming distance of two codewords; 0 if there are no two."""
    n, bits = code.shape
    alike = code.astype(np.float32) @ code.T.astype(np.float32)
    np.fill_diagonal(alike, -bits)
    return int((bits - alike.max()) / 2) if n > 1 else 0


def count_trigrams(docs: DataFrame) -> DataFrame:
    """lang, bin, n over all rows with a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    total.setdefault(lang, np.zeros(BINS, np.int64))[:] += np.bincount(trigrams(text), minlength=BINS)
        for lang, n in total.items():
            bins = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins.astype(np.int32)), pa.array(n[bins])], names=["lang", "bin", "n"])

    known = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    return known.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n"))


class Model:
    """Languages, codewords, a weight per bin and bit, and the weight of each bit for each language."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs, self.code = langs, codewords(len(langs)) if langs else np.zeros((0, 0), np.int8)
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        ones = (self.code > 0).astype(float)
        side = lambda x: (x.T @ share) / np.maximum(x.sum(axis=0), 1)[:, None]
        self.weights = (np.log(side(ones)) - np.log(side(1 - ones))).T if self.code.size else np.zeros((BINS, 0))
        lead = np.maximum((share @ self.weights) * self.code, 1e-6) if self.code.size else np.zeros((len(langs), 0))
        self.trust = lead / np.maximum(lead.sum(axis=1, keepdims=True), 1e-12)
        self.distance = least_distance(self.code)

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language's index, its score from 0 to 1, and whether it is ambiguous."""
        loss = (np.logaddexp(0, -SHARPNESS * margins[:, None, :] * self.code[None]) * self.trust[None]).sum(axis=2)
        order = np.argsort(loss, axis=1, kind="stable")
        best = order[:, 0]
        likely = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        score = 1 / likely.sum(axis=1)
        wrong = ((np.sign(margins)[:, None, :] != self.code[None]).sum(axis=2)).min(axis=1) if self.code.size else np.zeros(len(margins))
        lead = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - loss[np.arange(len(best)), best] if len(self.langs) > 1 else np.full(len(best), np.inf)
        return best, score, (lead < 0.1) | (2 * wrong >= max(self.distance, 1))


def fit(docs: DataFrame) -> Model:
    """Learn from columns text and lang only; what comes to the driver is a row per language and bin."""
    rows = count_trigrams(docs).toPandas()
    langs = sorted(rows["lang"].unique().tolist())
    counts = np.zeros((len(langs), BINS))
    counts[rows["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int), rows["bin"].to_numpy(int)] = rows["n"]
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and ambiguous, from the text alone."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at):
                rows = texts(batch.column(at))
                known = [r for r, t in enumerate(rows) if has_letter(t)] if model.langs else []
                lang, score, unsure = ["und"] * len(rows), np.zeros(len(rows)), np.zeros(len(rows), bool)
                if known:
                    margins = np.empty((len(known), model.code.shape[1]))
                    for k, r in enumerate(known):
                        bins = np.bincount(trigrams(rows[r]), minlength=BINS)
                        margins[k] = bins @ model.weights / bins.sum()
                    best, score[known], unsure[known] = model.decide(margins)
                    for r, b in zip(known, best.tolist(), strict=True):
                        lang[r] = model.langs[b]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=[*names, "lang_pred", "score", "ambiguous"])

    more = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def held_out(n: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text leaves 2 when divided by n."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n == 2


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source_table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(4))
    model = fit(docs.where(~F.col("held_out")))
    return predict(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
