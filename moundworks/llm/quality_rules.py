"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document.  The ledger keeps the measurements and one long ``failed`` whose
bit k says that rule k failed; ``store`` writes it to the shared folder without the texts.  A policy is a named, versioned
mask of rules: applying it, comparing versions and ablating a rule are bitwise operations on the stored long, never a
second look at the text.

Defined cases: a null or empty text has no words and fails ``few_words``; letters are A-Z and a-z where a rule counts
them; texts of any length are measured whole; repeated rows are judged one by one; an empty table gives no rows, and no
ablations; input columns with the name of a measurement or ``failed`` are replaced, all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moundworks.llm.common import materialise, slices, source_table, texts

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")

#: (name, SQL condition under which the rule fails); the position is the bit, so new rules go to the end.
RULES = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "5 * n_symbols > n_words"),
    ("shouting", "2 * n_upper > n_letters"),
    ("repeated_lines", "3 * n_dup_lines > 2 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]

#: (policy, version) -> mask of the rules that reject.
POLICIES = {("base", 1): BASE, ("web", 1): BASE | BIT["symbols"], ("web", 2): sum(BIT.values())}

_KIND = np.zeros(256, np.uint8)  # 1: starts a code point of a word, 2: symbol, 4: A-Z, 8: A-Z or a-z
_KIND[:] = 1
_KIND[0x80:0xC0] = 0
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[list(b"#*$%&|<>")] |= 2
_KIND[ord("A") : ord("Z") + 1] |= 4 | 8
_KIND[ord("a") : ord("z") + 1] |= 8


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = x = len(self)
        return x


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def measure(rows: list[bytes]) -> np.ndarray:
    """MEASURES of each text, a row for each; exact, sort-based, no hashing."""
    out = np.zeros((len(rows), len(MEASURES)), np.int64)
    ends = np.cumsum([len(t) for t in rows], dtype=np.int64)
    kinds = _KIND[np.frombuffer(b"".join(rows), np.uint8)]
    for column, kind in ((1, 1), (2, 2), (6, 4), (7, 8)):
        total = np.concatenate([[0], np.cumsum((kinds & kind) != 0)])[np.concatenate([[0], ends])]
        out[:, column] = np.diff(total)
    ids, each = _Ids(), []
    for r, text in enumerate(rows):
        words = text.split()
        out[r, 0] = len(words)
        each.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        lines = [x for x in text.split(b"\n") if x.strip()]
        out[r, 5], out[r, 3] = len(lines), len(lines) - len(set(lines))
    word = np.concatenate(each) if each else np.zeros(0, np.int64)
    if len(word) >= 3:
        doc = np.repeat(np.arange(len(rows)), out[:, 0])
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        pair = _dense(word[:-1] * len(ids) + word[1:])
        three = _dense(pair[whole] * len(ids) + word[whole + 2])
        _, at, n = np.unique(doc[whole] * (len(three) + 1) + three, return_inverse=True, return_counts=True)
        start = whole[n[at] >= 2]
        hit = np.zeros(len(word), bool)
        for k in range(3):
            hit[start + k] = True
        out[:, 4] = np.bincount(doc[hit], minlength=len(rows))
    return out


def ledger(docs: DataFrame) -> DataFrame:
    """docs with the MEASURES and the failure bits ``failed``."""
    docs = docs.drop(*MEASURES, "failed")
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, at, 4 << 20):
                found = measure([t or b"" for t in texts(batch.column(at))])
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[:, k]) for k in range(len(MEASURES)))], names=[*names, *MEASURES])

    measured = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *(T.StructField(m, T.LongType()) for m in MEASURES)]))
    bits = [F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long") for name, condition in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed)


def store(docs: DataFrame) -> DataFrame:
    """The ledger of docs without their texts, written to the shared folder and read from there."""
    return materialise(ledger(docs).drop("text"), "ledger")


def passes(policy: str, version: int) -> Column:
    """True for ledger rows that a policy keeps."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy, version]).cast("long")) == 0


def ablations(rows: DataFrame, policy: str, version: int) -> DataFrame:
    """Per rule of a policy: how many documents fail it, and how many would be kept without it."""
    mask = F.lit(POLICIES[policy, version]).cast("long")
    seen = rows.groupBy(F.col("failed").bitwiseAND(mask).alias("failed")).agg(F.count("*").alias("n"))  # at most 2 ** rules rows
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BIT.items() if b & POLICIES[policy, version]])
    each = seen.select("failed", "n", F.explode(rules).alias("r")).select("failed", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("failed") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store(source_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("failed").bitwiseAND(F.lit(BASE).cast("long")) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", base.alias("base_failed"), passes("web", 2).alias("kept"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule of the web policy: documents that fail it, and those that fail nothing else."""
    return ablations(store(source_table(spark, sf_dir, "documents").select("doc_id", "text")), "web", 2)


OP8_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 1)) AS i FROM d)
), repeated AS (
  SELECT doc_id, count(DISTINCT pos) AS n
  FROM (SELECT doc_id, UNNEST([i, i + 1, i + 2]) AS pos FROM windows WHERE n >= 2) GROUP BY doc_id
), measured AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters
  FROM d LEFT JOIN repeated r ON d.doc_id = r.doc_id
), judged AS (
  SELECT *, CAST("""
    + " + ".join(f"(CASE WHEN {condition} THEN {BIT[name]} ELSE 0 END)" for name, condition in RULES)
    + f""" AS BIGINT) AS failed FROM measured
)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, failed, failed & {BASE} <> 0 AS base_failed, failed = 0 AS kept
FROM judged
"""
)

ABLATIONS_SQL = f"""
SELECT rule, CAST(count(*) FILTER (WHERE failed & bit <> 0) AS BIGINT) AS n_failed, CAST(count(*) FILTER (WHERE failed = bit) AS BIGINT) AS n_only
FROM ({OP8_SQL}) judged, (VALUES {", ".join(f"('{name}', {bit})" for name, bit in BIT.items())}) AS rules(rule, bit) GROUP BY rule
"""
