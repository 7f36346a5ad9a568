"""A training-data pipeline: quality rules, line dedup, near duplicates, decontamination, mixing.

Every stage but the last takes and returns the columns of ``documents``; between stages the rows are written
to the shared folder as Parquet and read again, so a lost executor repeats tasks of one stage only.  A stage's rows are
deleted once the next stage's are written.

Defined cases, for every stage: an empty table gives no rows; repeated rows are judged one by one where nothing else is
said; documents with equal ids are judged by their own texts; texts of any length are taken whole.  Documents may have more
columns, whatever their names, and keep them as they are; only the last stage's own columns replace others of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm import decontamination, line_dedup, mixing, near_dup, quality_rules
from moundworks.llm.common import discard, materialise, shared_dir, source_table


def apart(docs: DataFrame) -> DataFrame:
    """doc_id, text and a struct ``row`` of all other columns, out of reach of the columns that an operator adds."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]).alias("row"))


def together(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """What is left of ``apart(docs)``, with the columns of docs."""
    return rows.select(*[F.col(c if c in ("doc_id", "text") else f"row.`{c}`").alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the web policy keeps; null, empty and blank texts have too few words and go."""
    return together(quality_rules.ledger(apart(docs)).where(quality_rules.passes("web", 2)), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds; n_chars, if there is one, follows the text.

    A null text stays null; rows without an id lose nothing; a text may end up empty.
    """
    kept = together(line_dedup.dedup_lines(apart(docs)), docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id.

    Texts without words are like nothing; rows that repeat id and text become one, the first by its other columns; rows
    without an id stay only where no document like them has one.
    """
    return together(near_dup.keep_one(apart(docs)), docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage to speak of; texts without words hold none."""
    return together(decontamination.drop_contaminated(apart(docs), source_table(spark, sf_dir, "benchmark")), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: a row per copy that the mix takes; texts without words are never taken, null sources come last.

    Columns named size, source_size, target, copy, position or taken are replaced by the mix's own; one
    named positions is dropped.
    """
    return mixing.mix(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    docs, before = source_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        folder = shared_dir(spark, f"pipeline-{name}")
        docs = materialise(stage(spark, docs, sf_dir), name, folder)
        if before:
            discard(spark, before)
        before = folder
    return STAGES[-1][1](spark, docs, sf_dir)


def _over(sql: str, table: str) -> str:
    """An operator's SQL with another table in place of documents."""
    head = "WITH RECURSIVE " if sql.strip().startswith("WITH RECURSIVE") else "WITH "
    return head + f"documents AS (SELECT * FROM {table}), " + sql.strip()[len(head) :]


_LINES = line_dedup.OP5_SQL.replace("sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256", "coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '') AS kept")

ORACLE_SQL = f"""
WITH q1 AS (
  SELECT d.* FROM documents d JOIN ({quality_rules.OP8_SQL}) q ON d.doc_id = q.doc_id WHERE q.kept
), q2 AS (
  SELECT d.doc_id, l.kept AS text, d.lang, d.source, length(l.kept) AS n_chars FROM q1 d JOIN ({_over(_LINES, "q1")}) l ON d.doc_id = l.doc_id
), q3 AS (
  SELECT d.* FROM q2 d JOIN ({_over(near_dup.OP9_SQL, "q2")}) c ON d.doc_id = c.doc_id WHERE c.component_id = d.doc_id
), q4 AS (
  SELECT d.* FROM q3 d JOIN ({_over(decontamination.OP7_SQL, "q3")}) c ON d.doc_id = c.doc_id WHERE NOT c.contaminated
), {mixing.MIX_CTES.format(docs="q4")}
SELECT doc_id, text, lang, source, n_chars, size, source_size, target, p AS copy, position, words AS taken FROM timed WHERE words > 0
"""
