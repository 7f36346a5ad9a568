"""Every registered query that has SQL gives the same rows in Spark and DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from moundworks.functions.constants import TRAINING_LIMIT
from moundworks.operators import clean, scoring, sequences
from moundworks.plans.queries import ORACLES, QUERIES
from moundworks.sources import fixtures

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def text(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    if str(got.dtypes.astype(str).tolist()) != str(want.dtypes.astype(str).tolist()):
        got, want = (x.apply(lambda c: c.astype(float) if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) else c) for x in (got, want))
    assert canonical(got) == canonical(want)


def test_anchors(spark):
    """Row counts that were found independently for the smallest tables."""
    assert entry.entry(spark).count() == 301
    assert QUERIES["valid_pitches"](spark, DATA).count() == 5327
    assert QUERIES["pitch_sequences"](spark, DATA).count() == 4164


def test_scoring_has_no_cap(spark, monkeypatch):
    limit, *others = sequences.sequence_dataset.__defaults__
    monkeypatch.setattr(sequences.sequence_dataset, "__defaults__", (100, *others))
    assert QUERIES["sequence_dataset"](spark, DATA).count() == 95 and limit == TRAINING_LIMIT
    complete = sequences.sequence_dataset(clean.training_rows(fixtures.world(spark, DATA)["pitches"]), limit=None).na.drop(subset=scoring.INPUTS)
    idx = {r["idx"] for r in QUERIES["pitch_sequences"](spark, DATA).select("idx").collect()}
    got = [r["idx"] for r in QUERIES["lstm_score"](spark, DATA).select("idx").collect()]
    assert len(got) == len(set(got)) == complete.count() > 100 and set(got) <= idx


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
