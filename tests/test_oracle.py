"""Registered queries vs their DuckDB oracle on the smallest driver tables."""
import os

import duckdb
import pytest

import __spark_entry__ as entry
from memaudit.plans.tables import TABLES
from tools_check import digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["rarity_splits", "cards", "mcnemar", "code_best_recall", "document_csv", "card_files", "prediction_files", "resumed_output", "malformed_lines"])
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert digest(df.columns, rows)[0] == digest(cols, res.fetchall())[0]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["patient_id", "split", "rarity_group", "I_gen", "I_phen", "I_traj", "I_total", "k_full"]
    assert df.count() > 0
