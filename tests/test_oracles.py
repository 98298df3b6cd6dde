"""Every query with a DuckDB counterpart gives the same rows on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lodeworks.queries import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in FOLDER.iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if pd.isna(v) else f"{v:.6g}"
    return None if v is None or v is pd.NaT or v is pd.NA else str(v)


def _rows(df: pd.DataFrame) -> list[tuple]:
    return sorted((tuple(map(_cell, r)) for r in df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False)), key=str)


@pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    mine, theirs = QUERIES[name](spark, str(FOLDER)).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert _rows(mine) == _rows(theirs)
