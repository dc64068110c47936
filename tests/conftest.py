"""One local session for all tests, and a comparison with DuckDB."""

from __future__ import annotations

import glob
import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

SMALL = "/root/testdata/sf0.001"
os.environ["PYTHONPATH"] = f"{Path(__file__).parent.parent}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, numbers rounded, rows in order."""
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_numeric_dtype(out[c]) and not pd.api.types.is_bool_dtype(out[c]):
            out[c] = out[c].astype("float64").round(6) + 0.0
        else:
            out[c] = out[c].astype(str).replace({"nan": "None", "<NA>": "None", "NaT": "None"})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def same_as_duckdb(spark):
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM '{f}'")

    def check(query, sql: str) -> None:
        ours, theirs = canonical(query(spark, SMALL).toPandas()), canonical(con.execute(sql).df())
        assert list(ours.columns) == list(theirs.columns)
        pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, atol=1e-6)

    return check
