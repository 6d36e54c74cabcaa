"""Every query that has SQL gives the rows that DuckDB gives; the others run."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from corpusloom import queries as core


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return v


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for p in Path(sf).iterdir():
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", [n for n in core.QUERIES if n in core.ORACLE])
def test_same_rows(spark, sf, con, name):
    want = con.execute(core.ORACLE[name])
    columns = [c[0] for c in want.description]
    got = core.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    rows = [tuple(map(plain, r)) for r in got.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", [n for n in core.QUERIES if n not in core.ORACLE])
def test_rows_only(spark, sf, name):
    if name.startswith(("token_count", "piece_")):
        pytest.importorskip("public_tokenizers")
    assert core.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
