"""Every query of the engine against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from recordlens.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
RUN, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, con, name):
    df = RUN[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    out = con.execute(SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    want = [tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_every_query_has_its_sql():
    assert set(RUN) == set(SQL)


def test_graph_of_parts_numbered_beyond_a_million(spark, tmp_path):
    """A part's key beyond a million is not taken for the repeat of a smaller one."""
    held = duckdb.connect()
    for name, sql in {
        "nation": "SELECT i::INT AS n_nationkey FROM range(25) r(i)", "region": "SELECT i::INT AS r_regionkey FROM range(5) r(i)", "supplier": "SELECT i + 1 AS s_suppkey FROM range(20) r(i)",
        "part": "SELECT i + 1 AS p_partkey FROM range(40) r(i) UNION ALL SELECT i + 1000001 FROM range(80) r(i)",
    }.items():
        held.execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        held.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    got = sorted((r["code"], r["path"]) for r in RUN["integrity_graph"](spark, str(tmp_path)).collect())
    assert got == sorted(held.execute(f"SELECT code, path FROM ({SQL['integrity_graph']})").fetchall())
