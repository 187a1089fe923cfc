"""The registered queries of this package against DuckDB, on whole tables."""

import duckdb
import pytest

from __spark_entry__ import queries
from armscope.llm.queries import ORACLES, QUERIES
from armscope.plans.fixtures import TABLES
from check import norm

SF = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_duckdb(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([norm(r[c]) for c in cols] for r in df.select(*cols).collect())
    assert got
    if name not in ORACLES:
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert cols == sorted(names)
    assert got == sorted([norm(r[i]) for i in order] for r in cur.fetchall())
