"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from catalog.oracles import SQL
from catalog.queries import QUERIES
from check import TABLES, _rows

SF = contract.SMOKE_DIR


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.filterwarnings("ignore::UserWarning")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    df = contract.queries()[name](spark, SF)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, df.collect()) == _rows(names, cur.fetchall())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r.metric for r in rows} == {"accuracy", "auc_roc", "pr_auc", "f1", "precision", "recall"}
    assert all(len(r["values"]) == 5 for r in rows)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)
    assert set(SQL) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql())
