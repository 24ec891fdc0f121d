"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from waybill.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows, names):
    def one(v):
        return "~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(r[n]) for n in names) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    relation = con.sql(ORACLES[name])
    names = sorted(relation.columns)
    frame = QUERIES[name](spark, sf_dir)
    assert sorted(frame.columns) == names
    want = [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()]
    assert plain(frame.collect(), names) == plain(want, names)


def test_entry_point(spark):
    import __spark_entry__

    assert os.path.exists(__spark_entry__.__file__)
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
