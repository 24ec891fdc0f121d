"""The training-data queries against their SQL on the smallest tables."""

import duckdb
import pytest

from tests.test_oracles import TABLES, plain
from waybill.llm.queries import ORACLES, QUERIES


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
