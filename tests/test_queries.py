"""Every registered query of the library against its SQL on DuckDB."""

import os

import duckdb
import pytest

from tallyforge.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name, tmp_path):
    path = str(tmp_path / "out")
    QUERIES[name](spark, SF).write.parquet(path)
    columns = [c[0] for c in duck.execute(f"describe select * from '{path}/*.parquet'").fetchall()]
    assert columns
    if name in SQL:
        chosen = ", ".join(f'"{c}"' for c in sorted(columns))
        own, sql = f"(select {chosen} from '{path}/*.parquet')", f"(select {chosen} from ({SQL[name]}))"
        assert duck.execute(f"select count(*) from ({own} except all {sql})").fetchone() == (0,)
        assert duck.execute(f"select count(*) from ({sql} except all {own})").fetchone() == (0,)
