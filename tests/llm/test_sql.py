"""Every query of this subpackage that has SQL against that SQL, on a small table."""

import duckdb
import pytest

from folioforge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    got = queries.queries()[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    plain = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(got.select(*names).collect()) == plain(found.fetchall())
