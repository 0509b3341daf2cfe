"""The registered queries of the problems on the smallest tables, with SQL where there is one."""

import glob
import os

import duckdb
import pytest

from groundline.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    rows = frame.collect()
    assert rows or name == "p1_found"
    if name in queries.ORACLE:
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for path in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        cursor = con.execute(queries.ORACLE[name])
        names = [d[0] for d in cursor.description]
        show = lambda v: str(v.replace(tzinfo=None)) if hasattr(v, "tzinfo") else str(v)
        assert sorted([show(r[c]) for c in sorted(names)] for r in rows) == sorted([show(r[names.index(c)]) for c in sorted(names)] for r in cursor.fetchall())
