"""Every query of the core against its SQL, over the smallest tables."""

import glob
import os
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest

from groundline.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(value):
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (float, Decimal)):
        return repr(round(float(value), 6) + 0.0)
    return value if value is None else str(value)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, db, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted(([plain(r[c]) for c in columns] for r in frame.collect()), key=str)
    if name in registry.ORACLE:
        cursor = db.execute(registry.ORACLE[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == columns
        assert got == sorted(([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall()), key=str)
    else:
        assert got
