"""Every registered query of the library against its SQL, over whole tables at the smallest scale."""

import math

import duckdb
import pytest

from cairnspark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def cell(x):
        if x is None:
            return "~"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, float) or hasattr(x, "as_tuple"):
            return "nan" if math.isnan(x) else repr(round(float(x), 6))
        return str(x)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf_dir, db, name):
    df = catalogue.queries()[name](spark, sf_dir)
    rows = df.collect()
    spark.catalog.clearCache()
    if name not in catalogue.oracle_sql():
        assert df.columns
        return
    q = db.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in q.description]
    assert sorted(df.columns) == sorted(cols)
    assert shown(rows, df.columns) == shown(q.fetchall(), cols)
