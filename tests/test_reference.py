"""The library's queries against their SQL, on the smallest tables, and fixed values of single functions."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from helixlake.functions import alphabet
from helixlake.operators import intervals
from helixlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.QUERIES[name](spark, SF)
    wanted = db.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    order = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in found.collect()), key=str)
    sql = sorted((tuple(plain(dict(zip(wanted.columns, r))[c]) for c in order) for r in wanted.fetchall()), key=str)
    assert rows == sql


def test_digitize_fixed_values(spark):
    row = spark.range(1).select(alphabet.digitize(F.lit("ACGUTXIn-._*~?")).alias("c")).first()
    assert row.c == [0, 1, 2, 3, 3, 15, 0, 15, 4, 4, 4, 16, 17, 254]


def test_removed_hits_suppress_nothing(spark):
    rows = spark.createDataFrame([(1, 1, 10, 9.0), (1, 8, 20, 8.0), (1, 15, 25, 7.0)], "g long, lo long, hi long, score double")
    kept = intervals.remove_overlaps(rows, ["g"], [F.desc("score")], ["lo", "hi"]).collect()
    assert sorted(r.lo for r in kept) == [1, 15]
    marked = intervals.mark_overlaps(rows, ["g"], [F.desc("score")], 16).orderBy("lo").collect()
    assert [r.marked for r in marked] == [False, True, True]
