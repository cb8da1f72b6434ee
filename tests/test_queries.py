"""Every registered trajectory query against its SQL over the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from trackspark.plans import oracle, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    return round(v, 4) + 0.0 if isinstance(v, float) and not math.isnan(v) else v


def key(row):
    return tuple((v is None, str(v)) for v in row)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    made = queries.QUERIES[name](spark, DATA)
    columns = sorted(made.columns)
    rows = sorted((tuple(map(plain, r)) for r in made.select(*columns).collect()), key=key)
    if name not in oracle.ORACLE_SQL:
        assert rows
        return
    got = db.execute(oracle.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=key)
    assert rows == expected


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_the_tracker_gives_the_same_ids_on_a_stream(spark):
    batch, stream = (sorted(map(tuple, queries.QUERIES[n](spark, DATA).select("clip", "seq", "frame", "track_id").collect()), key=str) for n in ("tracked_boxes", "tracked_boxes_stream"))
    assert batch == stream and len({r[3] for r in batch}) > 3
