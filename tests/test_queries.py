"""Every registered query gives what its SQL gives, over the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entries
from strandloom import queries as plain

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(repr, frame[cols].astype(object).where(frame[cols].notna(), None).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(plain.QUERIES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(plain.QUERIES[name](spark, SF).toPandas()) == rows(con.execute(plain.SQL[name]).fetchdf())


@pytest.mark.parametrize("name", ["tag_array_mixed", "unique_kmers_mixed", "disagreeing_tags"])
def test_same_rows_for_every_length(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("create table part as select range as p_partkey, substring('lavenderspringchiffonturquoisefrosted', 1, cast(range % 37 as int)) as p_name, 'Brand#13' as p_brand, 'PROMO' as p_type, 7 as p_size from range(10, 90)")
    con.execute(f"copy part to '{tmp_path}/part.parquet'")
    got, want = plain.QUERIES[name](spark, str(tmp_path)), con.execute(plain.SQL[name])
    cols = [c[0] for c in want.description]  # plain rows: a column of numbers with nulls has another type in each data frame
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_entry_points():
    assert set(plain.QUERIES) <= set(entries.queries())
    assert set(entries.oracle_sql()) <= set(entries.queries())
