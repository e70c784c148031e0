"""Every registered query with SQL gives the same rows as that SQL; the others run."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from scorelark import catalogue

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.isoformat() if isinstance(v, datetime.date) else v


def same_rows(spark, con, name, path=DATA):
    expected = con.sql(catalogue.ORACLE[name])
    got = catalogue.QUERIES[name](spark, path)
    assert sorted(got.columns) == sorted(expected.columns)
    rows = lambda r: sorted((tuple(map(plain, x)) for x in r), key=repr)
    assert rows(got.select(*(f"`{c}`" for c in expected.columns)).collect()) == rows(expected.fetchall())


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, con, name):
    same_rows(spark, con, name)


#: Queries whose data differ in kind at another size, such as keys that look like years.
@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["q_calendar", "q_event_name", "q_alias_split", "q_dedupe", "q_occurrence_match", "q_nearest_occurrence", "q_pages_for_events", "q_pages_half_alike"])
def test_same_rows_of_more(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{LARGER}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    same_rows(spark, c, name, LARGER)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["q_find_related", "q_dedupe", "q_dedupe_events"])
def test_customers_with_keys_like_years(spark, tmp_path, name):
    """Customers 1950 to 1999 and 2000 to 2049 are as different as any others."""
    c = duckdb.connect()
    shifted = {"orders": "o_custkey + 1950 AS o_custkey", "customer": "c_custkey + 1950 AS c_custkey"}
    for table, key in shifted.items():
        c.sql(f"COPY (SELECT * REPLACE ({key}) FROM '{LARGER}/{table}.parquet' WHERE {key.split()[0]} < 100) TO '{tmp_path}/{table}.parquet'")
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    c.sql(f"COPY (SELECT * FROM '{LARGER}/nation.parquet') TO '{tmp_path}/nation.parquet'")
    c.sql(f"CREATE VIEW nation AS SELECT * FROM '{LARGER}/nation.parquet'")
    same_rows(spark, c, name, str(tmp_path))


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the driver's tables")
def test_calendar_with_numbers_like_years(spark):
    """Orders 1900 to 2099 are events too, under the names that calendars give them."""
    rows = catalogue.QUERIES["q_calendar"](spark, LARGER).where("listed BETWEEN 1899 AND 2100").select("listed", "canonical_name", "aliases").collect()
    names = {r.listed: (r.canonical_name, r.aliases) for r in rows}
    assert len(rows) == 202 and names[1950] == ("Event", "Event (EV )|EV") and names[2100] == ("Event 2100", "Event 2100 (EV2100)|EV2100")
