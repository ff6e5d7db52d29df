"""Times are read to the millisecond as the SQL does, in any session time zone."""

import duckdb
import pytest

from rasterweave.plans import registry
from rasterweave.sources.session import scratch

ROWS = [
    (0, 1, "2024-01-01 00:00:00.000500"),  # to 1 ms
    (1, 1, "2024-01-01 00:00:01.500499"),  # to 1500 ms: 1.499 s, not 1.5
    (2, 2, "2024-01-01 00:00:00.000499"),
    (3, 2, "2024-01-01 00:00:01.499500"),  # 1.5 s, not 1.499
    (4, 3, "1969-12-31 23:59:58.499500"),
    (5, 3, "1969-12-31 23:59:59.998500"),
    (6, 4, "2024-03-10 01:30:00"),  # the clock is put forward in New York
    (7, 4, "2024-03-10 03:30:00"),
    (8, 5, None),
    (9, None, "2024-11-03 01:30:00"),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("name", ["elapsed_seconds", "job_id"])
def test_milliseconds_equal_sql(spark, name, zone):
    folder = scratch(spark, "events")
    df = spark.createDataFrame(ROWS, "event_id long, user_id long, at string")
    df.selectExpr("event_id", "user_id", "cast(at as timestamp_ntz) as ts").coalesce(1).write.parquet(folder + "/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder.removeprefix('file://')}/events.parquet/*.parquet'")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = sorted(map(tuple, registry.QUERIES[name](spark, folder).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == sorted(con.sql(registry.ORACLES[name]).fetchall(), key=str)
