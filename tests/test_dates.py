"""Date cells beyond the four named formats."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from memaudit.functions import cells
from memaudit.operators import records

CASES = {
    "Mar 5, 2010": "2010-03-05", "March 5th, 2010": "2010-03-05", "5 march 2010": "2010-03-05", "05-Mar-10": "2010-03-05", "5-MAR-1969": "1969-03-05", "2010 Mar 5": "2010-03-05",
    "Friday, March 5, 2010": "2010-03-05", "sept 3 99": "1999-09-03", "March 2010": "2010-03-01", "2010 dec": "2010-12-01", "05.03.2010": "2010-05-03", "25.03.2010": "2010-03-25",
    "3.5.10": "2010-03-05", "2010/3/5": "2010-03-05", "2010.03.05": "2010-03-05", "03-05-2010": "2010-03-05", "2010-3-5": "2010-03-05", "20100305": "2010-03-05", "2010": "2010-01-01",
    "2010-03": "2010-03-01", "3/2010": "2010-03-01", "2010-03-05T12:30:00Z": "2010-03-05 12:30:00", "2010-03-05 12:30": "2010-03-05 12:30:00", "2010-03-05T23:30:00+02:00": "2010-03-05 21:30:00",
    "2010-03-05T23:30:00.123-0500": "2010-03-06 04:30:00", "Mar 5, 2010 10:15 PM": "2010-03-05 22:15:00", "3/5/2010 12:01 am": "2010-03-05 00:01:00", " 5 May 2010 ": "2010-05-05",
    # the four named formats
    "2010-03-05": "2010-03-05", "3/5/2010": "2010-03-05", "3/5/10": "2010-03-05", "2010-03-05 01:02:03": "2010-03-05 01:02:03",
    # no date
    "": None, "unknown": None, "Mar 5": None, "5 6": None, "30 feb 2010": None, "2010-13-05": None, "0": None, "45000": None, "1.2.3.4": None, "march": None, "2010-03-05 25:00": None,
    "12:30": None, "mar mar 2010": None, "5 Mar 2010 about": None, "99999999999999999999": None, None: None, "\xa0": None, "3/5/2010 13:01 pm": None,
}


def test_date_cells(spark):
    df = spark.createDataFrame(list(CASES.items()), "s string, want string").select("s", "want", F.date_format(cells.parse_date("s"), "yyyy-MM-dd HH:mm:ss").alias("got"))
    for r in df.collect():
        want = r["want"] and (r["want"] + " 00:00:00" if len(r["want"]) == 10 else r["want"])
        assert r["got"] == want, r["s"]


def test_generic_dates_equal_the_general_parser(spark):
    """Where pandas' general parser reads a cell in a way that does not depend on the day it runs, ours agrees."""
    pd = pytest.importorskip("pandas")
    cells_ = [s for s in CASES if s and s.strip() and CASES[s]]
    got = {r["s"]: r["t"] for r in spark.createDataFrame([(s,) for s in cells_], "s string").select("s", cells.parse_date("s").alias("t")).collect()}
    for s in cells_:
        t = pd.to_datetime(s, errors="coerce")
        if t is pd.NaT:
            continue
        t = t.tz_convert(None) if t.tzinfo else t
        assert got[s] == datetime(t.year, t.month, t.day, t.hour, t.minute, t.second), s


def test_ages_at_three_events_and_rejected_cells(spark):
    df = spark.createDataFrame([("Mar 5, 1950", "3/6/2010", "5 March 2011", "soon"), (None, "2010-01-01", None, "1/1/11"), ("?", "2010", "?", None)],
                               "DOB string, surg_1_date string, surg_2_date string, surg_3_date string")
    got = [tuple(r) for r in records.drop_identifiers(records.with_event_ages(df)).select("surg_1_age", "surg_2_age", "surg_3_age", "_rejected_dates").collect()]
    assert got == [(60.0, 60.0, None, 1), (None, None, None, 0), (None, None, None, 2)]
    bad = {tuple(r) for r in records.rejected_dates(df).collect()}
    assert bad == {("DOB", "?", 1), ("surg_2_date", "?", 1), ("surg_3_date", "soon", 1)}
