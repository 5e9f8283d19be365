"""clean_date by grammar: hand-written expected values."""

import pytest

from lurescan.functions import text as T

CASES = {
    "2008/08/05": "05/08/2008", "05-Aug-2008": "05/08/2008", "5 Aug 08": "05/08/2008", "20080805": "05/08/2008",
    "5.8.2008": "08/05/2008", "25/12/2008": "25/12/2008",
    "5th August 2008": "05/08/2008", "Tue Aug  5 23:31:02 EDT 2008": "05/08/2008", "10:00 5 Aug 2008": "05/08/2008",
    "Tue, 05 Aug 2008 23:31:02 -0700": "05/08/2008", "Tue, 5 Aug 2008 23:31:02 -0700 (PDT)": "05/08/2008",
    "2008-08-05T23:31:02.250+02:00": "05/08/2008", "2008-08-05T23:31:02Z": "05/08/2008", "August 5, 2008": "05/08/2008",
    "Aug 5 '08": "05/08/2008", "99-Jan-01": "01/01/1999", "5 August of 2008, 5pm EST": "05/08/2008", "080805": "05/08/2008",
    "20080805233102": "05/08/2008", "13/13/2008": None, "30 Feb 2008": None, "29/02/2008": "29/02/2008", "junk": None, "": None,
    "5 Aug": None, "2008": None, "Aug Sep 2008": None, "1 2 3 4": None, "5 Foo 2008": None, "05/08/75": "08/05/1975",
    "05/08/74": "08/05/2074", "Friday, 1 SEPT 2006 10:15 p.m. GMT": "01/09/2006", "12/31/1999 11:59 PM": "31/12/1999", None: None,
    "n/a #12": None, "3 mars 2008": None, "2008.12.25": "25/12/2008", "1/2/2003": "02/01/2003",
}
CASES["08/05/08"] = "05/08/2008"  # month first


@pytest.fixture(scope="module")
def read(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "d string")
    return {r.d: r.x for r in df.select("d", T.clean_date("d").alias("x")).collect()}


@pytest.mark.parametrize("text", list(CASES), ids=str)
def test_clean_date(read, text):
    assert read[text] == CASES[text]
