"""The date grammar: one row per form, with the anchor 2016-03-10 15:30."""

from pyspark.sql import functions as F

from pressmill.functions.dates import parse_date

FORMS = [
    ("2015-11-26", "2015-11-26 00:00:00"), ("2015/11/26", "2015-11-26 00:00:00"), ("2015-11-26 22:40:25", "2015-11-26 22:40:25"),
    ("2015-11-26T14:42Z", "2015-11-26 14:42:00"), ("2015-11-26T11:53:00.000Z", "2015-11-26 11:53:00"),
    ("2015-11-26T00:10:33+00:00", "2015-11-26 00:10:33"), ("2015-11-25T19:56:04+0000", "2015-11-25 19:56:04"),
    ("2015-11-25T23:56:04-05:00", "2015-11-26 04:56:04"), ("2015-11-25T03:00+01", "2015-11-25 02:00:00"),
    ("2015-11-25 10:00 PST", "2015-11-25 18:00:00"), ("201511261030", "2015-11-26 10:30:00"), ("20151126", "2015-11-26 00:00:00"),
    ("20151126T103015", "2015-11-26 10:30:15"), ("11/24/2015 01:05AM", "2015-11-24 01:05:00"), ("11/24/2015 01:05 pm", "2015-11-24 13:05:00"),
    ("24/11/2015", "2015-11-24 00:00:00"), ("04/11/2015", "2015-04-11 00:00:00"), ("26.11.2015 09:30", "2015-11-26 09:30:00"),
    ("11-24-15", "2015-11-24 00:00:00"), ("24/11/70", "1970-11-24 00:00:00"), ("Thursday, November 26, 2015, 6:42 AM", "2015-11-26 06:42:00"),
    ("Thursday, November 26, 2015,  6:42 PM EST", "2015-11-26 23:42:00"), ("10:27:15 AM Thursday, November 26, 2015", "2015-11-26 10:27:15"),
    ("Thu, 26 Nov 2015 13:48:30 +0100", "2015-11-26 12:48:30"), ("Thu, 26 Nov 2015 13:48:30 GMT", "2015-11-26 13:48:30"),
    ("26 Nov 2015 13:48 EDT", "2015-11-26 17:48:00"), ("26 November 2015", "2015-11-26 00:00:00"), ("26th of November, 2015", "2015-11-26 00:00:00"),
    ("Nov. 26, 2015", "2015-11-26 00:00:00"), ("Sept 3 2015", "2015-09-03 00:00:00"), ("1st May '15", "2015-05-01 00:00:00"),
    ("May 2nd, 2015 at 5pm", "2015-05-02 17:00:00"), ("May 2nd, 2015 at 12 a.m.", "2015-05-02 00:00:00"), ("26-Nov-2015", "2015-11-26 00:00:00"),
    ("26/Nov/2015:13:48:30 +0000", "2015-11-26 13:48:30"), ("November 2015", "2015-11-01 00:00:00"), ("Nov 26", "2016-11-26 00:00:00"),
    ("26 Nov, 09:15", "2016-11-26 09:15:00"), ("Published on 3 March 2016 by A. Writer at 5:06 pm", "2016-03-03 17:06:00"),
    ("Last updated: 2016-01-02 03:04:05 (UTC)", "2016-01-02 03:04:05"), ("By Jo May, March 5, 2014 | 7 comments", "2014-03-05 00:00:00"),
    ("today", "2016-03-10 00:00:00"), ("Today at 8:15", "2016-03-10 08:15:00"), ("Yesterday, 11:59 pm", "2016-03-09 23:59:00"),
    ("3 hours ago", "2016-03-10 12:30:00"), ("an hour ago", "2016-03-10 14:30:00"), ("posted 2 days ago", "2016-03-08 15:30:00"),
    ("1 week ago", "2016-03-03 15:30:00"), ("10:27", "2016-03-10 10:27:00"), ("2016-02-29", "2016-02-29 00:00:00"),
    ("5 March 2016, noon", "2016-03-05 12:00:00"), ("2015-11-26 14:00", "2015-11-26 14:00:00"), ("  \n2015-11-26\t", "2015-11-26 00:00:00"),
    ("2015-11-26 14:00:01.250", "2015-11-26 14:00:01"), ("12:00 AM, January 1, 2000", "2000-01-01 00:00:00"),
    ("2015-02-29", None), ("31 June 2015", None), ("13/13/2015", None), ("2015-11-26 25:00", None), ("", None), (None, None), ("no date here", None),
    ("call 555-1234", None), ("maybe", None), ("version 1.2.3", None), ("0000-00-00", None),
]


def test_sixty_forms(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(FORMS)], "i int, s string")
    anchor = F.lit("2016-03-10 15:30:00").cast("timestamp")
    got = {r.i: r.d for r in df.select("i", F.date_format(parse_date("s", anchor), "yyyy-MM-dd HH:mm:ss").alias("d")).collect()}
    wrong = [(s, got[i], want) for i, (s, want) in enumerate(FORMS) if got[i] != want]
    assert not wrong and len(FORMS) >= 60


def test_without_an_anchor_nothing_is_guessed(spark):
    df = spark.createDataFrame([(s,) for s in ("today", "Nov 26", "10:27", "3 hours ago", "yesterday")], "s string")
    assert {r[0] for r in df.select(parse_date("s")).collect()} == {None}
