"""Dates, sections, calculators and contributions on edge rows."""

import datetime

from pyspark.sql import functions as F

from terraloom.functions import text
from terraloom.operators import calculators
from terraloom.operators import claims as C


def values(spark, column, rows):
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    return [r[0] for r in df.select(column(F.col("t"))).collect()]


def test_dates(spark):
    day = datetime.date
    got = values(spark, text.dates_in, ["31 Feb 2020, 3 march 2021; 2020-02-30 and 2019-12-01", "1 Septober 1999", "", None, "0000-01-01", "12 Mayor 2001"])
    assert got == [[day(2021, 3, 3), day(2019, 12, 1)], [day(1999, 9, 1)], [], None, [], [day(2001, 5, 12)]]


def test_mail_times(spark):
    column = lambda c: F.unix_timestamp(text.mail_time(c))
    assert values(spark, column, ["Thu, 1 Jan 1970 00:01:00 GMT", "1 Jan 1970 00:01:00 +0100", "1 Jan 1970 00:01:00", "yesterday", "", None]) == [60, -3540, 60, None, None, None]


def test_sections(spark):
    body = "x" * 120
    column = lambda c: text.section(c, r"item\s*7\.")
    got = values(spark, column, [f"Item 7. a ITEM 7. {body} Item 8. more", "Item 7. short Item 8. more", "nothing", "Item 7.  ", None, "Item 7." + "y" * 5000])
    assert got == [body, "short Item 8. more", None, None, None, "y" * 2000]


def test_pieces(spark):
    assert values(spark, text.marked_urls, ["<http://a> b <http://a> <https://c/d>", "http://a", "", None]) == [["http://a", "https://c/d"], [], [], None]
    assert values(spark, text.segments, ["a <u>  b <v>\n", " ", "", None]) == [["a <u>", "b <v>"], [], [], None]
    contents = "\n".join(f"Chapter {i} ... {i}" for i in range(6))
    assert values(spark, text.is_navigation, [contents, contents[:40], "a\nb\nc\nd\ne\nf", ""]) == [True, False, False, False]
    assert values(spark, lambda c: text.off_topic(c, ["mine", "oil"]), ["Oil!", "oily", "", None]) == [False, True, False, False]


def test_calculators(spark):
    rows = spark.createDataFrame([(None, None, None, None, None, None, None, None), (0.0, None, None, 0.2, 0.0, "mostly", 95.0, 80.0), (1e9, None, None, 0.2, 1000.0, "none", None, 50.0)], "d double, p double, k double, g double, r double, tier string, i double, b double")
    got = [tuple(r[0]) for r in rows.select(calculators.environment(*(F.col(c) for c in ("d", "p", "k", "g", "r", "tier", "i", "b")))).collect()]
    assert got[0] == (50.0, 0.0, 100.0, 0.0)
    assert got[1][0] == round(80 + 50 * 2.25 / 42.25) and got[1][3] == 0.667
    assert got[2][0] == round(50 - 50 * 40 / 55)
    one = spark.range(1)
    none = F.lit(None).cast("boolean")
    assert tuple(one.select(calculators.governance(none, F.lit(False), F.lit(True), baseline=F.lit(None).cast("double"))).first()[0]) == (67.0, 32.0, 100.0, 0.333)
    assert tuple(one.select(calculators.social(F.lit(0), F.lit(0), none, F.lit(True), F.lit(None).cast("double"))).first()[0])[0] == round(50 - 50 * 15 / 60)


def test_contributions(spark):
    columns = "factor string, method string, source_tag string, polarity int, strength double, confidence double, value double, weight double, full_value double, none_value double, banded boolean, per_revenue boolean, tracked boolean, revenue double, country_total double, fresh double"
    rows = [
        ("share", "dataset_lookup", "s", 0, 0.0, 0.8, 25.0, 2.0, 15.0, 250.0, True, True, True, None, 100.0, 0.5),
        ("said", "extracted", "s", -1, 0.5, 0.8, 25.0, 2.0, 15.0, 250.0, True, True, True, 0.0, 100.0, 0.5),
        ("placed", "extracted", "s", -1, 0.5, 0.8, 15.0, 2.0, 15.0, 250.0, True, True, True, 1.0, 100.0, 0.5),
        ("mention", "extracted", "s", 1, 0.5, 0.8, None, 2.0, 15.0, 250.0, True, True, True, None, None, 0.5),
        ("event", "extracted", "s", 1, 0.5, 0.8, 3.0, 2.0, None, None, False, False, False, None, None, 0.5),
        ("report", "extracted", "report_pdf_e", 1, 0.5, 0.8, 3.0, 2.0, None, None, False, False, False, None, None, 0.5),
    ]
    got = {r.factor: (round(r.delta, 9), round(r.confidence, 9)) for r in C.contributions(spark.createDataFrame(rows, columns)).collect()}
    assert got == {"share": (0.5, 0.8), "said": (-0.5, 0.4), "placed": (1.0, 0.8), "mention": (0.5, 0.8), "event": (0.5, 0.4), "report": (0.5, 0.8)}
    assert C.contributions(spark.createDataFrame([], columns)).count() == 0
