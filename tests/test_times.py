"""Times as people write them."""

import pytest
from pyspark.sql import functions as F

from pulsecheck.operators import split

WRITTEN = {
    "MM/dd/yyyy": "month/day/year", "M/d/yyyy": "month/day/year", "dd/MM/yyyy": "day/month/year", "d.M.yyyy": "day.month.year", "dd-MM-yyyy": "day-month-year",
    "yyyy/MM/dd": "year/month/day", "yyyy.MM.dd": "year.month.day", "yyyyMMdd": "yearmonthday", "yyyyMMddHHmmss": "yearmonthdaytime", "MMM dd, yyyy": "name day, year",
    "MMMM d, yyyy": "fullname day, year", "dd MMM yyyy": "day name year", "dd-MMM-yyyy": "day name year", "d MMMM yyyy": "day fullname year",
    "MM/dd/yyyy HH:mm": "month/day/year", "MM/dd/yyyy h:mm a": "month/day/year", "dd/MM/yyyy HH:mm:ss": "day/month/year", "yyyy-MM-dd": "iso", "yyyy-MM-dd'T'HH:mm:ss": "iso",
}


@pytest.fixture(scope="module")
def days(spark):
    """Two rows a day, keys not in the order of time."""
    return spark.range(400).select("id", F.expr("timestamp_ntz '2023-06-01 08:00:00' + make_dt_interval(CAST(id * 77 % 400 AS INT) DIV 2)").alias("t"))


@pytest.mark.parametrize("pattern", WRITTEN)
def test_split_by_written_times(days, pattern):
    rows = days.select("id", F.date_format("t", pattern).alias("t"))
    assert split.time_parse_share(rows, "t").first()["written"] == WRITTEN[pattern]
    labelled, warning = split.split_periods(rows, ["id"], 0.6, "t")
    first = {r["id"] for r in days.orderBy("t", "id").limit(240).collect()}
    assert warning is None and {r["id"] for r in labelled.where("period = 'reference'").collect()} == first


def test_one_way_for_the_whole_column(spark):
    rows = spark.range(200).select("id", F.expr("IF(id < 165, '31/12/2024', '12/31/2024')").alias("t"))
    found = split.time_parse_share(rows, "t").first()
    assert (found["n_parsed"], found["accepted"], found["written"], found["ambiguous"]) == (165, True, "day/month/year", False)
    fewer = rows.withColumn("t", F.expr("IF(id < 155, t, 'soon')"))
    assert split.split_periods(fewer, ["id"], 0.6, "t")[1] == "time_not_parsed"


def test_unclear_day_and_month_is_told(spark):
    rows = spark.range(200).select("id", F.expr("concat('0', 1 + id % 9, '/', 10 + id % 3, '/2024')").alias("t"))
    labelled, warning = split.split_periods(rows, ["id"], 0.6, "t")
    assert warning == "day_and_month_unclear"
    first = sorted(range(200), key=lambda i: (1 + i % 9, 10 + i % 3, i))[:120]
    assert {r["id"] for r in labelled.where("period = 'reference'").collect()} == set(first)


def test_numbers_are_instants(spark):
    rows = spark.range(200).select("id", (F.lit(20240101) + F.col("id") * 7919 % 200).alias("t"))
    labelled, warning = split.split_periods(rows, ["id"], 0.6, "t")
    assert warning is None and labelled.where("period = 'reference' AND t >= 20240101 + 120").isEmpty()
