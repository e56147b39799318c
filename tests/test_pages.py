"""Deep pages against a full sort."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from refinery.operators import pages, query


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(3)
    day = datetime.datetime(2020, 1, 1)
    rows = []
    for i in range(3000):
        hot = draw.random() < 0.35  # repeated rows
        rows.append((1.5 if hot else draw.choice([None, float("nan"), draw.random() * 4, -0.5]),
                     "same" if hot else draw.choice(["a", "é", "\U0001f600", "￮", None, ""]),
                     day if hot else day + datetime.timedelta(seconds=draw.randrange(50)), 7 if hot else i))
    return spark.createDataFrame(rows, "x double, `a name` string, t timestamp_ntz, n int").repartition(5).cache()


@pytest.mark.parametrize("order_by", [["x"], ["a name", "t"], ["t"], ["n"]])
def test_pages_equal_a_full_sort(table, order_by):
    columns = order_by + [c for c in table.columns if c not in order_by]
    want = [repr(r) for r in table.orderBy(*[F.col(f"`{c}`") for c in columns]).collect()]
    for offset in (0, 900, 1700, 2990, 3000, 5000):
        got = [repr(r) for r in pages.page(table, order_by, offset, 30, sorted_rows=20).collect()]
        assert got == want[offset:offset + 30], (order_by, offset)


def test_page_over_the_end_of_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "r")] * 500 + [(2, "s")] * 3 + [(3, "t")], "k int, v string")
    got = [tuple(r) for r in pages.page(rows, ["k"], 498, 5, sorted_rows=1).collect()]
    assert got == [(1, "r"), (1, "r"), (2, "s"), (2, "s"), (2, "s")]


def test_pages_of_nothing_and_bad_arguments(spark, table):
    assert pages.page(table.limit(0), ["x"], 100, 5, sorted_rows=1).collect() == []
    for order_by, offset in ((["nope"], 0), (["x"], -1)):
        with pytest.raises(ValueError):
            pages.page(table, order_by, offset, 5)


def test_fetch_takes_deep_offsets(spark):
    rows = spark.range(200_000).select((F.col("id") * 7919 % 200_000).alias("id"))
    got = query.fetch_rows(rows, limit=3, offset=150_000)
    assert [r.id for r in got.collect()] == [150_000, 150_001, 150_002]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "offset=150000" not in plan and "TakeOrderedAndProject" in plan
