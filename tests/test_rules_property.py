"""The Spark rules on tables of cases and on generated strings (invariants)."""

import datetime as dt
import re
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from refinery.functions import pii, text as tx


def _apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


SETTINGS = dict(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

DATES = [
    ("2024-03-16", "2024-03-16"), ("03/15/2024", "2024-03-15"), ("15/03/2024", "2024-03-15"), ("04/05/2024", "2024-04-05"),
    ("2024/12/31", "2024-12-31"), ("31-12-2024", "2024-12-31"), ("12-31-2024", "2024-12-31"), ("05-06-2024", "2024-06-05"),
    ("March 5, 2024", "2024-03-05"), ("mar 05,  2024", "2024-03-05"), ("MAY 1, 2024", "2024-05-01"), (" 2024-1-2\t", "2024-01-02"),
    ("2024-02-30", "2024-02-30"), ("13/13/2024", "13/13/2024"), ("2024.01.02", "2024.01.02"), ("soon ", "soon"), ("", ""),
    ("29/02/2023", "29/02/2023"), ("02/29/2024", "2024-02-29"), ("Marchy 5, 2024", "Marchy 5, 2024"),
]
PHONES = [
    ("+1 (555) 010-2030", "+15550102030"), (" 555.0102 ", "5550102"), ("n/a", "n/a"), ("", ""), ("  ", ""),
    ("ext. 12", "12"), ("++4", "++4"), ("\tcall\n", "call"),
]
AMOUNTS = [
    ("$1,234.56", 1234.56), ("€ 7", 7.0), ("£0.005", 0.01), ("-12.5", -12.5), ("1_000", 1000.0), ("1__0", 0.0), ("", 0.0),
    ("call us", 0.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("$", 0.0), ("1.2.3", 0.0), ("inf", float("inf")),
    (".015", 0.01), ("2.675", 2.67), ("1.005", 1.0), ("0.125", 0.12), ("0.375", 0.38), ("-2.675", -2.67), ("-0.125", -0.12),
    ("9000000000000.125", 9000000000000.12), ("9000000000000.375", 9000000000000.38), ("-9000000000000.125", -9000000000000.12),
    ("1234567890123456.78", 1234567890123456.8), ("123456789012345678", 123456789012345680.0),
]


@pytest.mark.parametrize("rule,cases", [(tx.standardize_date, DATES), (tx.standardize_phone, PHONES),
                                        (tx.parse_currency, AMOUNTS)])
def test_rule_cases(spark, rule, cases):
    assert _apply(spark, [v for v, _ in cases], rule) == [want for _, want in cases]


@settings(**SETTINGS)
@given(st.lists(st.dates(min_value=dt.date(1000, 1, 1), max_value=dt.date(2999, 12, 31)), min_size=20, max_size=60))
def test_unambiguous_dates_come_back(spark, days):
    for shape in ("%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%B %d, %Y"):
        assert _apply(spark, [f" {d.strftime(shape)}\n" for d in days], tx.standardize_date) == [d.isoformat() for d in days]


@settings(**SETTINGS)
@given(st.lists(st.text(alphabet="0123456789/-, abcJanMay", max_size=14), min_size=20, max_size=60))
def test_date_rule_is_stable(spark, values):
    once = _apply(spark, values, tx.standardize_date)
    assert _apply(spark, once, tx.standardize_date) == once


@settings(**SETTINGS)
@given(st.lists(st.text(alphabet="0123456789+-(). abc\t", max_size=16), min_size=20, max_size=60))
def test_phone_keeps_digits_in_order(spark, values):
    for v, got in zip(values, _apply(spark, values, tx.standardize_phone)):
        if any(c in "0123456789+" for c in v):
            assert got == "".join(c for c in v if c in "0123456789+")
        else:
            assert got == v.strip()


@settings(**SETTINGS)
@given(st.lists(st.decimals(min_value=-10**6, max_value=10**6, places=3, allow_nan=False).map(str), min_size=20, max_size=60))
def test_rounding_follows_the_binary_value(spark, values):
    want = [float(Decimal(float(v)).quantize(Decimal("0.01"), ROUND_HALF_EVEN)) for v in values]
    assert _apply(spark, values, tx.parse_currency) == want


def test_currency_change(spark):
    same = ["1.25", "0.0", "-7.5", "123456789.01"]
    other = ["1.250", "1.2.3", "7", "1.255", "1234567890123456.78", "12345678901234567.0", "$1.25", "1e3", "00.5"]
    assert _apply(spark, same + other, lambda c: tx.currency_changed(c, "string")) == [False] * len(same) + [True] * len(other)
    df = spark.createDataFrame([(Decimal("1.25"), Decimal("1.250"))], "a decimal(10,2), b decimal(10,3)")
    row = df.select(tx.currency_changed(F.col("a"), "decimal(10,2)"), tx.currency_changed(F.col("b"), "decimal(10,3)")).first()
    assert tuple(row) == (False, True)


@settings(**SETTINGS)
@given(st.lists(st.text(alphabet=" \t\n\x0b\x0c\r\x1c\x85\xa0 ab", max_size=8), min_size=20, max_size=40))
def test_strip_matches_python(spark, values):
    assert _apply(spark, values, tx.ustrip) == [v.strip() for v in values]


pii_text = st.lists(st.sampled_from(["mail a.b@ex.com", "call 555 123 4567", "ssn 123-45-6789", "card 4111-1111-1111-1111",
                                     "ip 10.0.0.1", "plain words", "x@y", "12", " "]), min_size=1, max_size=4).map(" ".join)


@settings(**SETTINGS)
@given(st.lists(pii_text, min_size=10, max_size=30))
def test_pii_first_mode(spark, values):
    compiled = [(n, re.compile(p)) for n, p in pii.PII_PATTERNS]

    def py_first(v):
        for _, p in compiled:
            if p.search(v):
                return p.sub("[REDACTED]", v)
        return v

    assert _apply(spark, values, lambda c: pii.redact_first(c)[0]) == [py_first(v) for v in values]


words = st.sampled_from(["select", "SELECT", "With", "drop", "DELETE", "show", "what", "Update", "grant", "x", ""])
query_text = st.builds(lambda pad, w, rest: pad + w + rest, st.sampled_from(["", " ", "\t\n", "　", "\x1c"]),
                       words, st.sampled_from(["", " * FROM t", "\tcount(*)", " me all", " rows"]))


@settings(**SETTINGS)
@given(st.lists(query_text, min_size=20, max_size=60))
def test_router_column_and_function_agree(spark, values):
    from refinery.functions import sqlguard as sg
    assert _apply(spark, values, sg.is_natural_language_col) == [sg.is_natural_language(v) for v in values]
