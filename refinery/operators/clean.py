"""pipeline.clean: standardise dates, phones, e-mails, currencies and text case.

Narrow operator: one projection, no shuffle. The report is an aggregate over
two per-row audit columns, so data and report can come from a single scan
(``clean_with_audit`` + ``clean_report`` or ``DataFrame.observe``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refinery.functions import text as tx
from refinery.session import cached_columns

NULLS_COL = "_nulls_filled"
CHANGED_COL = "_formats_standardized"


def detect_rules(df: DataFrame) -> dict[str, str]:
    """Rule auto-detection from field names only (plan time, no data read)."""
    out = {}
    for name in df.columns:
        rule = tx.detect_rule(name)
        if rule:
            out[name] = rule
    return out


def _is_empty(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return c.isNull() | (c == "")
    return c.isNull()


def _clean_column(c: Column, stripped: Column, dtype: T.DataType, rule: str) -> tuple[Column, Column, Column]:
    """Returns (new value, null-filled flag, changed flag). ``stripped`` is the
    value already cast to text and stripped by an earlier projection (for the
    currency rule: the number it denotes, parsed by an earlier projection)."""
    empty = _is_empty(c, dtype)
    default = tx.DEFAULTS.get(rule, "")
    fn = tx.currency_from_number if rule == "currency" else tx.RULES_ON_STRIPPED.get(rule)
    if fn is None:  # unknown rule: value kept, nulls still filled
        if not isinstance(dtype, T.StringType):  # a default text would change the column's type
            return c, F.lit(False), F.lit(False)
        return F.when(empty, F.lit(default)).otherwise(c), empty, F.lit(False)
    new = fn(stripped)
    if rule == "currency":
        changed = tx.currency_changed(c, dtype.simpleString(), new)
    else:
        changed = new != c.cast("string")
    value = F.when(empty, F.lit(default)).otherwise(new)
    return value, empty, (~empty) & changed


def _cached_clean_column(field: str, prepared: str, dtype: T.DataType, rule: str):
    """The trees for one (field, rule) reference columns by name only, so they
    are built once per application and reused by every query."""
    return cached_columns(("clean", field, prepared, dtype.simpleString(), rule),
                          lambda: _clean_column(F.col(f"`{field}`"), F.col(prepared), dtype, rule))


def clean_with_audit(df: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Apply ``rules`` (field -> rule name); empty/None rules are auto-detected.

    Adds two int audit columns (nulls filled, formats standardised per row).
    Fields not present in the DataFrame are skipped.
    """
    if not rules:
        rules = detect_rules(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    applied = {f: r for f, r in rules.items() if f in types}
    # Strip once per field in its own projection (and, for currency, parse the
    # number in the next one); the optimizer keeps these projections separate
    # because the rules reference their outputs many times, so each is computed
    # once per row and the generated code stays small.
    staged = df.select("*", *[tx.ustrip(F.col(f"`{f}`").cast("string")).alias(f"__s{i}")
                              for i, f in enumerate(applied)])
    staged = staged.select("*", *[tx.number_from_stripped(F.col(f"__s{i}")).alias(f"__n{i}")
                                  for i, (f, r) in enumerate(applied.items()) if r == "currency"])
    nulls, changed, exprs = [], [], {}
    for i, (field, rule) in enumerate(applied.items()):
        prepared = f"__n{i}" if rule == "currency" else f"__s{i}"
        value, was_null, was_changed = _cached_clean_column(field, prepared, types[field], rule)
        exprs[field] = value
        nulls.append(was_null.cast("int"))
        changed.append(was_changed.cast("int"))
    cols = [exprs[n].alias(n) if n in exprs else F.col(f"`{n}`") for n in df.columns]
    zero = F.lit(0)
    cols.append((sum(nulls[1:], nulls[0]) if nulls else zero).alias(NULLS_COL))
    cols.append((sum(changed[1:], changed[0]) if changed else zero).alias(CHANGED_COL))
    return staged.select(*cols)


def clean(df: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    return clean_with_audit(df, rules).drop(NULLS_COL, CHANGED_COL)


def clean_report(audited: DataFrame) -> DataFrame:
    """One-row report from a ``clean_with_audit`` output (single aggregate, partial+final)."""
    return audited.agg(
        F.count(F.lit(1)).alias("records_in"),
        F.count(F.lit(1)).alias("records_out"),
        F.coalesce(F.sum(NULLS_COL), F.lit(0)).cast("bigint").alias("nulls_filled"),
        F.coalesce(F.sum(CHANGED_COL), F.lit(0)).cast("bigint").alias("formats_standardized"),
    )
