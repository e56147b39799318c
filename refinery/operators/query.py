"""data.query and data.fetch: guarded SQL, equality-filtered fetches, paging, totals."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refinery.functions import sqlguard
from refinery.operators import pages

MAX_ROWS = 10_000  # request bound on rows returned by a query or fetch


def _check_limit(limit: int) -> int:
    if not 1 <= int(limit) <= MAX_ROWS:
        raise ValueError(f"limit must be in 1..{MAX_ROWS}")
    return int(limit)


def run_query(spark: SparkSession, query: str, mode: str = "auto", limit: int = 100,
              nl_to_sql: Callable[[str], str] | None = None) -> DataFrame:
    """Route text to SQL, refuse whatever changes something, and return at most
    ``limit`` rows unless the query has a LIMIT of its own at the top.

    Natural-language text needs an ``nl_to_sql`` translator (none is bundled). The
    cap looks at the parsed plan, so a column named ``credit_limit`` does not switch
    it off; Spark plans it as a (Take)OrderedAndProject / CollectLimit.
    """
    limit = _check_limit(limit)
    if mode not in ("auto", "nlq", "sql"):
        raise ValueError("mode must be auto, nlq or sql")
    use_nl = sqlguard.is_natural_language(query) if mode == "auto" else mode == "nlq"
    if use_nl:
        if nl_to_sql is None:
            raise NotImplementedError("natural-language queries need an nl_to_sql translator")
        sql = nl_to_sql(query)
    else:
        sql = query
    sql = sql.strip().rstrip(";")
    plan = sqlguard.require_read_only(spark, sql)
    rows = spark.sql(sql)
    return rows if sqlguard.has_limit(plan) else rows.limit(limit)


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Batch/analytic entry point: the same read-only guard, no row cap (the
    result is meant to be written or aggregated, not returned to a caller)."""
    sql = sql.strip().rstrip(";")
    sqlguard.require_read_only(spark, sql)
    return spark.sql(sql)


def equality_filter(df: DataFrame, filters: dict | None) -> DataFrame:
    """AND of ``column <=> value``; column names are resolved against the schema
    (never spliced into SQL text). A null value matches null cells."""
    if not filters:
        return df
    unknown = [k for k in filters if k not in df.columns]
    if unknown:
        raise ValueError(f"unknown filter column(s): {unknown}")
    cond = reduce(lambda a, b: a & b,
                  [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in filters.items()])
    return df.where(cond)


def fetch_rows(df: DataFrame, filters: dict | None = None, limit: int = 100, offset: int = 0,
               order_by: list[str] | None = None) -> DataFrame:
    """One page of a filtered table. Pages are only stable with an ordering, so
    the page is taken over ``order_by`` (default: all columns). Deep pages are located by
    counts (``pages``), so no task sorts past more than ``pages.SORTED`` rows."""
    limit = _check_limit(limit)
    if offset < 0:
        raise ValueError("offset must be >= 0")
    rows = equality_filter(df, filters)
    keys = order_by or rows.columns
    if offset > pages.SORTED:
        return pages.page(rows, keys, offset, limit)
    return rows.orderBy(*[F.col(f"`{k}`") for k in keys]).offset(offset).limit(limit)


def fetch_after(df: DataFrame, key: str, last_value, limit: int = 100,
                filters: dict | None = None) -> DataFrame:
    """Keyset paging for deep pages: rows with ``key > last_value``; with a sorted
    or range-partitioned table this is a pushed-down range scan, not an offset."""
    limit = _check_limit(limit)
    rows = equality_filter(df, filters)
    if last_value is not None:
        rows = rows.where(F.col(f"`{key}`") > F.lit(last_value))
    return rows.orderBy(F.col(f"`{key}`")).limit(limit)


def total_available(df: DataFrame, filters: dict | None = None) -> DataFrame:
    """Row count after the filters (one partial+final aggregate)."""
    return equality_filter(df, filters).agg(F.count(F.lit(1)).alias("total_available"))


def route_queries(log: DataFrame, text_col: str = "query") -> DataFrame:
    """Audit a query log: first word, NL-vs-SQL route and guard verdict per row."""
    q = F.col(text_col)
    return log.withColumn("first_word", sqlguard.first_word(q)) \
              .withColumn("is_natural_language", sqlguard.is_natural_language_col(q)) \
              .withColumn("forbidden_keyword", sqlguard.forbidden_word_col(q))
