"""Side-by-side comparison of a registered Spark query and its DuckDB oracle."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

from refinery.session import TABLES

_FAMILY = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP", "float": "FLOAT", "date": "DATE",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


def compare(df, con, sql: str | None) -> tuple[int, list[str]]:
    """(spark row count, problems). ``sql=None`` only executes the Spark side."""
    cols = df.columns
    stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    srows = [tuple(_norm(r[c]) for c in sorted(cols)) for r in df.collect()]
    if sql is None:
        return len(srows), []
    rel = con.sql(sql)
    dcols = rel.columns
    dtypes = dict(zip(dcols, [str(t) for t in rel.types]))
    drows = [tuple(_norm(r[dcols.index(c)]) for c in sorted(dcols)) for r in rel.fetchall()]
    problems = []
    if sorted(cols) != sorted(dcols):
        problems.append(f"columns {sorted(cols)} vs {sorted(dcols)}")
        return len(srows), problems
    for c in cols:
        fam = _FAMILY.get(stypes[c])
        if fam and fam != dtypes[c] and not dtypes[c].startswith("DECIMAL"):
            problems.append(f"type {c}: {stypes[c]} vs {dtypes[c]}")
    if len(srows) != len(drows):
        problems.append(f"rows {len(srows)} vs {len(drows)}")
    else:
        a, b = sorted(srows, key=_key), sorted(drows, key=_key)
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        if diff:
            problems.append(f"values differ in {len(diff)} rows, e.g. {str(diff[0])[:600]}")
    return len(srows), problems
