"""Pages at any offset of an ordered table, without sorting what stands before them.

``orderBy(...).offset(o).limit(n)`` keeps o + n rows in every task and merges them in one.
Here the row at the offset is located first: a sample of the order keys gives bounds, one
aggregate counts the rows between them and at each of them, and the interval that holds the
offset is cut again, until at most ``SORTED`` rows of it stand before the page. Every step is
a scan and an aggregate of at most 2 * BOUNDS + 1 counts; no row is shuffled. The result does
not depend on the sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of one step, and order keys sampled to choose them.
BOUNDS = 63
SAMPLE = 4096

#: Rows before the page that the last step may sort past.
SORTED = 1 << 16

_UNORDERED = (T.MapType, T.ArrayType, T.StructType, T.VariantType)


def _literal(value, kind: T.DataType) -> Column:
    if value is not None and isinstance(kind, T.TimestampNTZType):
        value = value.isoformat()  # a naive time must not pass through the driver's zone
    elif isinstance(value, bytearray):
        value = bytes(value)
    return F.lit(value).cast(kind)


def _bucket(key: Column, bounds: list[Column], first: int = 0) -> Column:
    """2i between bounds i - 1 and i, 2i + 1 at bound i, by halving."""
    if not bounds:
        return F.lit(2 * first)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _bucket(key, bounds[:mid], first)) \
        .when(key == bounds[mid], F.lit(2 * (first + mid) + 1)) \
        .otherwise(_bucket(key, bounds[mid + 1:], first + mid + 1))


def page(rows: DataFrame, order_by: list[str], offset: int, limit: int, sorted_rows: int = SORTED) -> DataFrame:
    """Rows offset .. offset + limit - 1 in ascending order of ``order_by`` (nulls first).

    Ties are ordered by the other columns, except nested ones (ties in all but those are in
    any order). Rows equal in all of these may be any share of the table: they are counted,
    not sorted. An offset beyond the end gives no rows.
    """
    unknown = [c for c in order_by if c not in rows.columns]
    if unknown:
        raise ValueError(f"unknown column(s): {unknown}")
    if offset < 0 or limit < 0:
        raise ValueError("offset and limit must be >= 0")
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    names = list(order_by) + [c for c, kind in kinds.items() if c not in order_by and not isinstance(kind, _UNORDERED)]
    keyed = [F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
             F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)]).alias("key")]
    key = F.col("key")

    def literal(values) -> Column:
        return F.struct(*[_literal(v, kinds[c]).alias(f"k{i}") for i, (c, v) in enumerate(zip(names, values))])

    def after(values, inclusive: bool = False) -> DataFrame:
        """The rows after a key; the leading column's part of the condition reaches the scan
        (not for floating point: statistics of files and caches leave NaN out)."""
        found = rows if values is None or values[0] is None or isinstance(kinds[names[0]], (T.FloatType, T.DoubleType)) else \
            rows.where(F.col(f"`{names[0]}`") >= _literal(values[0], kinds[names[0]]))
        found = found.select(*keyed)
        return found if values is None else found.where(key >= literal(values) if inclusive else key > literal(values))

    low = high = None
    skip, size = offset, None
    if skip > sorted_rows:
        size = rows.count()
        if skip >= size:
            return rows.limit(0)
    while skip > sorted_rows:
        piece = after(low)
        piece = piece if high is None else piece.where(key < literal(high))
        some = piece.select("key.*").sample(min(1.0, SAMPLE / size), 17).collect() or piece.select("key.*").take(1)
        ordered = sorted({tuple(r) for r in some}, key=lambda r: [_rank(v) for v in r])
        step = max(1, -(-len(ordered) // BOUNDS))
        bounds = ordered[step // 2::step]
        counts = dict(map(tuple, piece.groupBy(_bucket(key, [literal(b) for b in bounds]).alias("b")).count().collect()))
        for b in sorted(counts):
            if skip < counts[b]:
                break
            skip -= counts[b]
        at, size = b // 2, counts[b]
        if b % 2:  # the page begins among rows that are equal to a bound
            equal = after(bounds[at], True).where(key == literal(bounds[at])).limit(min(limit, size - skip))
            more = limit - min(limit, size - skip)
            return (equal.unionByName(_sorted(after(bounds[at]), 0, more)) if more else equal).select("row.*")
        low = bounds[at - 1] if at else low
        high = bounds[at] if at < len(bounds) else high
    return _sorted(after(low), skip, limit).select("row.*")


def _sorted(keyed: DataFrame, skip: int, limit: int) -> DataFrame:
    return keyed.orderBy("key").offset(skip).limit(limit)


def _rank(value) -> tuple:
    """Spark's order of collected values: nulls first, NaN last, text by its UTF-8 bytes."""
    if value is None:
        return (0,)
    if isinstance(value, float) and value != value:
        return (2,)
    return (1, value.encode() if isinstance(value, str) else bytes(value) if isinstance(value, bytearray) else value)
