"""Ordered functions over a key of any size: a scan in two levels (WIN1-4, WIN6-7, AGG12).

A window over one stimulus puts all its rows into one task. Here the rows of a key
are cut into buckets of the first order column (``width`` of it each), ordinary
windows run inside (key, bucket), and what one bucket hands to the next, a value
or a sum, is computed on a table with one row a bucket and joined back on (key,
bucket). Rows are shuffled once, by (key, bucket); only the table of buckets is
ever sorted by key alone.

Frames of so many rows before and after (``in_blocks``) first number the rows of a
key by a running count, then cut by number, so that blocks are equal, and copy the
few rows that a neighbour's frames reach.

The scan reads its rows twice. Where stimuli are short, ``width`` None takes one
window a key instead, which reads them once.

The order must be total; NULL keys are a key of their own, and rows whose first
order column is NULL come before all others of their key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"


@dataclass(frozen=True)
class Lag:
    """The value of the row before; NULL for the first row of a key."""

    value: str


@dataclass(frozen=True)
class Running:
    """The sum up to and with this row; NULL values count as 0."""

    value: str


@dataclass(frozen=True)
class LastBefore:
    """The last value that is not NULL among the rows before."""

    value: str


def bucket(order: str | Column, width: float) -> Column:
    return F.floor((F.col(order) if isinstance(order, str) else order).cast("double") / width)


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of columns of two tables, NULL equal to NULL."""
    out = F.lit(True)
    for n in names:
        out = out & left[n].eqNullSafe(right[n])
    return out


def scan(df: DataFrame, key: str | list[str], order: list[str], width: float | None, **wanted: Lag | Running | LastBefore) -> DataFrame:
    """``df`` with a column for each of ``wanted``, computed in ``order`` inside ``key``."""
    keys = [key] if isinstance(key, str) else list(key)
    if width is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
        whole = {Lag: lambda v: F.lag(v).over(w), Running: lambda v: F.sum(F.coalesce(v, F.lit(0))).over(upto), LastBefore: lambda v: F.last(v, ignorenulls=True).over(before)}
        return df.select(*[c for c in df.columns if c not in wanted], *[whole[type(op)](F.col(op.value)).alias(n) for n, op in wanted.items()])
    parts = [*keys, BUCKET]
    rows = df if BUCKET in df.columns else df.withColumn(BUCKET, bucket(order[0], width))
    inside = Window.partitionBy(*parts).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(BUCKET)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    last = F.struct(*order)
    sums, carried, own, final = [], [], [], {}
    for name, op in wanted.items():
        v = F.col(op.value)
        if isinstance(op, Running):
            filled = F.coalesce(v, F.lit(0))
            sums.append(F.sum(filled).alias(f"_s_{name}"))
            carried.append(F.sum(f"_s_{name}").over(earlier).alias(f"_c_{name}"))
            own.append(F.sum(filled).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_o_{name}"))
            final[name] = F.col(f"_o_{name}") + F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        elif isinstance(op, LastBefore):
            sums.append(F.max_by(v, F.when(v.isNotNull(), last)).alias(f"_s_{name}"))
            carried.append(F.last(f"_s_{name}", ignorenulls=True).over(earlier).alias(f"_c_{name}"))
            own.append(F.last(v, ignorenulls=True).over(before).alias(f"_o_{name}"))
            final[name] = F.coalesce(f"_o_{name}", f"_c_{name}")
        else:
            sums.append(F.max_by(F.struct(v.alias("v")), last).alias(f"_s_{name}"))
            carried.append(F.lag(f"_s_{name}.v").over(across).alias(f"_c_{name}"))
            own.append(F.when(F.row_number().over(inside) > 1, F.struct(F.lag(v).over(inside).alias("v"))).alias(f"_o_{name}"))
            final[name] = F.when(F.col(f"_o_{name}").isNotNull(), F.col(f"_o_{name}.v")).otherwise(F.col(f"_c_{name}"))
    table = rows.groupBy(*parts).agg(*sums).select(*parts, *carried)
    table = table.select(*[F.col(p).alias(f"_k{i}") for i, p in enumerate(parts)], *[f"_c_{n}" for n in wanted])
    ranked = rows.select("*", *own)
    match = F.lit(True)
    for i, p in enumerate(parts):
        match = match & ranked[p].eqNullSafe(table[f"_k{i}"])
    return ranked.join(table, match, "left").select(*[c for c in rows.columns if c not in wanted], *[e.alias(n) for n, e in final.items()])


def numbered(df: DataFrame, key: str | list[str], order: list[str], width: float | None, name: str = "_n") -> DataFrame:
    """Rows of each key numbered from 0."""
    one = scan(df.withColumn("_one", F.lit(1)), key, order, width, **{name: Running("_one")})
    return one.withColumn(name, F.col(name) - 1).drop("_one")


def in_blocks(df: DataFrame, key: str, order: list[str], width: float | None, before: int, after: int, size: int = 65_536) -> tuple[DataFrame, Window, Column]:
    """(rows, window, mine): rows numbered as ``_n`` in equal blocks with copies at the seams.

    Frames of at most ``before`` rows before and ``after`` rows after, over
    ``window``, are whole for the rows where ``mine`` holds; the others are copies.
    """
    size = max(size, before + after + 1)
    rows = numbered(df, key, order, width).drop(BUCKET)
    block = F.floor(F.col("_n") / size)
    reached = F.sequence(F.greatest(F.floor((F.col("_n") - after) / size), F.lit(0)), F.floor((F.col("_n") + before) / size))
    copied = rows.withColumn("_block", F.explode(reached))
    return copied, Window.partitionBy(key, "_block").orderBy("_n"), F.col("_block") == block
