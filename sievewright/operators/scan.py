"""Numbers and running sums along an order, in two levels: within ranges of rows, then over the ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored, unused

#: Bits of monotonically_increasing_id that count rows within a partition.
_ROW_BITS = 33


def ordered(df: DataFrame, keys: Sequence[Column]) -> tuple[DataFrame, str, str]:
    """df dealt to ranges of `keys`, sorted within each and written: (rows, name of the range, name of the place in it).

    One exchange of all columns. The place is given while the sorted range is written, so nothing is sorted or dealt
    again. Rows that are equal in every key share a range, so let the keys end with something that tells them apart. The
    written table fixes ranges and places: a range partitioner samples anew each time that it runs.
    """
    part, pos, at = unused(df, "_part", "_pos", "_at")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, *keys)
    rows = rows.sortWithinPartitions(*keys).withColumn(at, F.monotonically_increasing_id())
    rows = rows.withColumn(part, F.shiftright(at, _ROW_BITS).cast("int")).withColumn(pos, F.col(at).bitwiseAND(2**_ROW_BITS - 1))
    return stored(rows.drop(at), "ordered"), part, pos


def _first(by: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`").asc_nulls_first() for c in by]


def _with_blocks(rows: DataFrame, part: str, by: Sequence[str], sums: Mapping[str, Column], pos: str, taken: Sequence[str | None]) -> tuple[DataFrame, dict[str, str]]:
    """rows with, for each block (a group's rows of one range): `first` place, and n and sums of the group's blocks before
    it, and the group's `total`. A row for each block at most, so a group of any size is many blocks in many tasks."""
    taken = [x for x in taken if x]
    names = unused(rows, *taken, "_first", "_before", "_total", *(f"_sum_{k}" for k in range(len(sums))), *(f"_by_{k}" for k in range(len(by))), "_range")[len(taken) :]
    first, before, total = names[:3]
    held, keys, at = names[3 : 3 + len(sums)], names[3 + len(sums) : -1], names[-1]
    groups = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)]
    blocks = rows.groupBy(F.col(part).alias(at), *groups).agg(
        F.min(pos).alias(first), F.count("*").alias("n"), *(F.sum(v).alias(h) for h, v in zip(held, sums.values()))
    )
    # Without groups the only window without a key: a row for each range.
    group = Window.partitionBy(*keys)
    earlier = group.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        at, *keys, first,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before),
        F.sum("n").over(group).alias(total),
        *(F.sum(h).over(earlier).alias(h) for h in held),
    )
    same = F.col(part) == F.col(at)
    for c, k in zip(by, keys):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(k))
    return rows.join(blocks, same).drop(at, *keys), {"first": first, "before": before, "total": total} | dict(zip(sums, held))


def numbered(df: DataFrame, name: str, keys: Sequence[Column], by: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """df with `name`: the number of each row from 0 among those of its group, in the order of `keys`.

    by: the group's columns, nulls a group like another; none of them: all rows. total: a column with the rows of the
    group. All columns are exchanged once; a group of any size fills as many tasks as its ranges.
    """
    rows, part, pos = ordered(df, [*_first(by), *keys])
    rows, at = _with_blocks(rows, part, by, {}, pos, [name, total])
    rows = rows.withColumn(name, F.col(pos) - F.col(at["first"]) + F.col(at["before"]))
    if total:
        rows = rows.withColumn(total, F.col(at["total"]))
    return rows.drop(part, pos, *at.values())


def running(df: DataFrame, sums: Mapping[str, Column], keys: Sequence[Column], by: Sequence[str] = (), number: str | None = None, total: str | None = None) -> DataFrame:
    """df with running sums, this row included, within each group in the order of `keys`; `number` and `total` as above.

    sums: expressions by the names of the new columns; exact types (integers, decimals) give the same sums however the
    rows are dealt. A sum over nulls alone is null. Windows run within blocks only, never over a whole group.
    """
    exprs = unused(df, *(f"_x_{k}" for k in range(len(sums))))
    rows, part, pos = ordered(df.select("*", *(v.alias(x) for x, v in zip(exprs, sums.values()))), [*_first(by), *keys])
    rows, at = _with_blocks(rows, part, by, {name: F.col(x) for name, x in zip(sums, exprs)}, pos, [*sums, number, total])
    block = Window.partitionBy(part, *(f"`{c}`" for c in by)).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    for name, x in zip(sums, exprs):
        own, past = F.sum(x).over(block), F.col(at[name])
        rows = rows.withColumn(name, F.when(own.isNotNull() | past.isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(past, F.lit(0))))
    if number:
        rows = rows.withColumn(number, F.col(pos) - F.col(at["first"]) + F.col(at["before"]))
    if total:
        rows = rows.withColumn(total, F.col(at["total"]))
    return rows.drop(part, pos, *exprs, *at.values())
