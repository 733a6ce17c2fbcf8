"""Rows of a key: the first, the last, an upsert. All are partial aggregations, so that a hot key is reduced before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_of(df: DataFrame, order: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in order])


def first_rows(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order_of(df, order)).alias("_r"))
    return picked.select(*key, "_r.*").select(*df.columns)


def last_rows(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), order_of(df, order)).alias("_r"))
    return picked.select(*key, "_r.*").select(*df.columns)


def last_values(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key at the place of the first: the order columns are those of the first."""
    rest = [c for c in df.columns if c not in key and c not in order]
    o = order_of(df, order)
    picked = df.groupBy(*key).agg(F.max_by(F.struct(*rest), o).alias("_r"), F.min(o).alias("_o")) if rest else df.groupBy(*key).agg(F.min(o).alias("_o"))
    return picked.select(*key, *(["_r.*"] if rest else []), "_o.*").select(*df.columns)


def upsert(df: DataFrame, key: Sequence[str], order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row a key: of each field the first value that is not empty, in the order of arrival; and the first place."""
    o = order_of(df, order)
    value = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", o)).alias(c)
    return df.groupBy(*key).agg(*[value(c) for c in fields], F.min(o).alias("_o")).select(*key, *fields, "_o.*")


def looked_up(df: DataFrame, other: DataFrame, key: Sequence[str], order: Sequence[str], value: str, last: bool = False, default: str = "") -> DataFrame:
    """df with `value` of the first (or last) row of `other` with the same key; the default without one."""
    pick = F.max_by if last else F.min_by
    one = other.groupBy(*key).agg(pick(value, order_of(other, order)).alias(value))
    return df.join(one, list(key), "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def fallback(rows: DataFrame, other: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, and those of `other` for keys that have no row at all."""
    return rows.unionByName(other.join(rows.select(*key).distinct(), list(key), "left_anti"), allowMissingColumns=True)


def listed(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], value: Column, separator: str, name: str) -> DataFrame:
    """Texts of a key in order, joined."""
    items = F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") if isinstance(c, str) else c.alias(f"_{i}") for i, c in enumerate(order)], value.alias("_v")))
    return df.groupBy(*key).agg(F.array_join(F.sort_array(items)["_v"], separator).alias(name))
