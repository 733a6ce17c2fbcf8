"""Numbers, headers and blocks of rows in order, without a task that holds a whole scope.

Rows are sorted into ranges of bounded size by scope and order and written once. What a range adds (its rows, its
headers, its last header) is one row a scope and range; sums of these over the ranges before give each range what it
starts with. A scope may hold any share of the rows. Rows must differ in scope and order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import shared_table

#: Rows that a range holds on average.
ROWS = 100_000
#: Beyond so many ranges their number grows with the square root of the rows, and with it what the driver gets of each: its sampled limits and results. Longer ranges are sorted with spills.
RANGES = 100
PART = "__part"


def ranges(n: int, rows: int) -> int:
    """Into how many ranges n rows are dealt."""
    wanted = max(1, -(-n // rows))
    return wanted if wanted <= RANGES else math.ceil(math.sqrt(RANGES * wanted))


def in_ranges(df: DataFrame, scope: list[str], order: list[str], rows: int) -> DataFrame:
    # The rows are made once; their count, the sample of limits and the ranges read them.
    df = shared_table(df)
    parts = ranges(df.count(), rows)
    return shared_table(df.repartitionByRange(parts, *scope, *order).withColumn(PART, F.spark_partition_id()))


def _start(totals: DataFrame, scope: list[str], values: dict[str, Column]) -> DataFrame:
    """What stands before each range of a scope: a row for each range that the scope lies in."""
    before = Window.partitionBy(*scope).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(scope)], F.col(PART).alias("__in"), *[v.over(before).alias(f"__{n}") for n, v in values.items()])


def _joined(rows: DataFrame, start: DataFrame, scope: list[str]) -> DataFrame:
    same = F.col(PART) == F.col("__in")
    for i, c in enumerate(scope):
        same &= F.col(c).eqNullSafe(F.col(f"__{i}"))
    return rows.join(start, same)


def numbered(df: DataFrame, scope: list[str], order: list[str], name: str = "at", rows: int = ROWS) -> DataFrame:
    """Adds the number of each row in its scope, from 0."""
    sorted_ = in_ranges(df.drop(name), scope, order, rows)
    start = _start(sorted_.groupBy(*scope, PART).agg(F.count("*").alias("n")), scope, {"n": F.sum("n")})
    here = F.row_number().over(Window.partitionBy(PART, *scope).orderBy(*order)) - 1
    out = _joined(sorted_.withColumn(name, here), start, scope)
    return out.withColumn(name, (F.col(name) + F.coalesce("__n", F.lit(0))).cast("long")).select(*sorted_.drop(PART).columns, name)


def carried(df: DataFrame, scope: list[str], order: list[str], header: Column, name: str = "header", block: str = "block", rows: int = ROWS) -> DataFrame:
    """Adds the last header at or before each row (`header` is null for rows that are none) and how many there have been; 0 says that none has come yet."""
    sorted_ = in_ranges(df.drop(name, block).withColumn("__header", header), scope, order, rows)
    at = F.struct(*order)
    totals = sorted_.groupBy(*scope, PART).agg(F.count("__header").alias("n"), F.max_by("__header", F.when(F.col("__header").isNotNull(), at)).alias("h"))
    start = _start(totals, scope, {"n": F.sum("n"), "h": F.last("h", True)})
    here = Window.partitionBy(PART, *scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = sorted_.withColumn(name, F.last("__header", True).over(here)).withColumn(block, F.count("__header").over(here))
    out = _joined(own, start, scope).withColumn(name, F.coalesce(name, "__h")).withColumn(block, (F.col(block) + F.coalesce("__n", F.lit(0))).cast("long"))
    return out.select(*sorted_.drop(PART, "__header").columns, name, block)


def pieces(ranged: DataFrame, key: list[str], order: list[str], value: Column, separator: str) -> DataFrame:
    """(key, part, piece) from rows of `in_ranges`: the texts of a key in a range, in order, joined. A task holds the rows of some ranges, not those of a key; pieces in order of `part` and joined again are the text of all."""
    items = F.collect_list(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], value.alias("_v")))
    return ranged.where(value.isNotNull()).groupBy(*key, F.col(PART).alias("part")).agg(F.array_join(F.sort_array(items)["_v"], separator).alias("piece"))


def joined_pieces(of: Column, separator: str) -> Column:
    """An aggregation of `pieces` where `of` holds; null without any."""
    found = F.sort_array(F.collect_list(F.when(of, F.struct("part", "piece"))))
    return F.when(F.size(found) > 0, F.array_join(found["piece"], separator))
