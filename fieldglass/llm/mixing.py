"""Mixing sources to target weights, as a curriculum that varies over training.

Each source has a weight schedule over training time t in [0, 1]: w(t) = target * (1 + a * (2t - 1)), whose slope a
depends on its rank. Its integral is the source's cumulative token demand; inverting it at a document's place in its
source gives the document's training position, and a range sort by position gives the training order.

Targets share the sum of all sizes by weight; no target exceeds `most` times its source's size, and what is beyond is
shared again by weight until none is above. That is one level L with target = min(weight * L, most * size), found by
running sums over the sources in order of size to weight.

Documents of a source stand in hash order; the mix goes through them again and again until the target is reached, so
a document is taken floor(target / source size) times, or once more, and one document of each source in part. Places
come from counts by source and range of the hash, so no task holds a whole source; only the counts, one row a source
and range, are summed by source.

Null source is a source of its own, after all others; a null text has size 0 and is taken 0 times. Of a text only the
number of words matters, however long it is. Rows equal in the
keys are interchangeable; where there may be many, a column that numbers them (`sharding.numbered`) spreads them over the
ranges of their source. An empty table gives an empty result. Columns named like an output, or with the prefix __mix_ of
work columns, are dropped first; all others stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unreserved, written
from .sharding import numbered

# Weights of the sources in code point order, repeating, and slopes of their schedules.
WEIGHTS = [5, 2, 1]
SLOPES = [-0.5, 0.0, 0.5]
#: Times its size that a document is taken at most; rows that a range of a source holds on average if one source has all.
MOST, ROWS = 3, 4_000
#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: list[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> also __mix_rank, weight, target. There is one row a source; windows here run over sources, never over documents."""
    everything = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    listed = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("__mix_rank", rank).withColumn("weight", F.element_at(listed, (F.col("__mix_rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("__mix_cap", F.col("source_size") * float(most)).withColumn("__mix_ratio", F.col("__mix_cap") / F.col("weight"))
    order = everything.orderBy("__mix_ratio", "__mix_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    # The level if exactly the sources before this one, by ratio, stop at their caps.
    level = (total - F.coalesce(F.sum("__mix_cap").over(before), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("__mix_level", level)
    fits = F.min(F.when(F.col("__mix_level") <= F.col("__mix_ratio"), F.struct("__mix_ratio", "__mix_rank", "__mix_level"))).over(everything)
    return s.withColumn("target", F.coalesce(F.least("__mix_cap", F.col("weight") * fits["__mix_level"]), F.lit(0.0))).drop("__mix_cap", "__mix_ratio", "__mix_level")


def _placed(df: DataFrame, keys: list[str], size: str, seed: int, rows: int, most: int, copy: str | None) -> DataFrame:
    """df with source_size, target, taken, before and the rank of the source."""
    sums = df.groupBy("source").agg(F.sum(size).alias("source_size"))
    ranges = max(1, -(-df.count() // rows))
    source = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    goal = targets(sums).select(source.alias("__mix_source"), "source_size", "target", "__mix_rank")
    parts = [F.lit(str(seed)), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]]
    if copy:  # the first of equal rows stands where it would stand alone
        parts.append(F.when(F.col(copy) > 0, F.col(copy).cast("string")))
    placed = df.withColumn("__mix_source", source).withColumn("__mix_key", F.md5(F.concat_ws(":", *parts)))
    placed = placed.withColumn("__mix_range", F.floor(F.conv(F.substring("__mix_key", 1, 8), 16, 10).cast("double") / float(1 << 32) * ranges).cast("int"))
    by = ["__mix_source", "__mix_range"]
    counts = placed.groupBy(*by).agg(F.sum(size).alias("__mix_n"))
    earlier = Window.partitionBy("__mix_source").orderBy("__mix_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, F.coalesce(F.sum("__mix_n").over(earlier), F.lit(0)).alias("__mix_offset")).join(goal, "__mix_source")
    own = Window.partitionBy(*by).orderBy("__mix_key", *keys, *[copy] * bool(copy)).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("__mix_own", F.coalesce(F.sum(size).over(own), F.lit(0))).join(offsets, by)
    out = out.withColumn("before", F.col("__mix_offset") + F.col("__mix_own"))
    whole = F.floor("target")
    pass_ = lambda j: F.least(F.greatest(whole - F.lit(j) * F.col("source_size") - F.col("before"), F.lit(0)), F.col(size))
    taken = sum((pass_(j) for j in range(1, most)), pass_(0))
    return out.withColumn("taken", taken.cast("long")).drop(*by, "__mix_key", "__mix_own", "__mix_offset")


MIXED = ("source_size", "target", "taken", "before")


def mixed(df: DataFrame, keys: list[str], size: str = "size", seed: int = 11, rows: int = ROWS, most: int = MOST, copy: str | None = None) -> DataFrame:
    """Adds source_size, target, taken (words taken of the row) and `before` (words of its source before it). `copy` numbers rows equal in the keys."""
    return _placed(unreserved(df, "__mix_", *MIXED), keys, size, seed, rows, most, copy).drop("__mix_rank")


def position(demand: Column, target: Column, slope: Column) -> Column:
    """The training time at which a source's cumulative demand target * (t + a * (t * t - t)) reaches `demand`."""
    u = F.least(demand / target, F.lit(1.0))
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * u)
    return F.when(target > 0, 2 * u / ((1 - slope) + root)).otherwise(0.0)


def slope() -> Column:
    """The slope of the source's schedule, by its rank."""
    return F.element_at(F.array(*[F.lit(a) for a in SLOPES]), (F.col("__mix_rank") % len(SLOPES) + 1).cast("int"))


def schedule(df: DataFrame, keys: list[str], size: str = "size", seed: int = 11) -> DataFrame:
    """A row for each time a document is taken, with copy, copy_words and position. Documents without words come once, at their place."""
    out = _placed(unreserved(df, "__mix_", *MIXED, "copy", "copy_words", "position"), keys, size, seed, ROWS, MOST, None)
    copies = F.when(F.col(size) > 0, F.ceil(F.col("taken") / F.col(size))).otherwise(1).cast("int")
    out = out.withColumn("copy", F.explode(F.filter(F.sequence(F.lit(0), F.lit(MOST)), lambda i: i < copies)))
    out = out.withColumn("copy_words", F.least(F.col(size), F.col("taken") - F.col("copy") * F.col(size)))
    return out.withColumn("position", position(F.col("before") + F.col("copy") * F.col("source_size"), F.col("target"), slope())).drop("__mix_rank")


def training_order(scheduled: DataFrame, keys: list[str]) -> DataFrame:
    """The scheduled rows range-sorted by position."""
    return scheduled.orderBy("position", F.col("source").asc_nulls_last(), *keys, "copy")


def digest(df: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row, in order of its first training position."""
    sized = written(numbered(df.select("doc_id", "source", words(F.col("text")).alias("size"))))
    out = _placed(sized, ["doc_id", "size"], "size", 11, ROWS, MOST, "copy").withColumn("position", position(F.col("before"), F.col("target"), slope()))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position").repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
