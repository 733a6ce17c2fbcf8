"""Cutting texts into lines, blocks and tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_match, last_match, lines, spread, trimmed

__all__ = ["first_match", "last_match", "by_line", "by_tokens", "by_block", "by_pattern", "keys_of", "tokens"]


def keys_of(df: DataFrame, text: str = "text") -> list[str]:
    return [c for c in df.columns if c != text]


def by_line(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line: item_ord, line (as it is) and bare (without white space at its ends)."""
    out = df.select(*keys_of(df, text), F.posexplode(lines(F.col(text))).alias("item_ord", "line"))
    return out.withColumn("bare", trimmed(F.col("line")))


def by_tokens(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each line: item_ord, bare and its tokens t. They are made where lines are cut, as filters would make columns of a select anew at each mention."""
    cut = F.transform(lines(F.col(text)), lambda x: F.struct(trimmed(x).alias("bare"), tokens(x).alias("t")))
    return df.select(*keys_of(df, text), F.posexplode(cut).alias("item_ord", "_line")).select(*keys_of(df, text), "item_ord", "_line.bare", "_line.t")


def by_block(df: DataFrame, header: str, text: str = "text", outer: str | None = None) -> DataFrame:
    """A row for each block that begins with a line that matches the header: item_ord and block. What stands before the first header is left out."""
    whole = F.coalesce(text, F.lit(""))
    cut = F.split(whole, rf"(?m)(?=^(?:{header}))")
    # Every piece but the first begins with a header.
    kept = F.when(F.regexp_like(whole, F.lit(rf"(?m)\A(?:{header})")), cut).otherwise(F.slice(cut, 2, 1 << 30))
    place = "item_ord" if outer is None else outer
    return df.select(*keys_of(df, text), F.posexplode(kept).alias(place, "block"))


def by_pattern(df: DataFrame, pattern: str, fields: dict[str, int], where: Column | None = None, numbers: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """A row for each line that the pattern matches from its start: fields are its groups, '' for those that take no part."""
    rows = by_line(df, text).where(F.regexp_like("line", F.lit(f"^(?:{pattern})")))
    if where is not None:
        rows = rows.where(where)
    take: Callable[[int], Column] = lambda g: F.regexp_extract("line", f"^(?:{pattern})", g)
    named = {name: take(g).cast("bigint") if name in numbers else take(g) for name, g in fields.items()}
    return rows.select(*keys_of(df, text), "item_ord", *[c.alias(name) for name, c in named.items()])


def tokens(line: Column) -> Column:
    return spread(line)
