"""Texts: first and last matches, numbers that may not parse, lists that may be scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(*columns: Column | str) -> Column:
    """The first alternate that is there, even if it is empty; else ''."""
    return F.coalesce(*[F.col(c) if isinstance(c, str) else c for c in columns], F.lit(""))


def filled(*columns: Column | str) -> Column:
    """The first alternate that is neither null nor empty; else ''."""
    return F.coalesce(*[F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns], F.lit(""))


def whole(c: Column) -> Column:
    """An integer, or null where the text is none."""
    return F.trim(c.cast("string")).try_cast("bigint")


def whole_or_zero(c: Column) -> Column:
    return F.coalesce(whole(c), F.lit(0).cast("bigint"))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(1))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "Yes").otherwise("No")


def joined(values: Column, separator: str = ", ") -> Column:
    """A list as text; null as ''."""
    return F.coalesce(F.array_join(values.cast("array<string>"), separator), F.lit(""))


def without_controls(c: Column) -> Column:
    """Without the control characters that XML does not allow, and without DEL to U+009F."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")


def masked(c: Column, shown: int = 4) -> Column:
    """What is shown of a credential: its last characters."""
    return F.right(c, F.lit(shown))


def without_keys(c: Column) -> Column:
    """Without what stands after the word key."""
    return F.regexp_replace(c, r"key\s+\S+", "key <REDACTED>")


def prompt_name(c: Column) -> Column:
    """The host name of a prompt."""
    return F.trim(F.regexp_replace(F.trim(c), "[#>]+$", ""))


def trimmed(line: Column) -> Column:
    """A line without white space at its ends; within lines that is blanks and tabs."""
    return F.btrim(line, F.lit(" \t"))


def spread(text: Column) -> Column:
    """Tokens between white space; a split at one character takes no pattern, which would be compiled for each text."""
    for c in "\t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def plain_breaks(text: Column) -> Column:
    """A text, '' for null, whose lines end in line feeds alone."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.regexp_like(text, F.lit(r"[\r\x0b\f\x85\u2028\u2029]")), F.regexp_replace(text, r"\R", "\n")).otherwise(text)


def lines(text: Column) -> Column:
    return F.split(plain_breaks(text), "\n")
