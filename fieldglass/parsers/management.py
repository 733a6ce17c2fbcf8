"""Time, logging, SNMP and AAA. Communities and keys are never kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import without_keys
from .base import by_pattern, first_match, keys_of

# Commands whose output may hold secrets.
SECRET_COMMANDS = ["show snmp", "show running-config | section aaa"]


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _has(pattern: str) -> Column:
    return F.regexp_like(_text(), F.lit(pattern))


def _found(pattern: str) -> Column:
    return F.trim(F.coalesce(first_match(_text(), pattern), F.lit("")))


def redacted(raw: DataFrame) -> DataFrame:
    """Raw outputs (command, text) without the texts of commands that show secrets; to be applied before anything is written."""
    return raw.withColumn("text", F.when(F.col("command").isin(SECRET_COMMANDS), "<REDACTED>").otherwise(F.col("text")))


def ntp_status(df: DataFrame) -> DataFrame:
    return df.select(*keys_of(df), _has("(?i)Clock is synchronized").alias("synchronized"), _found(r"(?i)stratum\s+(\d+)").alias("stratum"), _found(r"(?i)reference is\s+(\S+)").alias("reference"))


def ntp_peers(df: DataFrame) -> DataFrame:
    """show ntp associations or peer-status."""
    pattern = r"([*+\-~# ]{0,3}?)(\d+\.\d+\.\d+\.\d+|\S+\.\S+)\s+(\S+)\s+(\d+)\s+(\S+)\s+\S+\s+(\S+)"
    return by_pattern(df, pattern, {"remote": 2, "stratum": 4, "when": 5, "reach": 6, "status": 1}).withColumn("status", F.trim("status"))


def logging(df: DataFrame) -> DataFrame:
    size = F.coalesce(first_match(_text(), r"(?i)Buffer logging.*?(\d+[\s\S]*?bytes?)"), first_match(_text(), r"(?i)Log Buffer.*?:\s*(\d+)"), F.lit(""))
    return df.select(*keys_of(df), _has(r"(?i)Logging\s+(is\s+)?on").alias("logging_on"), F.trim(size).alias("buffer_size"), F.regexp_extract_all(_text(), F.lit(r"(?i)Logging to (\S+)"), F.lit(1)).alias("hosts"), _found(r"(?i)Trap logging:\s+level\s+(\w+)").alias("trap_level"))


def snmp(df: DataFrame) -> DataFrame:
    """Whether communities and version 3 are there, with contact and location; never a community."""
    return df.select(*keys_of(df), _has("(?i)community").alias("communities_detected"), _has(r"(?i)snmpv3|v3\s+group|engineID").alias("v3_configured"), _found(r"(?i)contact:\s*(.+)").alias("contact"), _found(r"(?i)location:\s*(.+)").alias("location"))


def aaa(df: DataFrame, sessions: str = "sessions", config: str = "config") -> DataFrame:
    """Sessions and methods from two texts a row; a total of sessions counts before counted lines."""
    keys = [c for c in df.columns if c not in (sessions, config)]
    bare = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), r"\R"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    seen = F.filter(bare(sessions), lambda x: (x != "") & ~F.regexp_like(x, F.lit("^(?:Total|---)")) & F.regexp_like(x, F.lit(r"^\d+|^\S+\s+\S+\s+\S+")))
    total = first_match(F.coalesce(sessions, F.lit("")), r"(?i)Total\s+sessions:\s*(\d+)").cast("bigint")
    own = bare(config)
    login = r"^aaa authentication\s+(\S+)\s+(\S+)\s+(.+)"
    methods = F.transform(
        F.filter(own, lambda x: F.regexp_like(x, F.lit(login))),
        lambda x: F.struct(F.regexp_extract(x, login, 1).alias("type"), F.regexp_extract(x, login, 2).alias("list_name"), without_keys(F.trim(F.regexp_extract(x, login, 3))).alias("methods")),
    )
    some = lambda p: F.exists(own, lambda x: F.regexp_like(x, F.lit(p)))
    return df.select(
        *keys, (F.trim(F.coalesce(config, F.lit(""))) != "").alias("aaa_configured"), methods.alias("authentication_methods"), some("^aaa authorization").alias("authorization_configured"), some("^aaa accounting").alias("accounting_configured"),
        some("(?i)tacacs").alias("tacacs_configured"), some("(?i)radius").alias("radius_configured"), F.coalesce(total, F.size(seen).cast("bigint")).alias("active_sessions"),
    )


__all__ = ["redacted", "ntp_status", "ntp_peers", "logging", "snmp", "aaa"]
