"""Types of devices by patterns: a pattern table is looked for in platforms and descriptions."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import network as net

#: Type of devices that no pattern knows; score of a description against a platform.
DEFAULT_TYPE, DESCRIPTION_SHARE = "cisco_ios", 0.5
PATTERNS = "device_type string, type_ord int, kind string, pattern string, priority double"


# The configuration where no file can be read.
MINIMAL = {"device_types": {"cisco_ios": {"platforms": ["cisco", "catalyst"], "system_descriptions": ["IOS"], "priority": 50}}, "default_device_type": "cisco_ios"}


def read_config(spark: SparkSession, path: str) -> dict:
    """The configuration of a YAML or JSON file, read through Spark from wherever the path points; the minimal one where it is missing, broken or no map."""
    try:
        from yaml import YAMLError
        from yaml import safe_load as load
    except ImportError:  # JSON needs no library
        load, YAMLError = json.loads, ValueError
    try:
        config = load(spark.read.text(path, wholetext=True).first()["value"])
    except (AnalysisException, YAMLError, ValueError, TypeError):
        return MINIMAL
    return config if isinstance(config, dict) else MINIMAL


def pattern_table(spark: SparkSession, config: dict) -> DataFrame:
    """Patterns from a configuration {"device_types": {type: {platforms, system_descriptions, priority}}}."""
    rows = []
    for i, (name, own) in enumerate(config.get("device_types", {}).items()):
        for key, kind in (("platforms", "platform"), ("system_descriptions", "description")):
            rows += [(name, i, kind, str(p), float(own.get("priority", 10))) for p in own.get(key, [])]
    return spark.createDataFrame(rows, PATTERNS)


def best_type(platform: Column, description: Column, patterns: list, default: str = DEFAULT_TYPE) -> Column:
    """The type with the best score, the first of equals; the default if no pattern is found. The patterns, a configuration of a few hundred rows, become one expression that needs no join."""
    by: dict[tuple[int, str], dict[str, list]] = {}
    for r in patterns:
        by.setdefault((r["type_ord"], r["device_type"]), {}).setdefault(r["kind"], []).append(r)
    held = lambda text, rows: net.any_text(text, [r["pattern"].lower() for r in rows])
    low = {"platform": F.lower(F.coalesce(platform, F.lit(""))), "description": F.lower(F.coalesce(description, F.lit("")))}
    scores = []
    for (place, name), kinds in sorted(by.items()):
        score = F.lit(0.0)
        for kind, rows in kinds.items():
            share = 1.0 if kind == "platform" else DESCRIPTION_SHARE
            score = score + F.when(held(low[kind], rows), rows[0]["priority"] * share).otherwise(0.0)
        scores.append(F.struct(score.alias("score"), F.lit(-place).alias("place"), F.lit(name).alias("name")))
    if not scores:
        return F.lit(default)
    # A score of nothing is the default's, ahead of all types.
    return F.array_max(F.array(*scores, F.struct(F.lit(0.0).alias("score"), F.lit(1).alias("place"), F.lit(default).alias("name"))))["name"]


def detected(neighbors: DataFrame, patterns: DataFrame, default: str = DEFAULT_TYPE) -> DataFrame:
    """Neighbours with device_type, category and has_routing. Platforms decide, descriptions only without one; without any of both and without capabilities the type is null."""
    rows = patterns.collect()  # a configuration, not data
    # Texts are made once a row, then what follows from them: as rows of one, so that neither filters nor selects make them anew at each mention.
    once = lambda df, **columns: df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
    texts = once(neighbors.drop("device_type", "category", "has_routing"), _words=net.capability_words(F.col("remote_capabilities")), _platform=F.coalesce("remote_platform", F.lit("")), _description=F.coalesce("system_description", F.lit("")))
    words, platform, description = F.col("_words"), F.col("_platform"), F.col("_description")
    anything = (F.trim(words) != "") | (platform != "") | (description != "")
    kind = F.when(anything, net.category_of(words, platform, description)).otherwise("unknown")
    by_platform, by_description = best_type(platform, F.lit(""), rows, default), best_type(F.lit(""), description, rows, default)
    device_type = F.when(platform != "", by_platform).when(description != "", by_description).when(anything, default)
    found = once(texts, device_type=device_type, category=kind, has_routing=F.when(anything, net.has_routing(words)).otherwise(False))
    return found.drop("_words", "_platform", "_description")


def frontier(neighbors: DataFrame, patterns: DataFrame, filters: dict[str, bool], default: str = DEFAULT_TYPE) -> DataFrame:
    """Neighbours with a type that the filters let in, and whether each is crawled."""
    seen = detected(neighbors, patterns, default).where(F.col("device_type").isNotNull() & net.included(F.col("category"), filters))
    return seen.withColumn("crawl", (F.coalesce("remote_ip", F.lit("")) != "") & net.crawlable(F.col("remote_capabilities"), filters))
