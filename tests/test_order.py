import random

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import order
from fieldglass.operators.order import carried, numbered
from fieldglass.parsers.base import by_block, by_line

LINES = "scope string, n bigint, line string"


def lines(seed, n):
    rng = random.Random(seed)
    own = {"a": n, "b": 7, None: 5}
    return [(s, i, f"# {s}{i}" if rng.random() < 0.1 else rng.choice(["x", "", None])) for s, k in own.items() for i in range(k)]


def want(rows):
    out, now = {}, {}
    for s, n, line in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if line and line.startswith("#"):
            now[s] = (line, now.get(s, (None, 0))[1] + 1)
        out[s, n] = now.get(s, (None, 0))
    return out


@pytest.mark.parametrize("size", [3, 50, 100_000])
def test_headers_for_any_ranges(spark, size):
    rows = lines(size, 600)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), LINES).repartition(7)
    got = carried(df, ["scope"], ["n"], F.when(F.col("line").startswith("#"), F.col("line")), rows=size).collect()
    assert {(r["scope"], r["n"]): (r["header"], r["block"]) for r in got} == want(rows) and len(got) == len(rows)
    got = numbered(df, ["scope"], ["n"], rows=size).collect()
    assert len(got) == len(rows) and all(r["at"] == r["n"] for r in got)


def test_blocks_across_rows_are_those_of_one_text(spark):
    rng = random.Random(3)
    text = "\n".join(rng.choice(["Interface Gi0/1", "Interface Te1/2", " mtu 1500", " up", ""]) for _ in range(400))
    df = spark.createDataFrame([("d", text)], "scope string, text string")
    whole = [r["block"].split("\n") for r in by_block(df, "Interface").orderBy("item_ord").collect()]
    parts = carried(by_line(df), ["scope"], ["item_ord"], F.when(F.col("line").startswith("Interface"), F.col("line")), rows=11)
    blocks = parts.where("block > 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("item_ord", "line"))).alias("l")).orderBy("block").collect()
    assert [[x["line"] for x in r["l"]] for r in blocks] == [[x for x in b] if b[-1] or i + 1 == len(whole) else b[:-1] for i, b in enumerate(whole)]


def test_empty(spark):
    df = spark.createDataFrame([], LINES)
    assert carried(df, ["scope"], ["n"], F.col("line")).collect() == [] and numbered(df, ["scope"], ["n"]).collect() == []


def test_details_are_numbered_in_ranges(spark, sf_dir, capsys):
    from fieldglass.queries import QUERIES

    QUERIES["O1_order_of_details"](spark, sf_dir).explain("simple")
    windows = [line for line in capsys.readouterr().out.splitlines() if "Window [" in line and "row_number" in line]
    assert windows and all("__part" in line for line in windows)


def test_ranges_grow_slower_than_rows():
    assert [order.ranges(n, 5_000) for n in (0, 1, 5_000, 5_001, 500_000)] == [1, 1, 1, 2, 100]
    assert order.ranges(36_000_000, 5_000) < 1_000 and order.ranges(6 * 36_000_000, 5_000) < 2.5 * order.ranges(36_000_000, 5_000)
