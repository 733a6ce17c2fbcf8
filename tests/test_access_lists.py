import re

from fieldglass.parsers.edge import access_lists

TEXT = "Extended IP access list E\r\n    10 permit tcp host 10.0.0.1 any eq 80 (5 matches)\n\t20 deny ip any any\n 30 permit $1 object-group  X\n remark none\nStandard IP access list S\n 10 permit 10.0.0.0, wildcard bits 0.0.0.255 (1 match)\n"


def test_each_line_is_matched_once(spark):
    df = access_lists(spark.createDataFrame([("d", TEXT), ("n", None)], "hostname string, text string"))
    got = {r["name"]: [tuple(e) for e in r["entries"]] for r in df.collect()}
    assert got["E"] == [("permit", "tcp", "host 10.0.0.1", "any eq 80", 5), ("deny", "ip", "any", "any", 0), ("permit", "$1", "object-group X", "", 0)]
    assert got["S"] == [("permit", "ip", "10.0.0.0, wildcard bits 0.0.0.255", "", 1)]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("(permit|deny)\\s+(\\S+)\\s+") == 1


def test_no_scope_of_networks_comes_to_one_task(spark):
    from fieldglass.operators.overlap import nested_networks

    df = spark.createDataFrame([("s", 0, 8), ("s", 0, 24), ("t", 0, 24)], "scope string, lo bigint, prefix int")
    found = nested_networks(df, ["scope"])
    assert [tuple(r) for r in found.select("scope", "lo", "prefix", "outer_lo", "outer_prefix").collect()] == [("s", 0, 24, 0, 8)]
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", found._jdf.queryExecution().executedPlan().toString())
    assert dealt and all("lo#" in d for d in dealt)
