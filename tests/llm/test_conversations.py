import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest

from fieldglass.llm import conversations as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Dijkstra over (rows read, roles so far as a state), by cost and audit; rows are (role, text, must go, truncated)."""
    after = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, lines = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            return cost, audit, lines
        if (at, state) in done:
            continue
        done.add((at, state))
        for name in ("user", "assistant"):
            if state in after[name[0]]:
                heapq.heappush(heap, (cost + 2, audit + "I", at, name[0], (*lines, name + ":")))
        if at < len(rows):
            role, text, gone, cut = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, lines))
            if not gone:
                if state in after.get(role[:1], {}):
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, role[0], (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if state in after[name[0]]:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", at + 1, name[0], (*lines, f"{name}:{text}")))


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {k: sorted(v) for k, v in out.items()}


def brute(rows):
    out = {}
    for conv, own in damage(rows).items():
        seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            bare = text.rstrip(WS)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = {t for has, t, *_ in own if has}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = cheapest(marked)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(df):
    got = C.digest(df).collect()
    want = brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want


def random_rows(seed, convs=120, longest=9):
    rng = np.random.default_rng(seed)
    pick = lambda x: x[rng.integers(len(x))]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u", "User"]
    texts = ["Yes.", "No", " ", "", None, "What?\n", "a. b", "Same text.", "x!", "tail. \t", "Ünï…", ".", "z" * 50]
    turn = lambda p: None if rng.random() < 0.1 else int(p + rng.integers(-1, 2) * (rng.random() < 0.3))
    rows = [(c if c else None, turn(p), pick(roles), pick(texts)) for c in range(convs) for p in range(rng.integers(0, longest))]
    return rows + rows[:5]


def test_whole_table(spark, sf_dir):
    check(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@pytest.mark.parametrize("seed", [1, 2])
def test_random_rows(spark, seed):
    check(spark.createDataFrame(random_rows(seed), SCHEMA))


def test_conversations_over_many_ranges_and_runs(spark, monkeypatch):
    monkeypatch.setattr(C, "ROWS", 11)
    monkeypatch.setattr(C, "RUN", 4)
    monkeypatch.setattr(C, "BATCH", 9)
    check(spark.createDataFrame(random_rows(3, 40) + random_rows(4, 3, 120), SCHEMA))


def test_one_conversation_has_most_rows(spark, monkeypatch):
    monkeypatch.setattr(C, "ROWS", 200)
    rows = [(7, i, ["user", "assistant"][i % 2], f"Turn {i}.") for i in range(3000)] + [(c, i, "user", "Hi.") for c in range(20) for i in range(3)]
    check(spark.createDataFrame(rows, SCHEMA))


def test_many_equal_rows_are_one_with_a_count(spark):
    df = spark.createDataFrame([(1, 2, "user", "Again.")] * 500 + [(1, 1, "system", " ")] * 300 + [(1, None, None, None)] * 5, SCHEMA)
    assert C.damaged(df).count() <= 3
    check(df)


def test_order_of_partitions_does_not_matter(spark):
    df = spark.createDataFrame(random_rows(5), SCHEMA)
    assert sorted(map(str, C.digest(df).collect())) == sorted(map(str, C.digest(df.repartition(13)).collect()))


def test_odd_tables(spark):
    assert C.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    extra = "conv_id bigint, turn bigint, role string, text string, n int, kind string, digest string, first string, audit string, blank int, place int"
    rows = [(1, 0, "user", "Hi.", 1, "a", "b", "c", "d", 2, 3), (1, 1, "assistant", "word. " * 200_000, 1, "a", "b", "c", "d", 2, 3), (2, None, None, None, None, None, None, None, None, None, None)]
    check(spark.createDataFrame(rows, extra))
    dropped = [i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    check(spark.createDataFrame([(i, 0, "user", "Gone.") for i in dropped], SCHEMA))


def test_repaired_rows_are_conversations(spark):
    rows = C.written(C.faults(C.damaged(spark.createDataFrame(random_rows(6), SCHEMA))))
    source = spark.createDataFrame(random_rows(6), SCHEMA)
    audits = C.written(C.audited(source, rows))
    by = {}
    for r in C.repaired(rows, audits).collect():
        by.setdefault(r["conv_id"], []).append(r)
    for r in audits.collect():
        own = by.get(r["conv_id"], [])
        assert "".join(x["edit"] for x in own) == r["audit"].replace("D", "")
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][0] for x in own))
