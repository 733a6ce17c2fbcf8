"""Conversation repair: the cheapest edits that give every conversation the structure (s?(ua)+)? of role initials.

Rows equal in all columns become one with a count. Rows are dealt by a hash of the conversation, then by turn, role and
text, to ranges: most conversations lie within one range, a long one in several, so none is ever in one task. Within a
task, batches of runs of rows go through a recursive DuckDB query. Each recursion advances one row of every run in the
batch and keeps, for every state of the grammar (nothing yet, after s, after u, after a), the minimum cost and, of
equal costs, the least audit. A conversation of which a task has only a part is solved from every state that it may
start in, and the parts are joined by adding costs and appending audits. That is exact: of two edits of the same rows
with equal costs, neither audit is the beginning of the other (what is longer by inserts costs more), so their order
stays as it is whatever follows.

Edits: keep 0, rerole to user or assistant 2, delete 3, insert an empty user or assistant 2; a truncated row that is not
deleted adds 1. Blank rows and rows whose role and text were seen earlier must go. Audits are compared as ASCII text.
An audit fixes the roles that it gives, so the repaired rows follow from it in one pass in order of turn. That pass is
dealt by conversation and streams: it holds a batch and one conversation's audit.

Nulls count as one space: a null role or text is that of a space, a null id is a conversation of its own; null turns come
first and give no gaps. Ties of turn are in order of role, then text. Repeated rows are duplicates. A conversation
without rows after damage has zeros and an empty audit; an empty table gives an empty result. Texts of any length are
used whole. Columns other than conv_id, turn, role and text are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import duckdb
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written

#: Rows of a run (a longer one is cut and its parts joined) and rows of a batch of the recursive query.
RUN, BATCH = 256, 16_384
#: Rows that a range holds on average.
ROWS = 50_000
GAP = r"[\x20\x09-\x0D]"

#: States: nothing yet, after s, after u, after a.
NEW, SYSTEM, USER, ASSISTANT = STATES = range(4)
ENDS = (NEW, ASSISTANT)
AFTER = {"s": {NEW: SYSTEM}, "u": {NEW: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: By state: after how many inserts which state is reached (more than two reach no other).
INSERTS = [(s, t, n) for s in STATES for t, n in {NEW: [(NEW, 0), (USER, 1), (ASSISTANT, 2)], SYSTEM: [(SYSTEM, 0), (USER, 1), (ASSISTANT, 2)], USER: [(USER, 0), (ASSISTANT, 1)], ASSISTANT: [(ASSISTANT, 0), (USER, 1)]}[s]]
#: By state and initial ("-": a row that must go, which its deletions count for): edit, next state, cost, whether the row is held.
EDITS = [
    *((s, i, "K", t, 0, 1) for i, arcs in AFTER.items() for s, t in arcs.items()),
    *((s, i, "R", t, 2, 1) for i in "sua?" for role in "ua" for s, t in AFTER[role].items()),
    *((s, i, "D", s, 3, 0) for i in "sua?" for s in STATES),
    *((s, "-", "", s, 0, 0) for s in STATES),
]

Best = dict[tuple[int, int], tuple[int, str]]  # (start, end) -> cost and audit


def _sql_rows(rows: list[tuple]) -> str:
    return ", ".join(f"({', '.join(repr(x) for x in r)})" for r in rows)


#: runs(run, start), turns(run, place, initial, gone, cut): the best way of each run from each of its starts to each state.
CHEAPEST = f"""
WITH RECURSIVE inserts(s, t, n) AS (VALUES {_sql_rows(INSERTS)}),
edits(s, initial, op, t, cost, held) AS (VALUES {_sql_rows(EDITS)}),
best(run, start, s, place, x) USING KEY (run, start, s) AS (
  SELECT run, start, i.t, 0, {{'cost': CAST(2 * i.n AS BIGINT), 'audit': repeat('I', i.n)}} FROM runs JOIN inserts i ON i.s = runs.start
  UNION
  SELECT b.run, b.start, i.t, b.place + 1,
    min({{'cost': b.x.cost + e.cost + e.held * r.cut + 3 * r.gone + 2 * i.n, 'audit': concat(b.x.audit, e.op, repeat('D', r.gone), repeat('I', i.n))}})
  FROM best b JOIN turns r ON r.run = b.run AND r.place = b.place JOIN edits e ON e.s = b.s AND e.initial = r.initial JOIN inserts i ON i.s = e.t
  GROUP BY b.run, b.start, i.t, b.place
)
SELECT b.run, b.start, b.s, b.x.cost, b.x.audit FROM best b JOIN (SELECT run, count(*) AS n FROM turns GROUP BY run) l ON l.run = b.run AND l.n = b.place
"""


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def damaged(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage, equal ones as one with their number."""
    kind = F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) with blank, duplicate and truncated: how many of the equal rows have each as their first fault."""
    same = ["conv_id", "role", "digest"]
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    firsts = rows.groupBy(*same).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first")).toDF("_conv", "_role", "_digest", "first")
    rows = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")))
    first = F.col("turn").eqNullSafe(F.col("first.turn"))
    last = F.regexp_replace("text", f"{GAP}+$", "")
    rows = rows.withColumn("blank", F.when(last == "", F.col("n")).otherwise(0).cast("long"))
    rows = rows.withColumn("duplicate", F.when(F.col("blank") > 0, 0).otherwise(F.col("n") - F.when(first, 1).otherwise(0)).cast("long"))
    cut = (F.col("n") > F.col("blank") + F.col("duplicate")) & ~last.rlike("[.!?]$")
    return rows.withColumn("truncated", cut.cast("long")).select("conv_id", "turn", "role", "text", "n", "blank", "duplicate", "truncated")


class Part(NamedTuple):
    """A stretch of a conversation's rows in order: counts, what joins it to its neighbours, and the best ways through it."""

    turns: int  # distinct ones that are not null
    low: int | None
    high: int | None
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: str  # role initials at its ends
    last: str
    best: Best


LEGAL = {"su", "ua", "au"}
PART = "turns bigint, low bigint, high bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, ways array<struct<start:int,state:int,cost:bigint,audit:string>>"


def joined(a: Part, b: Part) -> Part:
    """The stretch of a, then b. Both may begin or end with inserts, so no way is lost between them."""
    best: Best = {}
    for (s, m), (cost, audit) in a.best.items():
        for t in STATES:
            if way := b.best.get((m, t)):
                new = (cost + way[0], audit + way[1])
                if (s, t) not in best or new < best[s, t]:
                    best[s, t] = new
    ends = [x for x in (a.low, b.low) if x is not None], [x for x in (a.high, b.high) if x is not None]
    again = a.high is not None and a.high == b.low
    return Part(
        a.turns + b.turns - again, min(ends[0], default=None), max(ends[1], default=None), a.blank + b.blank, a.duplicate + b.duplicate, a.truncated + b.truncated,
        a.illegal + b.illegal + (a.last + b.first not in LEGAL), a.first, b.last, best,
    )


def cheapest(runs: list[tuple[list[tuple[str, int, int]], tuple[int, ...]]]) -> list[Best]:
    """For each run of rows (initial or "-", deletions that must follow, truncated) and its starts, the best ways."""
    flat = [(i, p, *row) for i, (rows, _) in enumerate(runs) for p, row in enumerate(rows)]
    turns = pa.table([pa.array(c, t) for c, t in zip(zip(*flat), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["run", "place", "initial", "gone", "cut"])
    starts = pa.table([pa.array([i for i, (_, s) in enumerate(runs) for _ in s], pa.int32()), pa.array([x for _, s in runs for x in s], pa.int32())], names=["run", "start"])
    out: list[Best] = [{} for _ in runs]
    con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB", "temp_directory": ""})
    try:
        con.register("turns_", turns)
        con.register("runs_", starts)
        con.execute("CREATE TABLE turns AS FROM turns_")
        con.execute("CREATE TABLE runs AS FROM runs_")
        for run, start, state, cost, audit in con.execute(CHEAPEST).fetchall():
            out[run][start, state] = (cost, audit)
    finally:
        con.close()
    return out


class Rows:
    """The rows of one stretch, as they come."""

    def __init__(self, conv: int | None, begins: bool):
        self.conv, self.begins, self.starts, self.rows = conv, begins, (NEW,) if begins else tuple(STATES), []
        self.turns, self.low, self.high, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last = 0, None, None, 0, 0, 0, 0, None, ""

    def add(self, turn: int | None, initial: str, n: int, blank: int, duplicate: int, truncated: int) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.illegal += n - 1 + (self.first is not None and self.last + initial not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        held = n > blank + duplicate
        self.rows.append((initial if held and initial in AFTER else "?" if held else "-", blank + duplicate, truncated))

    def part(self, best: Best) -> Part:
        return Part(self.turns, self.low, self.high, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, best)


def _row(place: int, conv: int | None, whole: bool, part: Part) -> dict:
    ways = [{"start": s, "state": t, "cost": c, "audit": a} for (s, t), (c, a) in part.best.items()]
    return {"conv_id": conv, "place": place, "whole": whole, **part._asdict(), "ways": ways}


def _part(row: dict) -> Part:
    return Part(*[row[f] for f in Part._fields[:-1]], {(w["start"], w["state"]): (w["cost"], w["audit"]) for w in row["ways"]})


def parts(rows: DataFrame, ranges: int) -> DataFrame:
    """The stretch of each conversation in each range of its rows; `whole` says that it is known to be all of it."""
    order = [F.xxhash64("conv_id"), F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    sorted_ = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    fields = sorted_.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "n", "blank", "duplicate", "truncated")
    schema = T.StructType([rows.schema["conv_id"], *T.StructType.fromDDL(f"place int, whole boolean, {PART}")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, stretches = TaskContext.get().partitionId(), Stretches()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                stretches.add(*row)
            yield pa.RecordBatch.from_pylist([_row(place, *x) for x in stretches.ended()], schema=arrow)
        yield pa.RecordBatch.from_pylist([_row(place, *x) for x in stretches.closed()], schema=arrow)

    return fields.mapInArrow(run, schema)


class Stretches:
    """Cuts a task's rows into runs, solves them in batches and joins the runs of each conversation."""

    def __init__(self):
        self.waiting: list[Rows] = []
        self.size = 0  # rows in waiting runs
        self.found: list[tuple] = []  # conversations that have ended
        self.open: tuple[int | None, bool, Part] | None = None  # the conversation of the last run solved, and whether its start is known

    def add(self, conv: int | None, *row) -> None:
        last = self.waiting[-1] if self.waiting else None
        before = last.conv if last else self.open and self.open[0]
        new = conv != before or not (last or self.open)
        if new or last is None or len(last.rows) >= RUN:
            if self.size >= BATCH:
                self.solve()
            self.waiting.append(Rows(conv, new and bool(last or self.open)))
        self.waiting[-1].add(*row)
        self.size += 1

    def solve(self) -> None:
        for rows, best in zip(self.waiting, cheapest([(x.rows, x.starts) for x in self.waiting])):
            part = rows.part(best)
            if self.open and not rows.begins and self.open[0] == rows.conv:
                self.open = (*self.open[:2], joined(self.open[2], part))
                continue
            if self.open:
                self.found.append(self.open)
            self.open = (rows.conv, rows.begins, part)
        self.waiting, self.size = [], 0

    def ended(self) -> list[tuple]:
        out, self.found = self.found, []
        return out

    def closed(self) -> list[tuple]:
        """The rest; what follows the last conversation is not known."""
        if self.waiting:
            self.solve()
        return self.ended() + ([(self.open[0], False, self.open[2])] if self.open else [])


def audited(df: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation in df, whose damaged rows with faults are `rows`."""
    found = written(parts(rows, max(1, -(-rows.count() // ROWS))))

    def fold(table: pa.Table) -> pa.Table:
        stretches = [_part(r) for r in table.sort_by("place").to_pylist()]
        return pa.Table.from_pylist([_row(0, table.column("conv_id")[0].as_py(), True, functools.reduce(joined, stretches))], schema=table.schema)

    whole = found.where("whole").unionByName(found.where("NOT whole").groupBy("conv_id").applyInArrow(fold, found.schema))
    good = F.filter("ways", lambda w: (w["start"] == NEW) & w["state"].isin(*ENDS))
    best = F.array_min(F.transform(good, lambda w: F.struct(w["cost"], w["audit"])))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    known = whole.select(F.col("conv_id").alias("_conv"), F.lit(True).alias("_has"), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", best.alias("_best"))
    out = df.select("conv_id").distinct().join(known, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")]
    return out.select("conv_id", *longs, F.coalesce("_best.cost", F.lit(0)).cast("long").alias("cost"), F.coalesce("_best.audit", F.lit("")).alias("audit"))


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, edit, turn, role, text): the rows of every repaired conversation, one conversation after the other and in order within a partition."""
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("gone"))
    body = rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", F.col("n").cast("long").alias("n"), (F.col("blank") + F.col("duplicate")).alias("gone"))
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text"]
    schema = T.StructType([audits.schema["conv_id"], *T.StructType.fromDDL("edit string, turn bigint, role string, text string")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state = None, "", 0, NEW

        def insert() -> Iterator[tuple]:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                at += 1
                state = ASSISTANT if state == USER else USER
                yield conv, "I", None, "assistant" if state == ASSISTANT else "user", ""

        def of(id_, kind, turn, role, text, n, gone) -> Iterator[tuple]:
            nonlocal conv, audit, at, state
            if kind == 0:
                yield from insert()
                conv, audit, at, state = id_, text, 0, NEW
                return
            yield from insert()
            if n > gone:
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = AFTER[role[0]][state]
                    yield conv, "K", turn, role, text
                elif edit == "R":
                    state = ASSISTANT if state == USER else USER
                    yield conv, "R", turn, "assistant" if state == ASSISTANT else "user", text
            at += gone

        for batch in batches:
            out = [x for row in zip(*(c.to_pylist() for c in batch.columns)) for x in of(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(arrow), arrow)], schema=arrow)
        out = list(insert())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return heads.unionByName(body).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) from repaired rows in order: the digest of role:text, one a line."""
    schema = T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL("repaired_sha256 string")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha = None, None
        for batch in batches:
            out = []
            for id_, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                line = f"{role}:{text}".encode("utf-8", "surrogatepass")
                if sha is None or id_ != conv:
                    if sha is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha = id_, hashlib.sha256(line)
                else:
                    sha.update(b"\n" + line)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(arrow)], schema=arrow)
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((conv, sha.hexdigest()), arrow)], schema=arrow)

    return turns.select("conv_id", "role", "text").mapInArrow(run, schema)


def digest(df: DataFrame) -> DataFrame:
    """What was wrong with every damaged conversation, its cheapest repair and the digest of the repaired rows."""
    rows = written(faults(damaged(df)))
    audits = written(audited(df, rows))
    sums = hashes(repaired(rows, audits)).withColumnRenamed("conv_id", "_conv")
    out = audits.join(sums, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return out.select(*audits.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
