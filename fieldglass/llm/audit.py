"""Interaction audit of filters: what every order of five filters keeps, removes and loses.

Each document fails a set of filters, a mask of five bits. A part's documents are not counted mask by mask: for each of
the 32 sets of filters the signed parity sum over documents, +1 where the document fails an even number of the set and
-1 where odd, is aggregated by part and label. These sums are the Walsh-Hadamard transform of the mask counts, so the
inverse transform (the same matrix, divided by 32) gives the counts exactly, in whole numbers. Everything else is read
off the counts: a filter after a set of others removes the masks that hold it and none of the set; over all orders a
document with k failures is removed by each of them in 120 / k orders, which gives the Shapley values in closed form.

Sums are taken before the shuffle, so a part may hold any share of the rows. Copies are found by a digest of the text:
the smallest id of each digest is an aggregation too, joined back to rows of a few bytes.

A null text counts as empty. A null or missing part is the empty string. Rows without an id are copies of nothing and
no other row is a copy because of them; rows equal in id and text are no copies of each other, and each counts. A
document has a label if any row of `labels` with its id has it; null labels and ids count as none. Columns other than
those named are ignored, whatever their names. An empty table gives an empty result. Texts are looked at whole.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# The filters, and their bounds in words and percent.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"

MASKS = 1 << len(FILTERS)


def failures(text: Column) -> Column:
    """The mask of A to D: few words, repeated words, capitals, symbols."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, WORD_GAP), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    tests = [n < LEAST_WORDS, 100 * distinct.cast("long") < LEAST_DISTINCT * n, 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text), text.rlike(SYMBOLS)]
    return sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))


def labelled_masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, good, toxic, mask), a row for each document."""
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), failures(F.col("text")).alias("fails"))
    rows = written(rows)  # a few bytes a document, so that texts are read once
    has = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(has("quality").alias("good"), has("toxic").alias("toxic"))
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"))
    rows = rows.join(marks, "doc_id", "left").join(firsts, "digest")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return rows.select("part", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), (F.col("fails") + copy).alias("mask"))


def parity(mask: Column, chosen: Column | int) -> Column:
    """+1 where the mask holds an even number of the chosen bits, else -1."""
    chosen = F.lit(chosen) if isinstance(chosen, int) else chosen
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(chosen)) % 2)


def parity_sums(masks: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): the 32 signed parity sums of each part and label."""
    sums = [F.sum(parity(F.col("mask"), s).cast("long")) for s in range(MASKS)]
    return masks.groupBy("part", "good", "toxic").agg(F.array(*sums).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """(part, n, n_good, n_toxic): by part, how many documents have each mask, and how many of them each label."""
    every = F.sequence(F.lit(0), F.lit(MASKS - 1))
    inverse = F.transform(every, lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda a, s: a + F.col("sums")[s] * parity(m, s)))
    counts = sums.select("part", "good", "toxic", F.transform(inverse, lambda x: F.shiftright(x, len(FILTERS))).alias("n"))
    added = lambda f: F.array(*[F.sum(F.col("n")[m] * f) for m in range(MASKS)])
    return counts.groupBy("part").agg(added(F.lit(1)).alias("n"), added(F.col("good")).alias("n_good"), added(F.col("toxic")).alias("n_toxic"))


def steps() -> list[tuple[int, int, list[tuple[str, int]]]]:
    """For each filter and set of filters before it: its bit, the set's mask, and the orders and steps where that is so."""
    at: dict[tuple[int, int], list[tuple[str, int]]] = {}
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            at.setdefault((bit, before), []).append(("".join(order), step))
            before |= bit
    return [(bit, before, where) for (bit, before), where in at.items()]


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step of the order."""
    counts = cells(parity_sums(labelled_masks(docs, labels, part)))
    every, all_orders = F.sequence(F.lit(0), F.lit(MASKS - 1)), 120

    def total(n: Column, held, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(F.filter(every, held), F.lit(0).cast("long"), lambda a, m: a + n[m] * weight(m))

    literal = lambda where: F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step")) for o, s in where])
    table = F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(before).alias("before"), literal(where).alias("places")) for bit, before, where in steps()])
    rows = counts.withColumn("_s", F.explode(table)).select("*", "_s.*").drop("_s")
    bit, before, n = F.col("bit"), F.col("before"), F.col("n")
    has = lambda m, b: m.bitwiseAND(b) != 0
    removed = lambda m: has(m, bit) & ~has(m, before)
    out = rows.select(
        "part", "places",
        total(n, lambda m: ~has(m, bit.bitwiseOR(before))).alias("kept"),
        total(n, removed).alias("removed"),
        total(n, lambda m: has(m, bit) & has(m, before)).alias("redundant"),
        n[bit].alias("unique_fails"),
        total(F.col("n_good"), removed).alias("good_lost"),
        total(F.col("n_toxic"), removed).alias("toxic_lost"),
        total(n, lambda m: has(m, bit), lambda m: (all_orders / F.bit_count(m)).cast("long")).alias("shapley"),
    )
    return out.withColumn("_p", F.explode("places")).select("part", "_p.filter_order", "_p.step", *out.columns[2:])
