"""Near-duplicate documents: b-bit MinHash, band candidates, exact confirmation, connected components.

A document's set holds the hashes (64 bits) of its distinct word shingles. Documents with one and the same set are one
node. A node's minima under many hash functions give band keys (BANDS keys of ROWS minima each: at a similarity of 0.8
a pair shares none with probability below 2e-7) and a signature of BITS mixed bits of every minimum. Nodes that share
a band key are candidates; equal bits, corrected for chance, estimate their similarity, and only pairs whose
estimate is more than five standard deviations too low are left out. What stays is confirmed on full sets.

No bucket is expanded into all its pairs. First each member is compared with the bucket's most central members, those
whose other buckets are the fullest, in ROUNDS rounds; near copies of one text are thereby linked. Buckets whose members
are then still in different components are read in tiles of CHUNK rows a side: members outside the bucket's largest
component against all. Tiles compare signatures first and full sets of what passes then, and give only links that join
components, so what is emitted is linear in the members and no link between components is lost. Components come from
alternating stars; every step is a partial aggregation and a join, and goes to a table in the shared folder.

Texts of any length are taken whole: a set takes 8 bytes a shingle, and a task holds those of a batch or of a tile. Ties,
that is pairs at the threshold exactly, are links.

A row without an id has one from its group, if any row of it has one, and is kept if none has.
A text without words, or null, has an empty set, is linked with nothing and is kept. With fewer words than a shingle
takes, the whole sequence is the one shingle. Every row gets a row; rows of one id are treated by their texts.
An empty table gives an empty result. Columns named like an output are dropped first.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHES, Recent, lean, mix64, text_batches, written

BANDS, ROWS, BITS = 40, 5, 2
#: Rounds with one representative a bucket before what is left is read in tiles, and rows and hashes of a side of a tile on average.
ROUNDS, CHUNK, CHUNK_HASHES = 2, 2_000, 1_000_000
#: Pairs of a tile whose signatures and bands are compared at a time: some 12 MB.
PAIRS = 1 << 14
TILE = ["key", "lc", "rc"]
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 5.0
HASHES = BANDS * ROWS
LONGS = -(-HASHES * BITS // 64)

_RNG = np.random.default_rng(20240229)
MULTIPLY = (_RNG.integers(0, 1 << 32, HASHES, np.uint64) | np.uint64(1)).astype(np.uint32)
ADD = _RNG.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


_words = Recent(xxhash.xxh3_64_intdigest)
CACHES.append(_words.empty)


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are runs of anything but ASCII white space; A-Z count as a-z."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    total = int(counts.sum())
    h = np.fromiter(map(_words.__getitem__, chain.from_iterable(words)), np.uint64, total)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        acc = h[: max(0, total - size + 1)]
        for j in range(1, size):
            acc = mix64(acc * GOLDEN + h[j : j + len(acc)])
        out = []
        for n, end in zip(counts.tolist(), ends.tolist()):
            begin = end - n
            if n >= size:
                out.append(np.unique(acc[begin : end - size + 1]))
            elif n:
                one = np.uint64(n)
                for x in h[begin:end]:
                    one = mix64(np.array([one * GOLDEN + x], np.uint64))[0]
                out.append(np.array([one], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def node_key(s: np.ndarray) -> int:
    """64 bits that name a set, signed."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of the minima of non-empty sets."""
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    starts = np.cumsum(lengths) - lengths
    x = np.concatenate(sets)
    x = (x ^ (x >> np.uint64(32))).astype(np.uint32)
    least = np.empty((HASHES, len(sets)), np.uint32)
    with np.errstate(over="ignore"):
        for i in range(HASHES):
            least[i] = np.minimum.reduceat(x * MULTIPLY[i] + ADD[i], starts)
        keys = np.empty((len(sets), BANDS), np.uint64)
        for b in range(BANDS):
            key = np.full(len(sets), b + 1, np.uint64)
            for r in range(ROWS):
                key = mix64(key * GOLDEN + least[b * ROWS + r])
            keys[:, b] = key
    per = 64 // BITS
    low = np.zeros((len(sets), LONGS * per), np.uint64)
    # Low bits of x * odd + add agree or not for all functions alike; those of a mixed minimum are drawn anew by each.
    low[:, :HASHES] = (mix64(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).T
    packed = (low.reshape(len(sets), LONGS, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel()))


def sketched(df: DataFrame, size: int) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, node, bands, bits; the last three are null for an empty set. A column row, if there is one, comes along."""
    own = ["doc_id", *(c for c in df.columns if c == "row")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*own, "n_shingles", "node", "bands", "bits"]
        for batch, texts in text_batches(batches):
            sets = shingle_sets(texts, size)
            full = np.array([len(s) > 0 for s in sets])
            if full.any():
                some = [s for s in sets if len(s)]
                keys, bits = sketches(some)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(full)) for c in own), pa.array(list(map(len, some)), pa.int64()), pa.array(list(map(node_key, some)), pa.int64()), _lists(keys), _lists(bits)], names=names)
            if not full.all():
                n = int((~full).sum())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(pa.array(~full)) for c in own), pa.array([0] * n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names=names)

    return df.select(*own, "text").mapInArrow(lean(run), f"doc_id bigint, {'row string, ' if 'row' in own else ''}n_shingles bigint, node bigint, bands array<bigint>, bits array<bigint>")


def node_sets(docs: DataFrame, size: int) -> DataFrame:
    """(text) -> node and its set, packed: whole hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_batches(batches):
            sets = [s for s in shingle_sets(texts, size) if len(s)]
            packed = [s.astype("<u8").tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(list(map(node_key, sets)), pa.int64()), pa.array(packed, pa.binary())], names=["node", "members"])

    return docs.select("text").mapInArrow(lean(run), "node bigint, members binary")


def _unpacked(packed: bytes) -> np.ndarray:
    """A packed set, sorted."""
    return np.frombuffer(packed, "<u8")


def shared_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, set_a, set_b) -> a, b, n_a, n_b and the size of the intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                u, v = _unpacked(x.as_py()), _unpacked(y.as_py())
                sizes.append((len(u), len(v), len(np.intersect1d(u, v, assume_unique=True))))
            columns = zip(*sizes) if sizes else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *[pa.array(list(c), pa.int64()) for c in columns]], names=["a", "b", "n_a", "n_b", "n_both"])

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(lean(run), "a bigint, b bigint, n_a bigint, n_b bigint, n_both bigint")


def estimate(x: Column, y: Column) -> Column:
    """Similarity from the low bits that agree, corrected for those that agree by chance."""
    unequal = F.aggregate(
        F.zip_with(x, y, lambda a, b: F.bit_count((a.bitwiseXOR(b).bitwiseOR(F.shiftrightunsigned(a.bitwiseXOR(b), 1))).bitwiseAND(F.lit(0x5555555555555555)))), F.lit(0), lambda s, v: s + v
    )
    chance = 1.0 / (1 << BITS)
    return ((HASHES - unequal) / float(HASHES) - chance) / (1 - chance)


def least_estimate(threshold: float) -> float:
    chance = 1.0 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return threshold - SLACK * (p * (1 - p) / HASHES) ** 0.5 / (1 - chance)


def sets_of(wanted: DataFrame, sketch: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(node, members) of distinct wanted nodes, as a table: one document of each is read again."""
    # One row a node before any join, so that many copies of a text are no hot key.
    ids = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node", "left_semi").select("doc_id").distinct()
    own = docs.select("doc_id", "text").join(ids.toDF("_id"), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return written(node_sets(own, size).join(wanted, "node", "left_semi").dropDuplicates(["node"]))


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b) those whose sets share enough, as a table."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    likely = pairs.join(side("a"), "a").join(side("b"), "b")
    likely = likely.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (estimate(F.col("bits_a"), F.col("bits_b")) >= least_estimate(percent / 100)))
    likely = written(likely.select("a", "b"))
    of = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"set_{c}"))
    counted = shared_counts(likely.join(of("a"), "a").join(of("b"), "b"))
    return written(counted.where(100 * F.col("n_both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("n_both"))).select("a", "b"))


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Rows sorted by tile, as tables of whole tiles with the places where tiles begin, and the end."""
    held = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        ids = np.stack([t.column(c).to_numpy() for c in TILE])
        new = (np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist()
        held = t.slice(new[-1]) if new else t
        if new:
            yield t.slice(0, new[-1]), [0, *new]
    if held is not None and held.num_rows:
        yield held, [0, held.num_rows]


def _matrix(t: pa.Table, column: str) -> np.ndarray:
    c = t.column(column).combine_chunks()
    c = pa.concat_arrays(c.chunks) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy().reshape(t.num_rows, -1)


def _passing(t: pa.Table, bounds: list[int], percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each tile (its first row), row pairs of left and right side in different components whose sizes and estimates allow a link, and whose first shared bucket is the tile's."""
    side, label, n, key = (t.column(c).to_numpy() for c in ("side", "label", "n", "key"))
    bits, bands = _matrix(t, "bits").view(np.uint64), _matrix(t, "bands")
    most = HASHES * (1 - (least_estimate(percent / 100) * (1 - 1 / (1 << BITS)) + 1 / (1 << BITS)))  # unequal minima at most
    odd = np.uint64(0x5555555555555555)
    for begin, end in zip(bounds, bounds[1:]):
        left, right = begin + np.flatnonzero(side[begin:end] == 0), begin + np.flatnonzero(side[begin:end] == 1)
        for k in range(0, len(left) if len(right) else 0, 128):
            a = left[k : k + 128]
            ok = (label[a][:, None] != label[right][None, :]) & (100 * np.minimum(n[a][:, None], n[right][None, :]) >= percent * np.maximum(n[a][:, None], n[right][None, :]))
            i, j = np.nonzero(ok)
            for s in range(0, len(i), PAIRS):
                x, y = a[i[s : s + PAIRS]], right[j[s : s + PAIRS]]
                unequal = bits[x] ^ bits[y]
                keep = np.bitwise_count((unequal | (unequal >> np.uint64(1))) & odd).sum(axis=1) <= most
                x, y = x[keep], y[keep]
                mine = bands[x, (bands[x] == bands[y]).argmax(axis=1)] == key[begin]
                if mine.any():
                    yield begin, x[mine], y[mine]


def likely_rows(rows: DataFrame, percent: int) -> DataFrame:
    """(key, lc, rc, side, node) of the rows of tiles that are in a pair whose signatures allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _whole_tiles(batches):
            hit = np.zeros(t.num_rows, bool)
            for _, a, b in _passing(t, bounds, percent):
                hit[a] = hit[b] = True
            if hit.any():
                yield from t.select([*TILE, "side", "node"]).filter(pa.array(hit)).combine_chunks().to_batches()

    return rows.mapInArrow(lean(run), "key bigint, lc int, rc int, side int, node bigint")


def _runs(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Begins and ends of runs of equal values."""
    new = np.flatnonzero(np.diff(x)) + 1
    return ([0, *new.tolist()], [*new.tolist(), len(x)]) if len(x) else ([], [])


def tile_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, from rows of tiles with bands, signatures and sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, bounds in _whole_tiles(batches):
            node, label = (t.column(c).to_numpy() for c in ("node", "label"))
            members = t.column("members")
            out, joined, sets = [], {}, {}

            def lead(x: int) -> int:
                while (y := joined.get(x, x)) != x:
                    x = y
                return x

            def hashes(i: int) -> np.ndarray:
                if i not in sets:
                    sets[i] = _unpacked(members[i].as_py())
                return sets[i]

            at = -1
            for begin, a, b in _passing(t, bounds, percent):
                if begin != at:
                    at, joined, sets = begin, {}, {}
                for begins, ends in zip(*_runs(a)):
                    i = int(a[begins])
                    # All partners of a row at once: how many of each one's hashes the row has.
                    others = [j for j in b[begins:ends].tolist() if lead(int(label[j])) != lead(int(label[i]))]
                    if not others:
                        continue
                    own = hashes(i)
                    sizes = np.array([len(hashes(j)) for j in others])
                    flat = np.concatenate([hashes(j) for j in others])
                    found = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                    both = np.add.reduceat(found.astype(np.int64), np.cumsum(sizes) - sizes)
                    for j in np.flatnonzero(100 * both >= percent * (len(own) + sizes - both)).tolist():
                        x, y = lead(int(label[i])), lead(int(label[others[j]]))
                        if x != y:
                            joined[max(x, y)] = min(x, y)
                            out.append((int(node[i]), int(node[others[j]])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)], names=["a", "b"])

    return rows.mapInArrow(lean(run), "a bigint, b bigint")


def tiles(held: DataFrame) -> DataFrame:
    """Rows (key, node, label, n, ...) of buckets with several components as rows of tiles (key, lc, rc, side): on side 0 members outside the bucket's largest component, on side 1 all. A bucket of many members has many tiles."""
    by_label = held.groupBy("key", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("hashes"))
    order = F.struct("rows", "label")
    bucket = by_label.groupBy("key").agg(F.max_by(F.struct("label", "rows", "hashes"), order).alias("m"), F.sum("rows").alias("rows"), F.sum("hashes").alias("hashes")).where(F.col("rows") > F.col("m.rows"))
    chunks = lambda rows, hashes: F.greatest(F.lit(1), F.ceil(rows / CHUNK), F.ceil(hashes / CHUNK_HASHES)).cast("int")
    sides = bucket.select("key", F.col("m.label").alias("main"), chunks(F.col("rows") - F.col("m.rows"), F.col("hashes") - F.col("m.hashes")).alias("_l"), chunks(F.col("rows"), F.col("hashes")).alias("_r"))
    rows = held.join(sides, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n)).cast("int")
    left = rows.where("label <> main").withColumn("lc", own(1, "_l")).withColumn("rc", every("_r")).withColumn("side", F.lit(0))
    right = rows.withColumn("rc", own(2, "_r")).withColumn("lc", every("_l")).withColumn("side", F.lit(1))
    return left.unionByName(right).drop("main", "_l", "_r")


def by_tile(rows: DataFrame) -> DataFrame:
    """Rows with those of a tile together, in order."""
    return rows.repartition(*TILE).sortWithinPartitions(*TILE)


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): label is the smallest node that can be reached, for every node of an edge. Alternating stars."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select("b", "m").where("b <> m").toDF("a", "b").unionByName(lowest.toDF("a", "b")).distinct()
        edges = written(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, label) after joining components by links (a, b) between nodes."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
    between = links.join(of("a"), "a").join(of("b"), "b").select(F.col("l_a").alias("a"), F.col("l_b").alias("b"))
    lead = components(between).select(F.col("node").alias("label"), F.col("label").alias("lead"))
    return written(labels.join(lead, "label", "left").select("node", F.coalesce("lead", "label").alias("label")))


def node_labels(docs: DataFrame, sketch: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, label) of the nodes that share a bucket with another."""
    some = sketch.where("node is not null")
    nodes = some.groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    keyed = some.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("full")).where("lo <> hi").select("key", "full")
    members = written(keyed.join(shared, "key").groupBy("key", "node").agg(F.max("full").alias("full")))
    labels = written(members.select("node").distinct().withColumn("label", F.col("node")))
    sets = sets_of(labels.select("node"), sketch, docs, size)
    # The most central members of each bucket; only ROUNDS rows of a bucket leave a task.
    central = members.groupBy("node").agg(F.sum("full").alias("weight"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("weight"), "node"))
    reps = written(members.select("key", "node").join(central, "node").withColumn("turn", rank).where(F.col("turn") <= ROUNDS).select("key", "turn", F.col("node").alias("b")))
    tried = None
    for turn in range(1, ROUNDS + 1):
        rep = reps.where(F.col("turn") == turn).join(labels.select(F.col("node").alias("b"), F.col("label").alias("l_b")), "b").select("key", "b", "l_b")
        pairs = members.select("key", "node").join(labels, "node").join(rep, "key").where("label <> l_b")
        pairs = pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs)
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = confirmed(pairs, nodes, sets, percent)
        if not links.isEmpty():
            labels = relabelled(labels, links)
    of = some.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    held = members.select("key", "node").join(labels, "node")
    split = held.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    rows = tiles(held.join(split, "key", "left_semi").join(of, "node"))
    likely = written(likely_rows(by_tile(rows.select(*TILE, "side", "node", "label", "n", "bits", "bands")), percent))
    if likely.isEmpty():
        return labels
    full = likely.join(sets.join(of, "node").join(labels, "node"), "node")
    links = written(tile_links(by_tile(full.select(*TILE, "side", "node", "label", "n", "bits", "bands", "members")), percent))
    return labels if links.isEmpty() else relabelled(labels, links)


def near_duplicates(df: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept of every row."""
    docs = df.select("doc_id", "text")
    sketch = written(sketched(docs, size))
    labels = node_labels(docs, sketch, size, percent)
    named = sketch.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = named.groupBy("label").agg(F.min("least").alias("component"))
    ids = named.join(first, "label").select("node", "component")
    rows = sketch.select("doc_id", "n_shingles", "node")
    out = rows.where("node is not null").join(ids, "node").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(df: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Of (doc_id, text, row), where row names the text, doc_id and row of one document of each component: that of the smallest id, or one without an id where none has one. Each text without words is by itself."""
    docs = df.select("doc_id", "text", "row")
    sketch = written(sketched(docs, size))
    labels = node_labels(docs, sketch, size, percent)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    least = sketch.where("node is not null").groupBy("node").agg(F.min(order).alias("r")).join(labels, "node", "left")
    least = least.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("r").alias("r")).select("r.doc_id", "r.row")
    return least.unionByName(sketch.where("node is null").select("doc_id", "row").distinct())
