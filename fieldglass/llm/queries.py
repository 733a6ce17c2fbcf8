"""The registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, audit, bpe, conversations, fingerprints, langid, lm, minhash, mixing, pii, sharding, toxicity, wordbpe
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The rank file of op1; the operators take any.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The tokenizer file of op12.
WORDS = "word_bpe_49k.json"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every text, and the bytes decoded from them."""
    return bpe.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth."""
    return ann.digest(table(spark, sf_dir, "embeddings"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked by 0.8 of their 2-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text."""
    return langid.digest(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of all documents into 24 shards whose counts differ by one at most."""
    return sharding.digest(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text."""
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every text by a word n-gram model."""
    return lm.digest(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order MinHash fingerprints of every text and of its edited text."""
    return fingerprints.digest(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources by weight takes of every document."""
    return mixing.digest(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with every damaged conversation, and its cheapest repair."""
    return conversations.digest(table(spark, sf_dir, "conversations"))


def op12_wordbpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word BPE ids of every text, and the text decoded from them."""
    return wordbpe.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all orders of five filters keep and remove, by source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    own = [op1_bpe, op2_pii, op3_ann, op4_minhash, op5_langid, op6_sharding, op7_toxicity, op8_lm, op9_fingerprints, op10_mixing, op11_conversations, op12_wordbpe, op13_audit]
    return {f.__name__: f for f in own}


#: Brute force in SQL: every pair of a query and another row.
NEAREST = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda x: (x[1] - x[2]) * (x[1] - x[2])))) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
#: Targets by one level, and words taken in order of a hash, in windows over whole sources.
MIXED = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, CASE rank % 3 WHEN 0 THEN -0.5 WHEN 1 THEN 0.0 ELSE 0.5 END AS slope FROM s),
c AS (SELECT *, CAST(source_size AS DOUBLE) * 3 AS cap, CAST(source_size AS DOUBLE) * 3 / CAST(weight AS DOUBLE) AS ratio FROM w),
l AS (SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(CAST(weight AS DOUBLE)) OVER (ORDER BY ratio, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
g AS (SELECT source, source_size, slope, coalesce(least(cap, CAST(weight AS DOUBLE) * (SELECT arg_min(level, (ratio, rank)) FROM l WHERE level <= ratio)), 0) AS target FROM l),
o AS (SELECT d.*, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5('11:' || doc_id || ':' || size), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d),
k AS (SELECT o.*, source_size, target, CAST(slope AS DOUBLE) AS a, CAST(floor(target) AS BIGINT) AS whole, CASE WHEN target > 0 THEN least(before / target, 1.0) END AS u FROM o JOIN g ON o.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  least(greatest(whole - before, 0), size) + least(greatest(whole - source_size - before, 0), size) + least(greatest(whole - 2 * source_size - before, 0), size) AS taken,
  CASE WHEN target > 0 THEN 2 * u / ((1 - a) + sqrt((1 - a) * (1 - a) + 4 * a * u)) ELSE 0.0 END AS position
FROM k
"""

#: Distinct shingles, pairs that share enough of them, and a walk over their links.
LINKED = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS sh FROM w
), n AS (SELECT w.doc_id, count(sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
walk AS (SELECT doc_id, doc_id AS other FROM n UNION SELECT walk.doc_id, e.b FROM walk JOIN e ON e.a = walk.other)
SELECT n.doc_id, n.n AS n_shingles, min(other) AS component_id, n.doc_id = min(other) AS kept FROM n JOIN walk USING (doc_id) GROUP BY n.doc_id, n.n
"""


#: CRC-32 bit by bit, damage, and for each conversation a walk over its rows, state by state of the grammar.
REPAIRED = """
WITH RECURSIVE b AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x FROM conversations
), k AS (
  SELECT id, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(id) + 1), lambda i: CAST(ascii(id[i]) AS BIGINT))),
    lambda c, y: list_reduce(list_prepend(xor(c, y), [CAST(0 AS BIGINT) for z in range(8)]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 20 AS kind
  FROM (SELECT DISTINCT id FROM b)
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS text
  FROM b JOIN k USING (id), generate_series(1, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
f AS (
  SELECT *, regexp_replace(text, '[\\x20\\x09-\\x0D]+$', '') AS kept, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, left(role, 1) AS i,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o
), t AS (
  SELECT *, kept = '' AS blank, kept <> '' AND again AS dup, kept <> '' AND NOT again AND NOT regexp_matches(kept, '[.!?]$') AS cut FROM f
), arcs(s, i, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
ins(s, t, n, ops) AS (SELECT s, s, 0, '' FROM generate_series(0, 3) g(s) UNION ALL SELECT s, t, 1, 'I' FROM arcs WHERE i <> 's' UNION ALL SELECT x.s, y.t, 2, 'II' FROM arcs x JOIN arcs y ON y.s = x.t WHERE x.i <> 's' AND y.i <> 's'),
ids AS (SELECT DISTINCT conv_id FROM conversations),
w(conv_id, n, s, y) AS (
  SELECT conv_id, CAST(0 AS BIGINT), ins.t, {'cost': CAST(2 * ins.n AS BIGINT), 'audit': ops} FROM ids JOIN ins ON ins.s = 0
  UNION ALL
  SELECT w.conv_id, r.n, ins.t, min({'cost': w.y.cost + e.cost + 2 * ins.n, 'audit': w.y.audit || e.op || ins.ops})
  FROM w JOIN t r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1, LATERAL (
    SELECT w.s AS next, 'D' AS op, CAST(3 AS BIGINT) AS cost
    UNION ALL SELECT arcs.t AS next, 'K', CAST(r.cut AS BIGINT) FROM arcs WHERE arcs.s = w.s AND arcs.i = r.i AND NOT r.blank AND NOT r.dup
    UNION ALL SELECT arcs.t AS next, 'R', 2 + CAST(r.cut AS BIGINT) FROM arcs WHERE arcs.s = w.s AND arcs.i <> 's' AND NOT r.blank AND NOT r.dup
  ) e JOIN ins ON ins.s = e.next GROUP BY ALL
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS rows FROM t GROUP BY conv_id
), z AS (SELECT w.conv_id, min(y) AS y FROM w LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.n = coalesce(g.rows, 0) AND w.s IN (0, 3) GROUP BY w.conv_id),
p AS (
  SELECT conv_id, p, y.audit[p] AS op, p - len(replace(y.audit[:p], 'I', '')) AS inserts, len(replace(y.audit, 'D', '')) % 2 AS odd, len(replace(y.audit[:p], 'D', '')) AS place FROM z, generate_series(1, len(y.audit)) q(p)
), v AS (
  SELECT p.conv_id, p, CASE WHEN op = 'K' THEN t.role WHEN (place + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE t.text END AS line
  FROM p LEFT JOIN t ON op <> 'I' AND t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.n = p - inserts WHERE op <> 'D'
), h AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS lines FROM v GROUP BY conv_id)
SELECT z.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, z.y.cost AS cost, z.y.audit AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM z LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM z.conv_id
"""
#: Every order applied step by step to every document.
AUDITED = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents
), f AS (
  SELECT part, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic,
    concat(CASE WHEN len(w) < 50 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' END,
      CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text) THEN 'C' END, CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' END, CASE WHEN doc_id > first THEN 'E' END) AS fails
  FROM d
), o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || c FROM o, unnest(['A', 'B', 'C', 'D', 'E']) x(c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, filter_order[:step - 1] AS before FROM o, generate_series(1, 5) g(step) WHERE len(filter_order) = 5),
x AS (SELECT part, filter_order, step, own, good, toxic, contains(fails, own) AS failing, fails = own AS only_own, len(translate(fails, before, '')) < len(fails) AS gone FROM f, s),
r AS (
  SELECT part, filter_order, step, own, count(*) FILTER (NOT failing AND NOT gone) AS kept, count(*) FILTER (failing AND NOT gone) AS removed, count(*) FILTER (failing AND gone) AS redundant,
    count(*) FILTER (only_own) AS unique_fails, count(*) FILTER (failing AND NOT gone AND good) AS good_lost, count(*) FILTER (failing AND NOT gone AND toxic) AS toxic_lost
  FROM x GROUP BY ALL
)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_ann": NEAREST, "op4_minhash": LINKED, "op10_mixing": MIXED, "op11_conversations": REPAIRED, "op13_audit": AUDITED}
