"""Toxicity of texts by weak supervision.

Many voters look at a text: word lists, one of them mined from labelled rows, and patterns (insults aimed at a reader,
in disguise, in capitals; shouting; exclamation marks; symbols; repetition). A generative model of two classes says how
often each voter speaks in each class, given what its parent voter says: the parents are a spanning tree of the pairs
that the classes leave most correlated. Accuracies and correlations are estimated together by expectation maximisation
over the counts of vote patterns of ALL texts, labelled or not; a label of a training row is one voter more, whose
reliability is estimated too. The posterior of the model labels a sample of texts, and a linear (logistic) classifier
over all words (in buckets of their hashes), listed words, voters and their densities learns from those. Scores come
from the classifier alone, that is, from text alone.

What the driver gets is bounded: counts by vote pattern, MOST_WORDS mined words and FIT_ROWS texts as features.
MINED_ROWS and FIT_ROWS bound the samples of rows that the fits use. Mining counts words on the executors and takes
those whose share among toxic labelled rows beats their share among others by more than Z standard errors.

A null text counts as empty; an empty text has no votes and the score of such texts. A very long text is looked at
whole, at some 100 bytes a code point. Rows without a label train nothing. Repeated rows count each; of several labels
of an id the largest holds; ties between mined words go to the smaller hash. If there are no labels of both classes, the
lists alone start the estimate. Every row gets a row. An empty table gives an empty result. Columns named like an output
are dropped first.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import categories, codepoints, lean, lower_table, run_hashes, text_batches, written

#: Bounds of the samples that mining and fitting use.
MINED_ROWS, FIT_ROWS = 20_000, 10_000
#: Standard errors that a mined word needs, texts it must be in, and words mined at most.
Z, LEAST_TEXTS, MOST_WORDS = 6.0, 5, 200
#: Rounds of the estimate, and nats that two voters must tell of each other within the classes to be parent and child.
ROUNDS, CORRELATED = 60, 0.005
#: Bits of a word's bucket; Newton's steps, those of each step's solver, and the ridges of other features and of buckets.
BUCKET_BITS, STEPS, SOLVER_STEPS, RIDGE, WORD_RIDGE = 13, 12, 25, 1.0, 4.0

# Words that insult or threaten, by kind, in four languages.
LEXICONS = {
    "stupidity": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile fool fools clown clowns brainless dimwit idiota imbécil estúpido estúpida imbécile crétin stupide dummkopf trottel",
    "worth": "worthless loser losers pathetic useless failure nobody inútil perdedor patético minable nul versager wertlos erbärmlich",
    "filth": "trash garbage scum filth filthy disgusting vile vermin pig pigs basura asqueroso escoria ordure dégoûtant abschaum widerlich müll",
    "hatred": "hate hated despise loathe kill murder hang rape odio matar détester tuer hasse töten",
    "vulgarity": "damn bastard bastards bitch crap ass asshole shit fuck fucking dick whore slut mierda puta merde salope putain scheiße arschloch hure",
    "mockery": "shut ugly freak weirdo creep coward liar joke ridiculous crybaby cobarde mentiroso menteur lâche feigling lügner",
}
# Words that speak to a reader, and symbols that stand for letters in disguise.
READER = "you your youre yourself u ur tú tu usted vous toi votre du dich dir sie ihr"
DISGUISE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

VOTERS = [*LEXICONS, "mined", "several", "dense", "aimed", "disguised", "loud_insult", "shouting", "exclaiming", "symbols", "repeating", "clean"]


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of words as texts have them."""
    flat, _ = codepoints(words)
    return run_hashes(lower_table()[flat], categories()[flat] == ord("L"))[2]


@functools.cache
def lists() -> dict[str, np.ndarray]:
    return {k: np.sort(hash_words(v.split())) for k, v in LEXICONS.items()}


@dataclass
class Vocabulary:
    """Sorted word hashes by list; "mined" is one of the lists."""

    lists: dict[str, np.ndarray]

    @staticmethod
    def of(mined: np.ndarray, without: np.ndarray) -> Vocabulary:
        return Vocabulary({k: v[~np.isin(v, without)] for k, v in lists().items()} | {"mined": mined})


@functools.cache
def reader() -> np.ndarray:
    return np.sort(hash_words(READER.split()))


@functools.cache
def disguises() -> np.ndarray:
    out = np.arange(len(categories()), dtype=np.uint32)
    for a, b in DISGUISE.items():
        out[ord(a)] = ord(b)
    return out


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Places of x in sorted `known`, -1 for those that are not there."""
    if not len(known):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return np.where(known[at] == x, at, -1)


@dataclass
class Words:
    """Words of a batch of texts."""

    doc: np.ndarray
    hashes: np.ndarray
    loud: np.ndarray  # whether a word is in capitals
    texts: int
    per_text: np.ndarray


def words_of(flat: np.ndarray, ends: np.ndarray) -> Words:
    letter = categories()[flat] == ord("L")
    low = lower_table()[flat]
    begin, length, hashes = run_hashes(low, letter)
    capitals = np.concatenate(([0], np.cumsum(letter & (low != flat))))
    loud = (capitals[begin + length] - capitals[begin] == length) & (length > 1)
    doc = np.searchsorted(ends, begin)
    return Words(doc, hashes, loud, len(ends), np.bincount(doc, minlength=len(ends)))


@dataclass
class Bag:
    """Distinct word buckets of texts: a row and a bucket each, in order of rows. A text's buckets weigh one over the root of their number."""

    row: np.ndarray
    bucket: np.ndarray
    texts: int

    @staticmethod
    def of(w: Words) -> Bag:
        pairs = np.unique((w.doc.astype(np.uint64) << np.uint64(BUCKET_BITS)) | (w.hashes >> np.uint64(64 - BUCKET_BITS)))
        return Bag((pairs >> np.uint64(BUCKET_BITS)).astype(np.int64), (pairs & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64), w.texts)

    def scale(self) -> np.ndarray:
        return 1 / np.sqrt(np.maximum(np.bincount(self.row, minlength=self.texts), 1))

    def times(self, weights: np.ndarray) -> np.ndarray:
        return self.scale() * np.bincount(self.row, weights[self.bucket], self.texts)

    def back(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.bucket, (self.scale() * values)[self.row], 1 << BUCKET_BITS)


def look(texts: list[str], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, Bag]:
    """Votes (texts x voters), features (texts x (listed words + mined words + voters + densities)) and all words."""
    flat, ends = codepoints(texts)
    w = words_of(flat, ends)
    n = w.texts
    size = np.maximum(w.per_text, 1)
    chars = np.diff(np.concatenate(([-1], ends))) - 1
    votes = np.zeros((n, len(VOTERS)), bool)
    vote = lambda name, x: votes.__setitem__((slice(None), VOTERS.index(name)), x)
    count = lambda mask: np.bincount(w.doc[mask], minlength=n)
    insult = np.zeros(len(w.hashes), bool)
    columns = []
    for name, known in vocabulary.lists.items():
        at = among(w.hashes, known)
        hit = at >= 0
        insult |= hit
        vote(name, count(hit) > 0)
        each = np.zeros((n, len(known)), np.float32)
        each[w.doc[hit], at[hit]] = 1
        columns.append(each)
    insults = count(insult)
    vote("several", insults >= 2)
    vote("dense", 150 * insults > size)
    near = among(w.hashes, reader()) >= 0
    aimed = np.zeros(len(near), bool)
    for k in range(1, 5):  # a word to the reader up to four words before or after
        if len(near) > k:
            same = w.doc[k:] == w.doc[:-k]
            aimed[k:] |= insult[k:] & near[:-k] & same
            aimed[:-k] |= insult[:-k] & near[k:] & same
    vote("aimed", count(aimed) > 0)
    odd = disguises()[flat]
    masked = odd != flat
    letter = categories()[odd] == ord("L")
    if masked.any():
        begin, length, hashes = run_hashes(lower_table()[odd], letter)
        signs = np.concatenate(([0], np.cumsum(masked)))
        hidden = (signs[begin + length] > signs[begin]) & (length > 3)
        hidden &= np.logical_or.reduce([among(hashes, k) >= 0 for k in vocabulary.lists.values()])
        vote("disguised", np.bincount(np.searchsorted(ends, begin[hidden]), minlength=n) > 0)
    vote("loud_insult", count(insult & w.loud) > 0)
    louds = count(w.loud) / size
    by_text = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)[ends])))
    exclaims = by_text(flat == 0x21) / size
    symbols = by_text((flat == 0x23) | (flat == 0x24) | (flat == 0x25) | (flat == 0x26) | (flat == 0x2A)) / np.maximum(chars, 1)
    repeats = np.bincount(w.doc[1:][(w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])], minlength=n) / size
    vote("shouting", (louds > 0.3) & (w.per_text > 3))
    vote("exclaiming", exclaims > 0.2)
    vote("symbols", symbols > 0.1)
    vote("repeating", repeats > 0.3)
    vote("clean", insults == 0)
    dense = np.stack((np.log1p(insults), np.log1p(1000 * insults / size), louds, np.minimum(exclaims, 2), symbols, repeats), axis=1).astype(np.float32)
    return votes, np.hstack((*columns, votes.astype(np.float32), dense)), Bag.of(w)


def pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (1 << np.arange(votes.shape[1], dtype=np.int64))


def sampled(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """About `rows` rows at most, chosen by a hash of the key."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(F.lit(5), key), F.lit(1_000_000)) < int(1_000_000 * rows / n))


def word_counts(docs: DataFrame) -> DataFrame:
    """(label, text) -> word, k (texts that have it) and k1 (toxic ones); the null word counts the texts themselves. Batches are summed up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            w = words_of(*codepoints(texts))
            toxic = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
            pairs = np.unique(np.stack((w.hashes, w.doc.astype(np.uint64))), axis=1)
            words, begin = np.unique(pairs[0], return_index=True)
            k = np.diff(np.append(begin, pairs.shape[1]))
            k1 = np.add.reduceat(toxic[pairs[1].astype(np.int64)], begin) if len(words) else k
            word = pa.array([None, *words.view(np.int64).tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([word, pa.array(np.append(len(texts), k)), pa.array(np.append(toxic.sum(), k1))], names=["word", "k", "k1"])

    return docs.select("label", "text").mapInArrow(lean(run), "word bigint, k bigint, k1 bigint").groupBy("word").agg(F.sum("k").alias("k"), F.sum("k1").alias("k1"))


def mined_words(docs: DataFrame, told: DataFrame) -> Vocabulary:
    """The lists with the words that tell toxic texts from others, without words that labels contradict; from MINED_ROWS labels at most, which are few enough to go to all executors."""
    nothing = np.empty(0, np.uint64)
    counts = written(word_counts(docs.join(F.broadcast(sampled(told, MINED_ROWS)), "doc_id")))
    every = counts.where("word is null").first()
    n1, n0 = (int(every["k1"]), int(every["k"] - every["k1"])) if every else (0, 0)
    if not n1 or not n0:
        return Vocabulary.of(nothing, nothing)
    share = n1 / (n1 + n0)
    known = np.unique(np.concatenate(list(lists().values()))).view(np.int64).tolist()
    z = (F.col("k1") - F.col("k") * share) / F.sqrt(F.col("k") * (share * (1 - share)))
    words = counts.where(f"word is not null and k >= {LEAST_TEXTS}").withColumn("z", z)
    # A word of a label's noise is in few texts; one that marks a class has most of its texts there.
    good = words.where((F.col("z") > Z) & (F.col("k1") >= LEAST_TEXTS) & (2 * F.col("k1") > F.col("k")) & ~F.col("word").isin(known)).orderBy(F.desc("z"), "word").limit(MOST_WORDS)
    against = words.where((2 * F.col("k1") < F.col("k")) & F.col("word").isin(known))  # some of the lists' words
    taken = lambda df: np.array(sorted(r["word"] for r in df.select("word").collect()), np.int64).view(np.uint64)
    return Vocabulary.of(np.sort(taken(good)), taken(against))


@dataclass
class LabelModel:
    prior: float
    parent: np.ndarray  # the voter that each voter depends on, or -1
    speaks: np.ndarray  # probability of each voter's vote, by class and by its parent's vote
    label: np.ndarray  # probability that a label says toxic, by class

    def likelihood(self, votes: np.ndarray) -> np.ndarray:
        """Log-probability of vote patterns by class (patterns x 2)."""
        p = np.clip(self.speaks, 1e-4, 1 - 1e-4)
        above = np.where(self.parent >= 0, votes[:, self.parent], False).astype(np.int64)
        every = np.arange(votes.shape[1])
        chance = np.stack([p[c][above, every] for c in (0, 1)])
        return np.log(np.where(votes, chance, 1 - chance)).sum(axis=2).T

    def posterior(self, votes: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Probability of the toxic class; label is 0, 1 or -1 for none."""
        each = self.likelihood(votes)
        x = np.log(self.prior / (1 - self.prior)) + each[:, 1] - each[:, 0]
        q = np.clip(self.label, 1e-3, 1 - 1e-3)
        x = x + np.where(label == 1, np.log(q[1] / q[0]), np.where(label == 0, np.log((1 - q[1]) / (1 - q[0])), 0.0))
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def pair_tables(votes: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Weight of the patterns by class, voter, other voter, and what both say: [c, j, k, vote of j, vote of k]."""
    v = votes.astype(np.float64)
    out = np.empty((2, v.shape[1], v.shape[1], 2, 2))
    for c in (0, 1):
        both = (v * mass[c][:, None]).T @ v
        one = mass[c] @ v
        out[c, :, :, 1, 1] = both
        out[c, :, :, 1, 0] = one[:, None] - both
        out[c, :, :, 0, 1] = one[None, :] - both
        out[c, :, :, 0, 0] = mass[c].sum() - one[:, None] - one[None, :] + both
    return np.maximum(out, 0)


def correlations(tables: np.ndarray) -> np.ndarray:
    """What two voters tell of each other within the classes, in nats (conditional mutual information)."""
    p = (tables + 0.05) / (tables.sum() / tables.shape[1] ** 2 + 0.4)
    of_class = p.sum(axis=(3, 4), keepdims=True)
    own, other = p.sum(axis=4, keepdims=True), p.sum(axis=3, keepdims=True)
    return (p * np.log(p * of_class / (own * other))).sum(axis=(0, 3, 4))


def spanning_tree(weight: np.ndarray) -> np.ndarray:
    """The parent of each voter in the heaviest spanning tree, -1 for the first and where the link is too light."""
    n = len(weight)
    parent, inside = np.full(n, -1), np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        ahead = np.where(inside[:, None] & ~inside[None, :], weight, -np.inf)
        i, j = np.unravel_index(int(ahead.argmax()), ahead.shape)
        inside[j] = True
        if weight[i, j] > CORRELATED:
            parent[j] = i
    return parent


def estimated(tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """Probability of each voter's vote by class and parent's vote. A vote more and a silence more, so that what was not seen is not impossible."""
    every = np.arange(tables.shape[1])
    given = tables[:, every, np.maximum(parent, 0)]  # class, voter, its vote, parent's vote
    given = np.where((parent >= 0)[None, :, None, None], given, given.sum(axis=3, keepdims=True))
    return np.moveaxis((given[:, :, 1, :] + 0.5) / (given.sum(axis=2) + 1), 2, 1)


def label_model(votes: np.ndarray, label: np.ndarray, n: np.ndarray, lists_: int = len(LEXICONS) + 1) -> LabelModel:
    """From distinct vote patterns, their labels (-1: none) and how many texts have each. The first `lists_` voters are lists."""
    known = label >= 0
    toxic = float((n * (label == 1)).sum())
    prior = np.clip(toxic / max(1.0, float(n[known].sum())), 0.01, 0.5) if toxic else 0.1
    # Labels start the estimate, and where there are none, the lists do.
    y = np.where(label == 1, 0.9, np.where(label == 0, 0.05, np.where(votes[:, :lists_].any(axis=1), 0.7, 0.02)))
    model = LabelModel(float(prior), np.full(votes.shape[1], -1), np.full((2, 2, votes.shape[1]), 0.5), np.array([0.02, 0.9]))
    # The tree comes first, from labelled texts where both classes have some: classes estimated without it would form around correlated voters.
    sure = n * known if toxic and toxic < float(n[known].sum()) else n
    model.parent = spanning_tree(correlations(pair_tables(votes, np.stack((sure * (y < 0.5), sure * (y >= 0.5))))))
    for _ in range(ROUNDS):
        mass = np.stack((n * (1 - y), n * y))
        model.speaks = estimated(pair_tables(votes, mass), model.parent)
        model.prior = float(np.clip((mass[1].sum() + 1) / (n.sum() + 2), 0.005, 0.5))
        told = mass[:, known]
        model.label = (told @ (label[known] == 1) + np.array([0.02, 0.9])) / (told.sum(axis=1) + 1)
        model.label[1] = max(model.label[1], 0.6)
        y = model.posterior(votes, label)
    return model


@dataclass
class Classifier:
    vocabulary: Vocabulary
    weights: np.ndarray
    words: np.ndarray  # by bucket
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        _, x, bag = look(texts, self.vocabulary)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + bag.times(self.words) + self.bias, -30, 30)))


def logistic(x: np.ndarray, bag: Bag, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, weights of buckets and bias of a ridge regression on soft labels: Newton's steps, each solved by conjugate gradients."""
    x = np.hstack((x, np.ones((len(x), 1), np.float32)))
    d = x.shape[1]
    ridge = np.concatenate((np.full(d - 1, RIDGE), [1e-3], np.full(1 << BUCKET_BITS, WORD_RIDGE)))
    out = lambda v: x @ v[:d].astype(np.float32) + bag.times(v[d:])
    back = lambda r: np.concatenate((x.T @ r.astype(np.float32), bag.back(r)))
    w = np.zeros(len(ridge))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(out(w), -30, 30)))
        spread = p * (1 - p) + 1e-9
        steep = 1 / (ridge + np.concatenate(((x * x).T @ spread.astype(np.float32), np.full(1 << BUCKET_BITS, 1.0))))
        rest = back(y - p) - ridge * w
        move, ahead = np.zeros(len(w)), steep * rest
        aim, begun = ahead.copy(), float(rest @ ahead)
        now = begun
        for _ in range(SOLVER_STEPS):
            if now <= 1e-8 * begun or now <= 1e-12:
                break
            curve = back(spread * out(aim)) + ridge * aim
            far = now / float(aim @ curve)
            move += far * aim
            rest = rest - far * curve
            ahead = steep * rest
            now, was = float(rest @ ahead), now
            aim = ahead + (now / was) * aim
        w += move
        if np.abs(move).max() < 1e-4:
            break
    return w[: d - 1], w[d:], float(w[d - 1])


def learn(docs: DataFrame, told: DataFrame) -> Classifier:
    """From texts (doc_id, text) and labels of training rows (doc_id, label), one a document. Texts are read where they are; only votes meet labels."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = mined_words(docs, told)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            votes, _, _ = look(texts, held.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pattern(votes))], names=["doc_id", "pattern"])

    voted = docs.mapInArrow(lean(run), "doc_id bigint, pattern bigint").join(told, "doc_id", "left")
    counts = voted.groupBy("pattern", "label").agg(F.count("*").alias("n")).toArrow()  # one row for each pattern of votes
    votes_of = lambda p: (p[:, None] >> np.arange(len(VOTERS))) & 1 == 1
    patterns = counts.column("pattern").to_numpy()
    width = look([""], vocabulary)[1].shape[1]
    if not len(patterns):
        return Classifier(vocabulary, np.zeros(width), np.zeros(1 << BUCKET_BITS), 0.0)
    model = label_model(votes_of(patterns), counts.column("label").fill_null(-1).to_numpy(), counts.column("n").to_numpy().astype(float))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            votes, x, bag = look(texts, held.value)
            at = np.searchsorted(bag.row, np.arange(len(texts) + 1))
            own = [bag.bucket[a:b].astype("<u2").tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pattern(votes)), pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary()), pa.array(own, pa.binary())], names=["doc_id", "pattern", "x", "words"])

    fit = sampled(docs, FIT_ROWS).mapInArrow(lean(features), "doc_id bigint, pattern bigint, x binary, words binary").groupBy("doc_id").agg(F.min(F.struct("pattern", "x", "words")).alias("r")).select("doc_id", "r.*")
    fit = fit.join(told, "doc_id", "left").orderBy("doc_id").select("pattern", "label", "x", "words").toArrow()
    x = np.frombuffer(b"".join(fit.column("x").to_pylist()), np.float16).reshape(-1, width).astype(np.float32)
    words = fit.column("words").to_pylist()
    bag = Bag(np.repeat(np.arange(len(words)), [len(b) // 2 for b in words]), np.frombuffer(b"".join(words), "<u2").astype(np.int64), len(words))
    y = model.posterior(votes_of(fit.column("pattern").to_numpy()), fit.column("label").fill_null(-1).to_numpy())
    return Classifier(vocabulary, *logistic(x, bag, y))


def scored(df: DataFrame, classifier: Classifier, column: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from 0.5 on) to every row; `column` is dropped."""
    kept = [c for c in df.columns if c.lower() not in ("score", "predicted") and c != column]
    held = df.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, column):
            s = held.value.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = df.select(*kept).schema.add("score", "double").add("predicted", "integer")
    return df.select(*kept, column).mapInArrow(lean(run), schema)


def fold(column: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every text; labels of four fifths of the ids, by their CRC, are learned. Of several labels of an id the largest counts; a null id is held out."""
    held_out = F.coalesce(fold() == 0, F.lit(True))
    told = labels.where(~held_out & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    classifier = learn(docs, told)
    return scored(docs.select("doc_id", "text", held_out.alias("held_out")), classifier)
