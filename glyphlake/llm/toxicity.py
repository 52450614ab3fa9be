"""Toxicity: bags of subword embeddings, averaged into a linear softmax.

A word is the mean of the embeddings of itself and of its character n-grams
(hashed), a text the weighted mean of its words and of a neutral one that
holds short texts back. A word weighs the root of its count times the mean
weight of its buckets; a bucket weighs as much as its presence tells the two
labels apart in the sample, beyond chance, so that the many words that say
nothing don't dilute a long text. Embeddings and softmax are trained together
in numpy, with Adam, over a bounded sample of labelled texts. Unseen spellings
share n-grams with seen ones. Because all is linear up to the softmax, a word
has one weight and one score that a process computes once.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import crc_mod, slices

#: Labelled texts of label 1 that the training looks at, at most; of label 0, four times as many.
TEXTS_A_CLASS = 600
BUCKETS, WIDTH, GRAMS = 1 << 16, 4, (3, 4, 5, 6)
STEPS, RATE = 50, 1.5
#: Added to the root of the second moment: buckets with small gradients, the rare ones, move less.
SOFT = 1e-5
#: A word counts in training if so many texts of the sample have it (fewer in small samples).
LEAST = 5
#: A bucket weighs what its presence differs between the labels, in standard deviations, beyond so many.
CHANCE = 2.5
#: Weight of the neutral word, of score zero, that every text is taken to have besides its own.
NEUTRAL = 1.0
#: Root of a word's count, at most: a word said a hundred times says little more than one said four times.
LOUDEST = 2.0
#: Parts of the sample; each is scored by a model of the others to place the cut.
FOLDS = 3
#: Words whose scores a process remembers; then it starts anew.
REMEMBERED = 300_000
#: Words whose n-grams are hashed at once.
BLOCK = 8192
WORDS = re.compile(r"[^\W_]+")
THRESHOLD = 0.7


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their n-grams, ends marked, and the number of the word that each belongs to, in order.

    n-grams of all words are hashed together, over code points, as polynomials
    mod 2^32 whose upper half is folded in.
    """
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(m) for m in marked], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    room = lengths.cumsum()[owner] - np.arange(len(codes))  # characters from here to the end of the word
    buckets, owners = [np.array([crc32(m.encode()) for m in marked], np.uint32)], [np.arange(len(words))]
    for n in GRAMS:
        at = np.flatnonzero(room >= n)
        h = np.full(len(at), n, np.uint32)
        for k in range(n):
            h = h * np.uint32(2654435761) + codes[at + k]
        buckets.append(h ^ (h >> np.uint32(15)))
        owners.append(owner[at])
    bucket, own = np.concatenate(buckets) % np.uint32(BUCKETS), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return bucket[order].astype(np.int64), own[order]


@dataclass
class Model:
    """For each bucket its score, embedding . (toxic - clean direction), and its weight in the mean; the bias likewise."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


@dataclass
class Bags:
    """Word counts of labelled texts: for each text a label, for each entry its text, word number and count."""

    labels: np.ndarray
    text: np.ndarray
    word: np.ndarray
    count: np.ndarray
    words: list[str]

    @classmethod
    def of(cls, rows: list[tuple[int, dict[str, int]]]) -> Bags:
        number: dict[str, int] = {}
        entries = [(i, number.setdefault(w, len(number)), c) for i, (_, bag) in enumerate(rows) for w, c in sorted(bag.items())]
        text, word, count = (np.array(x, np.int64) for x in (zip(*entries) if entries else ((), (), ())))
        return cls(np.array([y for y, _ in rows], np.int64), text, word, count, list(number))

    def part(self, chosen: np.ndarray) -> Bags:
        keep = chosen[self.text]
        place = np.cumsum(chosen) - 1
        return Bags(self.labels[chosen], place[self.text[keep]], self.word[keep], self.count[keep], self.words)

    def frequent(self, least: int) -> Bags:
        """Without words that fewer than ``least`` texts have."""
        wide = np.bincount(self.word, minlength=len(self.words)) >= max(1, least)
        keep, number = wide[self.word], np.cumsum(wide) - 1
        return Bags(self.labels, self.text[keep], number[self.word[keep]], self.count[keep], [w for w, ok in zip(self.words, wide) if ok])


def train(bags: Bags, prior: float, steps: int = STEPS, seed: int = 7) -> Model:
    """fit() on the whole sample, its bias moved so that THRESHOLD is where texts are best told apart that a model hasn't seen."""
    model, y = fit(bags, prior, steps, seed), bags.labels
    if min(np.bincount(y, minlength=2)) < 2 * FOLDS:
        return model
    # Every label is dealt out evenly.
    turn = np.empty(len(y), np.int64)
    for label in (0, 1):
        turn[y == label] = np.arange((y == label).sum()) % FOLDS
    logits = np.empty(len(y))
    for k in range(FOLDS):
        logits[turn == k] = Scorer(fit(bags.part(turn != k), prior, steps, seed)).logits(bags.part(turn == k))
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    order = np.argsort(-logits, kind="stable")
    hits, taken = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    f1 = 2 * hits / (taken + (weight * y).sum())
    # The cut is the middle of the stretch of cuts that do about as well as the best.
    good = np.flatnonzero(f1 >= f1.max() - 0.005)
    cut = (logits[order][good[0]] + logits[order][min(good[-1] + 1, len(y) - 1)]) / 2
    return Model(model.buckets, model.weights, float(model.bias - cut + np.log(THRESHOLD / (1 - THRESHOLD))))


def bucket_weights(bags: Bags) -> np.ndarray:
    """How much more often texts of one label have a bucket than those of the other, in standard deviations beyond CHANCE; 0 if less."""
    y = bags.labels
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    bucket, owner = subwords(bags.words)
    order = np.argsort(bags.word, kind="stable")
    spread = np.bincount(bags.word, minlength=len(bags.words))
    begin = np.r_[0, spread.cumsum()[:-1]]
    # A row for each bucket of each word and each text that has the word; then each bucket once a text.
    times = spread[owner]
    kind = np.uint32 if BUCKETS * len(y) < 1 << 32 else np.uint64
    whole = np.int32 if times.sum() < 1 << 31 else np.int64
    place = np.arange(times.sum(), dtype=whole) + np.repeat((begin[owner] - np.r_[0, times.cumsum()[:-1]]).astype(whole), times)
    text = bags.text[order].astype(kind)[place]
    seen = np.repeat(bucket.astype(kind), times) * kind(len(y)) + text
    seen.sort()
    seen = seen[np.r_[True, seen[1:] != seen[:-1]]] if len(seen) else seen
    own, text = np.divmod(seen, kind(len(y)))
    ones, both = np.bincount(own, y[text], BUCKETS), np.bincount(own, minlength=BUCKETS)
    share = (both + 1) / (len(y) + 2)
    return np.maximum(0, np.abs(ones / n1 - (both - ones) / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)) - CHANCE)


@dataclass
class Design:
    """The sample as arrays: words' buckets, and each text's share of each word in its mean."""

    doc: np.ndarray
    word: np.ndarray
    share: np.ndarray
    bucket: np.ndarray
    owner: np.ndarray
    truth: np.ndarray
    weight: np.ndarray

    def __post_init__(self):
        lengths = np.bincount(self.owner)
        self.words = len(lengths)
        self.starts, self.part = np.r_[0, lengths.cumsum()[:-1]], (1 / lengths).astype(self.share.dtype)[:, None]

    def step(self, e: np.ndarray, w: np.ndarray, b: np.ndarray) -> tuple[float, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Weighted cross entropy, and its gradients by embeddings, softmax weights and bias."""

        def summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
            return np.stack([np.bincount(at, column, n) for column in rows.T], 1).astype(rows.dtype)

        vectors = summed(self.doc, (np.add.reduceat(e[self.bucket], self.starts) * self.part)[self.word] * self.share, len(self.truth))
        logits = vectors @ w + b
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        g = (p - self.truth) * self.weight
        down = summed(self.word, (g @ w.T)[self.doc] * self.share, self.words) * self.part
        loss = -float((np.log(np.maximum((p * self.truth).sum(1), 1e-30)) * self.weight[:, 0]).sum())
        return loss, (summed(self.bucket, down[self.owner], len(e)), vectors.T @ g, g.sum(0))


def fit(bags: Bags, prior: float, steps: int = STEPS, seed: int = 7) -> Model:
    """Embeddings and softmax, trained together; prior: the share of label 1 among all labelled texts."""
    y = bags.labels
    flat = Model(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), float(np.log((prior + 1e-6) / (1 - prior + 1e-6))))
    if not len(y) or y.min() == y.max():
        return flat
    bags = bags.frequent(min(LEAST, 1 + len(y) // 300))
    weights = bucket_weights(bags)
    bucket, owner = subwords(bags.words)
    told = np.bincount(owner, weights[bucket], len(bags.words)) / np.bincount(owner, minlength=len(bags.words)) if len(bags.words) else np.zeros(0)
    if not told.any():
        return flat
    mass = np.minimum(np.sqrt(bags.count), LOUDEST) * told[bags.word]
    share = mass / (NEUTRAL + np.bincount(bags.text, mass, len(y)))[bags.text]
    keep, number = told[bags.word] > 0, np.cumsum(told > 0) - 1
    of = told[owner] > 0
    # The sample holds the classes in other shares than all labelled texts do; weights restore those.
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean())).astype(np.float32)[:, None] / len(y)
    design = Design(bags.text[keep], number[bags.word[keep]], share[keep].astype(np.float32)[:, None], bucket[of], number[owner[of]], np.eye(2, dtype=np.float32)[y], weight)
    rng = np.random.default_rng(seed)
    e = rng.normal(0, 0.05, (BUCKETS, WIDTH)).astype(np.float32)
    w = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    b = np.zeros(2, np.float32)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (e, w, b)]
    for step in range(1, steps + 1):
        _, gradients = design.step(e, w, b)
        rate = RATE * min(1, 2 * (1 - step / steps) + 0.05)
        for x, gradient, m, own, soft in zip((e, w, b), gradients, moments, (1, 0.2, 0.2), (SOFT, 1e-10, 1e-10)):
            m[0] += 0.1 * (gradient - m[0])
            m[1] += 0.01 * (gradient * gradient - m[1])
            x -= own * rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + soft)
    return Model((e @ (w[:, 1] - w[:, 0])).astype(np.float32), weights.astype(np.float32), float(b[1] - b[0]))


def sample(docs: DataFrame, labels: DataFrame, texts: int = TEXTS_A_CLASS) -> tuple[Bags, float]:
    """Word counts of labelled texts, and the share of label 1 among all labels that may be learnt from.

    Those are of rows whose doc_id's crc32 mod 3 is not 1. The sample has at
    most ``texts`` texts of label 1 and four times as many of label 0, those
    with the smallest hashes of doc_id. Several labels of one doc_id count as
    the largest.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) != 1))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for label in sorted(sizes):
        one = known.filter(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(texts if label else 4 * texts)
        picked = one if picked is None else picked.unionByName(one)
    if picked is None:
        return Bags.of([]), 0.0
    # At most five times `texts` pairs of numbers: small enough to be sent to every executor.
    joined = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.xxhash64("doc_id").alias("place"), "label", "text")

    def count(batches):
        for b in slices(batches, 128):
            bags = [bag(t) for t in b.column(2).to_pylist()]
            words, counts = (pa.array([list(part(x)) for x in bags], kind) for part, kind in ((dict.keys, pa.list_(pa.string())), (dict.values, pa.list_(pa.int32()))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), words, counts], ["place", "label", "words", "counts"])

    got = joined.mapInArrow(count, "place long, label int, words array<string>, counts array<int>").toArrow().sort_by("place")
    lengths = pc.list_value_length(got.column("counts")).to_numpy()
    coded = pc.list_flatten(got.column("words")).combine_chunks().dictionary_encode()
    bags = Bags(
        got.column("label").to_numpy().astype(np.int64),
        np.repeat(np.arange(len(lengths)), lengths),
        coded.indices.to_numpy(zero_copy_only=False).astype(np.int64),
        pc.list_flatten(got.column("counts")).to_numpy().astype(np.int64),
        coded.dictionary.to_pylist(),
    )
    return bags, sizes.get(1, 0) / sum(sizes.values())


def bag(text: str | None) -> dict[str, int]:
    return Counter(WORDS.findall((text or "").lower()))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.weight, self.score = np.empty(1024), np.empty(1024)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's weight and score: the means over its buckets."""
        weight, score = [np.zeros(0)], [np.zeros(0)]
        for at in range(0, len(words), BLOCK):
            bucket, owner = subwords(words[at : at + BLOCK])
            n = np.bincount(owner)
            weight.append(np.bincount(owner, self.model.weights[bucket]) / n)
            score.append(np.bincount(owner, self.model.buckets[bucket]) / n)
        return np.concatenate(weight), np.concatenate(score)

    def logits(self, bags: Bags) -> np.ndarray:
        weight, score = self.words(bags.words)
        mass = np.minimum(np.sqrt(bags.count), LOUDEST) * weight[bags.word]
        n = len(bags.labels)
        return self.model.bias + np.bincount(bags.text, mass * score[bags.word], n) / (NEUTRAL + np.bincount(bags.text, mass, n))

    def learn(self, words: list[str]) -> None:
        at, end = len(self.known), len(self.known) + len(words)
        while end > len(self.weight):
            self.weight, self.score = (np.concatenate([x, np.empty_like(x)]) for x in (self.weight, self.score))
        self.weight[at:end], self.score[at:end] = self.words(words)
        self.known.update(zip(words, range(at, end)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability of label 1 of each text; words new to the process are scored together."""
        bags = [bag(t) for t in texts]
        distinct = set().union(*bags)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        self.learn([w for w in distinct if w not in self.known])
        logits = np.empty(len(texts))
        for i, words in enumerate(bags):
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            mass = np.minimum(np.sqrt(np.fromiter(words.values(), np.float64, len(words))), LOUDEST) * self.weight[at]
            logits[i] = self.model.bias + mass @ self.score[at] / (NEUTRAL + mass.sum())
        return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


_SCORERS: dict[str, Scorer] = {}


def _sent(docs: DataFrame, labels: DataFrame, texts: int):
    """A trained model, sent to the executors, and what gives a process its one scorer of it."""
    model = train(*sample(docs, labels, texts))
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, model.buckets, model.weights, model.bias))

    def scorer() -> Scorer:
        key, *parts = sent.value
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(Model(*parts))
        return _SCORERS[key]

    return scorer


def score_texts(docs: DataFrame, labels: DataFrame, texts: int = TEXTS_A_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Only the text is an input of a score. A null, empty or wordless text gets
    the score of the bias alone. Without labels of both classes the score is
    their share. Rows that repeat get a row each; an empty table gives none.
    Other columns are ignored.
    """
    scorer = _sent(docs, labels, texts)

    def run(batches):
        own = scorer()
        for b in slices(batches, 256):
            scores = own.scores(b.column(2).to_pylist())
            flags = pa.array((scores >= THRESHOLD).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), flags], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", 3) == 1).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, texts: int = TEXTS_A_CLASS) -> DataFrame:
    """The rows of ``docs`` scored below THRESHOLD, all columns; scored in place, so nothing is shuffled."""
    scorer = _sent(docs, labels, texts)
    at = docs.columns.index("text")

    def run(batches):
        own = scorer()
        for b in slices(batches, 256):
            yield b.filter(pa.array(own.scores(b.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
