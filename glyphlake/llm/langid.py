"""Language identification: unigram pieces, summed over all segmentations.

The pieces are a fixed public vocabulary. Each language has a probability for
every piece, fitted by expectation-maximisation over the words of a bounded
sample of labelled texts; a text's probability in a language is the product
over its words of the sum over all segmentations of the word, by the forward
algorithm.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from math import log

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import crc_mod, slices

#: Texts of each language that the fit looks at, at most; rounds of expectation-maximisation.
TEXTS_A_LANGUAGE, ROUNDS = 150, 2
#: Probability of a character that no piece covers, and what is added to each piece's count.
OTHER, ADDED = 1e-9, 0.02
#: Words whose scores a process remembers; then it starts anew.
REMEMBERED = 400_000
#: Words of up to so many letters are scored together; their probabilities don't underflow.
TOGETHER = 24
LETTERS = re.compile(r"[^\W\d_]+")
START = "\u2581"
TINY, SCALE = 1e-200, 1e200


@lru_cache(2)
def vocabulary(path: str | None = None) -> tuple[ahocorasick.Automaton, int]:
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    found = ahocorasick.Automaton()
    pieces = sorted({p.lower() for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) for p in [model.id_to_piece(i)]})
    for i, p in enumerate(pieces):
        found.add_word(p, (len(p), i))
    found.make_automaton()
    return found, len(pieces)


def lattice(word: str, automaton) -> list[list[tuple[int, int]]]:
    """For each end position, (start, piece) of the pieces that end there; piece -1 is any one character."""
    marked = START + word
    ends: list[list[tuple[int, int]]] = [[] for _ in range(len(marked) + 1)]
    for end, (length, piece) in automaton.iter(marked):
        ends[end + 1].append((end + 1 - length, piece))
    for end in range(1, len(ends)):
        if not any(start == end - 1 for start, _ in ends[end]):
            ends[end].append((end - 1, -1))
    return ends


def forward(ends: list[list[tuple[int, int]]], p: list[float]) -> tuple[list[float], list[int]]:
    """Sums over segmentations up to each position, each as a value and a number of SCALEs taken out of it."""
    a, scales = [1.0] + [0.0] * (len(ends) - 1), [0] * len(ends)
    for end in range(1, len(ends)):
        base = scales[end - 1]
        total = 0.0
        for start, piece in ends[end]:
            q = a[start] * p[piece]
            total += q if scales[start] == base else q * SCALE ** (base - scales[start])
        if total < TINY:
            total, base = total * SCALE, base + 1
        a[end], scales[end] = total, base
    return a, scales


def log_probability(ends, p: list[float]) -> float:
    a, scales = forward(ends, p)
    return log(max(a[-1], 1e-300)) - scales[-1] * log(SCALE)


def expected(ends: list[list[tuple[int, int]]], p: list[float], times: int, counts: dict[int, float]) -> None:
    """Adds to ``counts`` how often each piece is expected in ``times`` such words, over all segmentations."""
    a, scales = forward(ends, p)
    if not a[-1]:
        return
    # b[i]: the sum over segmentations from i on, over the whole sum, in units of SCALE to the power of scales[i].
    b = [0.0] * len(ends)
    b[-1] = times / a[-1]
    for end in range(len(ends) - 1, 0, -1):
        for start, piece in ends[end]:
            q = p[piece] * b[end]
            if scales[start] != scales[end]:
                q *= SCALE ** (scales[end] - scales[start])
            counts[piece] += a[start] * q
            b[start] += q


def fit(words: dict[str, dict[str, int]], path: str | None = None, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages, and their piece probabilities with OTHER in the last place, from each language's word counts."""
    automaton, n = vocabulary(path)
    languages = sorted(words)
    table = np.empty((len(languages), n + 1))
    for row, language in enumerate(languages):
        p = [1.0 / n] * n + [OTHER]
        lattices = [(lattice(w, automaton), c) for w, c in words[language].items()]
        for _ in range(rounds):
            counts: defaultdict[int, float] = defaultdict(float)
            for ends, c in lattices:
                expected(ends, p, c, counts)
            total = sum(v for k, v in counts.items() if k >= 0) + ADDED * n
            p = [(counts.get(i, 0.0) + ADDED) / total for i in range(n)] + [OTHER]
        table[row] = p
    return languages, table


def sample_words(docs: DataFrame, texts: int = TEXTS_A_LANGUAGE) -> dict[str, dict[str, int]]:
    """Word counts of at most ``texts`` texts of each language, those with the smallest hashes of doc_id.

    Learns from rows with a lang and a doc_id whose crc32 mod 4 is not 2.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", 4) != 2)).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    # About three times as many as needed of each language, so that ranking them is a small task.
    limits = F.create_map(*(F.lit(x) for k, v in sizes.items() for x in (k, min(1 << 20, 2048 + (3 * texts << 20) // v))))
    near = labelled.withColumn("place", place).filter(F.col("place") < limits[F.col("lang")])
    ranked = near.select("lang", "doc_id", "place", "text").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id")))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word")
    got = ranked.filter(F.col("rank") <= texts).select("lang", word).groupBy("lang", "word").count().toArrow()
    out: dict[str, dict[str, int]] = {k: {} for k in sizes}
    for lang, w, c in zip(*(got.column(k).to_pylist() for k in ("lang", "word", "count"))):
        out[lang][w] = c
    return out


class Scorer:
    def __init__(self, languages: list[str], table: np.ndarray, path: str | None):
        self.automaton = vocabulary(path)[0]
        self.languages, self.table, self.rows = languages, table, table.tolist()
        self.known: dict[str, int] = {}
        self.scores = np.empty((1024, len(languages)))

    def learn(self, words: list[str]) -> None:
        """Scores new words: short ones together, one position after the other, long ones each on its own."""
        while len(self.known) + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty_like(self.scores)])
        short = [w for w in words if len(w) <= TOGETHER]
        for part in (short, [w for w in words if len(w) > TOGETHER]):
            at = len(self.known)
            if part:
                self.scores[at : at + len(part)] = self.together(part) if part is short else [[log_probability(lattice(w, self.automaton), p) for p in self.rows] for w in part]
            self.known.update(zip(part, range(at, at + len(part))))

    def together(self, words: list[str]) -> np.ndarray:
        owner, start, end, piece = [], [], [], []
        for i, word in enumerate(words):
            for last, (length, number) in self.automaton.iter(START + word):
                owner.append(i)
                start.append(last + 1 - length)
                end.append(last + 1)
                piece.append(number)
        owner, start, end, piece = (np.array(x, np.int64) for x in (owner, start, end, piece))
        lengths = np.array([len(w) + 1 for w in words])
        # A character that is no piece of its own can stand alone at OTHER.
        alone = np.arange(1, lengths.max() + 1)[None, :] <= lengths[:, None]
        single = end - start == 1
        alone[owner[single], end[single] - 1] = False
        more, at = np.nonzero(alone)
        owner, start, end = np.r_[owner, more], np.r_[start, at], np.r_[end, at + 1]
        piece = np.r_[piece, np.full(len(more), -1)]
        order = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[order], np.arange(1, lengths.max() + 2))
        a = np.zeros((lengths.max() + 1, len(words), len(self.languages)))
        a[0] = 1
        for position in range(1, lengths.max() + 1):
            rows = order[cuts[position - 1] : cuts[position]]
            sums = a[start[rows], owner[rows]] * self.table.T[piece[rows]]
            for k in range(len(self.languages)):
                a[position, :, k] = np.bincount(owner[rows], sums[:, k], len(words))
        return np.log(np.maximum(a[lengths, np.arange(len(words))], 1e-300))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share of the probability) of each text."""
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        out = []
        found = [LETTERS.findall((t or "").lower()) for t in texts]
        # The pattern also takes numerals that are no digits; without a letter they make no text.
        found = [words if any(c.isalpha() for w in words for c in w) else [] for words in found]
        distinct = set().union(*found)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        if new := [w for w in distinct if w not in self.known]:
            self.learn(new)
        for words in found:
            sums = np.zeros(len(self.languages))
            for at in range(0, len(words), 1 << 16):
                sums = sums + self.scores[list(map(self.known.__getitem__, words[at : at + (1 << 16)]))].sum(0)
            if not words:
                out.append(("und", 0.0))
                continue
            shares = np.exp(sums - sums.max())
            best = int(shares.argmax())
            out.append((self.languages[best], float(shares[best] / shares.sum())))
        return out


_SCORERS: dict[str, Scorer] = {}


def identify(docs: DataFrame, path: str | None = None, texts: int = TEXTS_A_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``.

    lang, source and doc_id are no inputs of a prediction. A text that is null
    or has no letter is ``und`` with score 0; so is every text if no row is
    labelled. Equal probabilities give the language first in order. Rows that
    repeat get a row each; an empty table gives none. Other columns are ignored.
    """
    languages, table = fit(words, path) if (words := sample_words(docs, texts)) else ([], np.empty((0, 1)))
    import uuid

    model = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, languages, table.astype(np.float64)))

    def run(batches):
        key, names, probabilities = model.value
        scorer = _SCORERS.get(key)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[key] = Scorer(names, probabilities, path)
        for b in slices(batches, 256):
            found = scorer.predict(b.column(2).to_pylist())
            lang, score = (list(x) for x in zip(*found)) if found else ([], [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod("doc_id", 4) == 2).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
