"""Benchmark decontamination by greedy string tiling.

The benchmark is held against all texts in blocks of bounded size. A block is
an index of seeds, runs of SEED tokens by their hash, with their places in the
items, kept in arrays. Texts join it by shared seeds: the tokens of an item
that shared seeds cover bound what tiles can cover, so items below the
threshold are left at once. For the others, the longest matches are marked
first, by Karp-Rabin over shrinking lengths, each token in one tile at most;
the share of the item's tokens that tiles cover decides. Tiles may stand in
any order, so a reordered passage is covered as well as a verbatim one.
Hashes only propose; tiles compare tokens.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import fence, slices

#: Tokens of the shortest tile; a text is contaminated if tiles cover this share of an item.
SEED, COVERED = 5, 0.5
#: UTF-8 bytes of the benchmark that are sent to the executors at once, and one item more; each such block is a pass over the texts.
SENT_BYTES = 16 << 20
TOKENS = re.compile(r"\w+")
BASE, MODULUS = 1_000_003, (1 << 61) - 1


def tokens(text: str | None) -> list[str]:
    return TOKENS.findall((text or "").lower())


def _windows(ids: list[int], free: list[bool], length: int):
    """(start, Karp-Rabin hash) of every window of unmarked tokens, the hash rolled along."""
    top = pow(BASE, length - 1, MODULUS)
    h = run = 0
    for i, x in enumerate(ids):
        if not free[i]:
            h = run = 0
            continue
        if run >= length:
            h = (h - (ids[i - length] + 1) * top) % MODULUS
        else:
            run += 1
        h = (h * BASE + x + 1) % MODULUS
        if run >= length:
            yield i - length + 1, h


def _matches(item, text, free_item, free_text, length: int) -> list[tuple[int, int, int]]:
    """(-n, start in text, start in item) of maximal matches of unmarked tokens, ``length`` or longer."""
    at = defaultdict(list)
    for start, h in _windows(item, free_item, length):
        at[h].append(start)
    found = []
    for start, h in _windows(text, free_text, length) if at else ():
        for p in at.get(h, ()):
            if item[p : p + length] != text[start : start + length]:
                continue
            if p and start and free_item[p - 1] and free_text[start - 1] and item[p - 1] == text[start - 1]:
                continue  # part of the match that begins one token sooner
            n = length
            while p + n < len(item) and start + n < len(text) and free_item[p + n] and free_text[start + n] and item[p + n] == text[start + n]:
                n += 1
            found.append((-n, start, p))
    return sorted(found)


def tile(item: list[int], text: list[int], least: int = SEED) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length), longest first; of equally long ones the earliest in the text.

    The search length begins at the shorter side's and is halved down to
    ``least``. Where a marked tile blocks part of another match, the same
    length is searched again: the rest of that match may still be long enough.
    """
    free_item, free_text = [True] * len(item), [True] * len(text)
    tiles = []
    length = min(len(item), len(text))
    while length >= least:
        blocked = False
        for n, start, p in _matches(item, text, free_item, free_text, length):
            if all(free_item[p : p - n]) and all(free_text[start : start - n]):
                free_item[p : p - n] = free_text[start : start - n] = [False] * -n
                tiles.append((p, start, -n))
            else:
                blocked = True
        if not blocked:
            length = max(least, length // 2) if length > least else 0
    return sorted(tiles, key=lambda t: (-t[2], t[1]))


def _seeds(tokens: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each run of ``seed`` tokens, given by their hashes."""
    n = max(0, len(tokens) - seed + 1)
    out = np.zeros(n, np.uint64)
    for k in range(seed):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += tokens[k : k + n]
    return out ^ (out >> np.uint64(29))


def _hashes(words: list[str]) -> np.ndarray:
    """Python's own hashes of the words: those of one process agree, and no others are compared."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


class Items:
    """A block of the benchmark: for each seed where it occurs. Rows are told apart by place: an item_id may repeat or be null.

    A token of the benchmark takes 8 bytes for its seed's hash, 4 for the
    seed's place and up to 8 for a table that most seeds of other texts fail.
    """

    def __init__(self, rows: list[tuple[int | None, str]], seed: int = SEED):
        self.seed = seed
        self.names, self.texts = [item_id for item_id, _ in rows], [text for _, text in rows]
        self.sizes = np.zeros(len(rows), np.int64)
        parts = []
        for row, text in enumerate(self.texts):
            words = tokens(text)
            self.sizes[row] = len(words)
            parts.append(_seeds(_hashes(words), seed))
        counts = np.array([len(p) for p in parts], np.int64)
        #: Seeds are numbered through all items; seeds of item i begin at starts[i].
        self.starts = np.r_[0, counts.cumsum()]
        seeds = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        del parts
        self.places = np.argsort(seeds, kind="stable").astype(np.uint32)
        self.hashes = seeds[self.places]
        self.shift = np.uint64(64 - min(26, max(10, int(len(seeds)).bit_length() + 3)))
        self.table = np.zeros(1 << int(64 - self.shift), bool)
        self.table[(self.hashes >> self.shift).astype(np.int64)] = True

    def shared(self, seeds: np.ndarray) -> np.ndarray:
        """Places, among ``seeds``, of those that the block has too."""
        if not len(self.hashes):
            return np.zeros(0, np.int64)
        near = np.flatnonzero(self.table[(seeds >> self.shift).astype(np.int64)])
        found = np.searchsorted(self.hashes, seeds[near])
        return near[self.hashes[np.minimum(found, len(self.hashes) - 1)] == seeds[near]]

    def candidates(self, seeds: np.ndarray, least: float) -> list[int]:
        """Items of whose tokens shared seeds cover a share of ``least`` or more; no tile covers others."""
        seeds = np.unique(seeds)
        low, high = np.searchsorted(self.hashes, seeds, "left"), np.searchsorted(self.hashes, seeds, "right")
        times = high - low
        at = np.arange(times.sum()) + np.repeat(low - np.r_[0, times.cumsum()[:-1]], times)
        places = np.sort(self.places[at]).astype(np.int64)
        owner = np.searchsorted(self.starts, places, "right") - 1
        # Each seed covers the tokens up to the next shared one of its item, its own length at most.
        covers = np.full(len(places), self.seed)
        same = owner[1:] == owner[:-1]
        covers[:-1][same] = np.minimum(self.seed, np.diff(places)[same])
        sums = np.bincount(owner, covers)
        return np.flatnonzero((sums > 0) & (sums >= least * self.sizes[: len(sums)] - 1e-9)).tolist()

    def tiled(self, item: int, words: list[str], starts: list[int]) -> tuple[float, int]:
        """Share of the item's tokens that tiles cover, and their number; ``starts``: places of shared seeds in the text."""
        want = tokens(self.texts[item])
        number: dict[str, int] = {}
        ids = [number.setdefault(t, len(number)) for t in want]
        # Only runs of seeds can hold tiles: the rest of the text is cut down to one token between runs.
        cut, end = [], -1
        for i in starts:
            begin = end if i <= end else i
            if i > end:
                cut.append(-2)
            cut += [number.get(t, -1) for t in words[begin : i + self.seed]]
            end = i + self.seed
        tiles = tile(ids, cut, self.seed)
        return sum(t[2] for t in tiles) / len(want), len(tiles)

    def matches(self, texts: list[str | None], least: float) -> list[tuple[int, int | None, float, int]]:
        """(place of the text, item_id, share covered, tiles) of each text and item that tiles cover to that share at least."""
        words = [tokens(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        seeds = _seeds(_hashes([w for part in words for w in part]), self.seed)
        hits = self.shared(seeds)
        own = np.searchsorted(ends, hits, "right")
        inside = hits + self.seed <= ends[own] if len(hits) else np.zeros(0, bool)
        hits, own = hits[inside], own[inside]
        out = []
        for text in np.unique(own).tolist():
            at = hits[own == text]
            begin = int(ends[text]) - len(words[text])
            found = []
            for item in self.candidates(seeds[at], least):
                its = self.hashes_of(item)
                starts = (at[np.isin(seeds[at], its)] - begin).tolist()
                share, tiles = self.tiled(item, words[text], starts)
                if tiles and share >= least:
                    found.append((text, self.names[item], share, tiles))
            out += sorted(found, key=lambda m: (m[1] is None, m[1] or 0, *m[2:]))
        return out

    def hashes_of(self, item: int) -> np.ndarray:
        return _seeds(_hashes(tokens(self.texts[item])), self.seed)


_ITEMS: dict[str, Items] = {}
SCHEMA = "doc_id long, item_id long, coverage double, tiles int"
#: Texts that are looked at together.
TOGETHER = 128


def _blocks(benchmark: DataFrame, sent_bytes: int, seed: int):
    """For each block of the benchmark, what gives a process its Items; the driver holds one block at a time."""
    spark = benchmark.sparkSession

    def send(rows):
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, rows))

        def items() -> Items:
            key, table = sent.value
            if key not in _ITEMS:
                _ITEMS.clear()
                _ITEMS[key] = Items(table, seed)
            return _ITEMS[key]

        return items

    rows, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").filter("text is not null").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len(r["text"].encode())
        if size > sent_bytes:
            yield send(rows)
            rows, size = [], 0
    if rows:
        yield send(rows)


def overlaps(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, seed: int = SEED, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """doc_id, item_id, coverage, tiles: one row for each text and item that tiles cover to ``covered`` at least.

    Items with fewer than ``seed`` tokens, and null or empty texts on either
    side, match nothing. Rows are compared each, whether an item_id or a whole
    row repeats; a null item_id is returned as null. An empty table gives no
    rows. Texts are read once for each block of the benchmark, which ends where
    it is larger than ``sent_bytes``; the size changes no row. Other columns
    are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")

    def against(items):
        def run(batches):
            block = items()
            for b in slices(batches, TOGETHER):
                ids = b.column(0).to_pylist()
                found = [(ids[text], *m) for text, *m in block.matches(b.column(1).to_pylist(), covered)]
                columns = list(zip(*found)) or [()] * 4
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "coverage", "tiles"])

        return rows.mapInArrow(run, SCHEMA)

    found = None
    for items in _blocks(benchmark, sent_bytes, seed):
        found = against(items) if found is None else found.unionByName(against(items))
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """overlaps() and contaminated, true: the rows name the texts to drop and why."""
    return overlaps(docs, benchmark, **options).withColumn("contaminated", F.lit(True))


def keep_clean(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, seed: int = SEED, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text no item's tiles cover, all columns; filtered in place, block by block of the benchmark."""
    at = docs.columns.index("text")

    def against(left, items):
        def run(batches):
            block = items()
            for b in slices(batches, TOGETHER):
                keep = np.ones(b.num_rows, bool)
                keep[[text for text, *_ in block.matches(b.column(at).to_pylist(), covered)]] = False
                yield b.filter(pa.array(keep))

        return left.mapInArrow(run, docs.schema)

    left, before = docs, None
    for items in _blocks(benchmark, sent_bytes, seed):
        if before is not None:  # one block in memory at a time
            left = fence(left)
        left = before = against(left, items)
    return left
