"""Byte-level BPE encoding and decoding with exact merges in linear time.

Bytes are read as Latin-1 characters, so that one Aho-Corasick automaton finds
every token in a piece of text. Encoding goes left to right by longest matches
and steps back to shorter ones where two neighbours could not stand side by
side in the merged result; whether two tokens can is decided once for each
pair, by merging their bytes, and remembered. A sequence in which all
neighbours can is the one that the merges give.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import slices

#: Pieces whose ids, and pairs whose fit, a process remembers; then it starts anew.
REMEMBERED, PAIRS = 400_000, 500_000

class Seen(dict):
    """Strings seen so far, each with its ids as packed 32-bit numbers; a new one is encoded when asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, text: str) -> bytes:
        packed = self.encode(text)
        if len(text) < 64:
            self[text] = packed
        return packed


class Encoder:
    """Encodes as the rank file's merges do, each match of ``pattern`` separately, without special tokens."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        for token in self.ranks:
            self.automaton.add_word(token.decode("latin-1"), len(token))
        self.automaton.make_automaton()
        self.pieces = Seen(lambda piece: array("i", self.encode_bytes(piece.encode())).tobytes())
        self.pairs: dict[int, bool] = {}  # by both ranks in one number, which takes less room than a pair of tokens
        self.prefixes: dict[bytes, bytes] = {}

    def merge(self, data: bytes) -> list[bytes]:
        """Plain merging, lowest rank first; used on two tokens' bytes only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, left: bytes, right: bytes) -> bool:
        key = self.ranks[left] << 32 | self.ranks[right]
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(left + right) == [left, right]
        return known

    def shorter(self, token: bytes) -> bytes:
        """The longest token that is a proper prefix; empty for a single byte."""
        found = self.prefixes.get(token)
        if found is None:
            found = token[:-1]
            while found and found not in self.ranks:
                found = found[:-1]
            self.prefixes[token] = found
        return found

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        if data in self.ranks:
            return (self.ranks[data],)
        longest = [1] * len(data)
        for end, length in self.automaton.iter(data.decode("latin-1")):
            start = end - length + 1
            if length > longest[start]:
                longest[start] = length
        dead = bytearray(len(data) + 1)  # positions from which no valid sequence goes on
        chosen: list[bytes] = []
        at = 0
        token = data[: longest[0]]
        while True:
            end = at + len(token)
            if token and not dead[end] and (not chosen or self.fits(chosen[-1], token)):
                chosen.append(token)
                at = end
                if at == len(data):
                    return tuple(self.ranks[t] for t in chosen)
                token = data[at : at + longest[at]]
            elif token and (less := self.shorter(token)):
                token = less
            else:
                dead[at] = 1
                token = chosen.pop()
                at -= len(token)
                token = self.shorter(token)

    def pack(self, text: str) -> bytes:
        """The text's ids as packed 32-bit numbers."""
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.pack(text), np.int32).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def packed_lists(packed: list[bytes]) -> pa.ListArray:
    """An Arrow list of ids for each packed text, without a Python number for each id."""
    offsets = np.zeros(len(packed) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in packed], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def listed(ids: pa.ListArray) -> list[list[int]]:
    """The lists of an Arrow array; a null is an empty list."""
    offsets, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    return [values[a:b].tolist() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


@lru_cache(4)
def encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """One Encoder for each process; the rank file must be at the same place on every machine."""
    import public_tokenizers

    return Encoder(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs``; a null or empty text has no ids. Other columns are ignored."""

    def run(batches):
        enc = encoder(path, pattern)
        for b in slices(batches, 64):
            ids = packed_lists([enc.pack(t or "") for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded binary) for each row of (doc_id, ids); null ids decode to nothing."""

    def run(batches):
        enc = encoder(path, pattern)
        for b in slices(batches, 64):
            out = pa.array([enc.decode(ids) for ids in listed(b.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded binary) for each row of ``docs``: decode() of encode(), in one pass through Python."""

    def run(batches):
        enc = encoder(path, pattern)
        for b in slices(batches, 64):
            ids = packed_lists([enc.pack(t or "") for t in b.column(1).to_pylist()])
            decoded = pa.array([enc.decode(x) for x in listed(ids)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, decoded], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs``, ids encoded and then decoded."""
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
