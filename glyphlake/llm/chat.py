r"""Chat formatting by assembling tokens.

A turn is OPEN, role, BODY, text, CLOSE. Role and text are encoded separately
and the three reserved ids are spliced in, so a text can't produce one. In the
rendered form the reserved ids read ``<turn>``, ``<text>`` and ``</turn>``;
those strings and the backslash get a backslash in front wherever a role or
text holds them, which reading back removes.

Rows are encoded where they are read, before the one shuffle that brings a
conversation together; behind it, turns are streamed in order, so a very long
conversation is never held whole. Its digest can't be computed in parts: one
conversation is read by one task.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.bpe import encoder, listed, packed_lists
from glyphlake.llm.common import slices

OPEN, BODY, CLOSE = 50257, 50258, 50259
SHOWN = {OPEN: "<turn>", BODY: "<text>", CLOSE: "</turn>"}
CONTROL = re.compile(r"\\|<turn>|<text>|</turn>")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
MARKS = re.compile(r"\\.|<turn>|<text>|</turn>", re.DOTALL)
LEARNED = "assistant"


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(rendered: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a rendered conversation."""
    fields, start = [], 0
    for m in MARKS.finditer(rendered):
        if m[0][0] != "\\":
            if m[0] != "<turn>":
                fields.append(unescape(rendered[start : m.start()]))
            start = m.end()
    return list(zip(fields[::2], fields[1::2]))


def encode_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role_ids, text_ids, learned) for each row; null roles and texts are empty."""

    def run(batches):
        enc = encoder()
        for b in slices(batches):
            roles, texts = ([x or "" for x in b.column(i).to_pylist()] for i in (2, 3))
            ids = [packed_lists([enc.pack(escape(x)) for x in part]) for part in (roles, texts)]
            learned = pa.array([r == LEARNED for r in roles])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *ids, learned], ["conv_id", "turn", "role_ids", "text_ids", "learned"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return rows.mapInArrow(run, "conv_id long, turn long, role_ids array<int>, text_ids array<int>, learned boolean")


ASSEMBLED = "conv_id long, position long, token_start long, char_start long, ids array<int>, loss array<boolean>, rendered string"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _names(ddl: str) -> list[str]:
    return [field.split()[0] for field in ddl.split(", ")]


def _assembled(batches):
    """Arrow batches of ASSEMBLED, of rows that are sorted by conversation and turn."""
    enc = encoder()
    shown = {**enc.tokens, **{i: mark.encode() for i, mark in SHOWN.items()}}.__getitem__
    now, position, tokens, chars = object(), 0, 0, 0
    for b in slices(batches, 256):
        places, packed, texts, spans = [], [], [], []
        for conv, role, text, learned in zip(b.column(0).to_pylist(), listed(b.column(2)), listed(b.column(3)), b.column(4).to_pylist()):
            if conv != now:
                now, position, tokens, chars = conv, 0, 0, 0
            places.append((conv, position, tokens, chars))
            ids = [OPEN, *role, BODY, *text, CLOSE]
            packed.append(np.array(ids, np.int32).tobytes())
            spans.append((len(role) + 2, len(text) if learned else 0))
            texts.append(b"".join(map(shown, ids)).decode())
            position, tokens, chars = position + 1, tokens + len(ids), chars + len(texts[-1])
        ids = packed_lists(packed)
        # The mask: up where a learned text begins, down where it ends, summed along all tokens of the batch.
        edges = np.zeros(len(ids.values) + 1, np.int8)
        begins, lengths = np.array(spans, np.int64).reshape(-1, 2).T
        begins = begins + ids.offsets.to_numpy()[:-1]
        np.add.at(edges, begins, 1)
        np.add.at(edges, begins + lengths, -1)
        loss = pa.ListArray.from_arrays(ids.offsets, pa.array(edges.cumsum()[:-1].astype(bool)))
        numbers = [pa.array(c, pa.int64()) for c in (list(zip(*places)) or [()] * 4)]
        yield pa.RecordBatch.from_arrays([*numbers, ids, loss, pa.array(texts, pa.string())], _names(ASSEMBLED))


def _read(batches):
    """Arrow batches of READ, of batches of ASSEMBLED: roles and texts as the rendered turns say them, learned text as the ids under the mask do."""
    enc = encoder()
    now, seen = None, None

    def close(rows):
        if seen is not None:
            rows.append((now, seen[0], seen[1].hexdigest(), seen[2], seen[3].hexdigest(), seen[4]))

    def emit(rows):
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _names(READ))

    for b in batches:
        rows: list[tuple] = []
        offsets = b.column(4).offsets.to_numpy()
        first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
        ids, offsets = b.column(4).values.to_numpy()[first:last], (offsets - first).tolist()
        # Where the mask goes up and down, for all turns of the batch at once; a learned text is one run of a turn.
        begin = b.column(5).offsets[0].as_py() if b.num_rows else 0
        flags = b.column(5).values.slice(begin, last - first).to_numpy(zero_copy_only=False).astype(np.int8)
        up, down = np.flatnonzero(np.diff(flags, prepend=0) == 1).tolist(), np.flatnonzero(np.diff(flags, append=0) == -1).tolist()
        run = 0
        for conv, rendered, end in zip(b.column(0).to_pylist(), b.column(6).to_pylist(), offsets[1:]):
            if seen is None or conv != now:
                close(rows)
                now, seen = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            ((role, text),) = parse(rendered)
            seen[0] += 1
            seen[1].update(f"{role}\n{text}\n".encode())
            while run < len(up) and up[run] < end:
                learned = unescape(enc.decode(ids[up[run] : down[run] + 1].tolist()).decode())
                seen[2] += len(learned)
                seen[3].update(learned.encode())
                run += 1
            seen[4] += len(rendered)
        if rows:
            yield emit(rows)
    rows = []
    close(rows)
    yield emit(rows)


def _in_order(conversations: DataFrame) -> DataFrame:
    return encode_turns(conversations).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role_ids", "text_ids")


def assemble(conversations: DataFrame) -> DataFrame:
    """One row for each turn, in order within its conversation and partition:

    conv_id, position, token_start, char_start, ids, loss (one flag a token) and rendered.
    token_start and char_start are the turn's offsets in the conversation. Turns
    that share a number are ordered by the ids of role and text; a null turn
    comes first.
    """
    return _in_order(conversations).mapInArrow(_assembled, ASSEMBLED)


def read_back(assembled: DataFrame) -> DataFrame:
    """What the assembled turns say, one row for each conversation; their order must be that of assemble()."""
    return assembled.mapInArrow(lambda batches: _read(slices(batches, 256)), READ)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the assembled tokens.

    read_back() of assemble(), in one pass through Python. A null conv_id is a
    conversation of its own; repeated rows are turns of their own; an empty
    table gives no rows. Other columns are ignored.
    """
    return _in_order(conversations).mapInArrow(lambda batches: _read(_assembled(batches)), READ)


PROBE = r"\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7, in which both sides say PROBE."""
    spark = conversations.sparkSession
    rows = [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    return conversations.select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


ORACLE = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
s AS (SELECT *, length('<turn><text></turn>') + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '\\\\|<turn>|<text>|</turn>')) AS shown FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = '{LEARNED}'), '')) AS loss_sha256, sum(shown)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
