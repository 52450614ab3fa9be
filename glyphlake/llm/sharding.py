"""Minimax contiguous partition of atomic groups into shards.

Groups (equal texts) are ordered by the SHA-256 of their text. The smallest
shard capacity for which a greedy left-to-right filling needs no more shards
than there are is found by binary search. The order is cut at that capacity:
each shard takes an even share of what is left, but never more than the
capacity and never so little that the rest would not fit, so that one large
group doesn't leave shards empty. The driver sees sums of key ranges, and
single groups only near possible cuts, so what it holds grows with the square
root of the number of groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import Fence, fence, scope

#: Single groups fetched to the driver at once, at most; larger ranges are first divided further.
DETAIL = 200_000


def greedy(prefix: list[int], start: int, capacity: int, shards: int) -> list[int] | None:
    """Item indexes at which shards end when each takes all that fits; None if the items need more shards."""
    ends, at = [], start
    for _ in range(shards):
        at = bisect_right(prefix, (prefix[at - 1] if at else 0) + capacity)
        ends.append(at)
        if at == len(prefix):
            return ends + [at] * (shards - len(ends))
    return None


def smallest_capacity(sizes: list[int], shards: int, low: int = 0) -> int:
    """Binary search for the least capacity, low at least, at which greedy() succeeds."""
    prefix = list(accumulate(sizes))
    high = max(low, prefix[-1] if prefix else 0)
    low = max(low, -(-high // shards)) if prefix and high == prefix[-1] else low
    while low < high:
        mid = (low + high) // 2
        if greedy(prefix, 0, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def even_cuts(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """Item indexes at which shards end, none above ``capacity``, each as near an even share of what is left as that allows."""
    prefix, ends, at = list(accumulate(sizes)), [], 0
    for left in range(shards, 0, -1):
        done = prefix[at - 1] if at else 0
        most = bisect_right(prefix, done + capacity)
        # The least end from which the rest still fits: fitting is monotonous in the end, and holds at the most.
        low, high = at, most
        while low < high:
            mid = (low + high) // 2
            if mid == len(prefix) or (left > 1 and greedy(prefix, mid, capacity, left - 1) is not None):
                high = mid
            else:
                low = mid + 1
        even = done + (prefix[-1] - done) / left if prefix else 0
        after = bisect_left(prefix, even) + 1  # the first end that reaches the share; the one before may be nearer
        if after - 1 > at and even - prefix[after - 2] <= prefix[min(after, len(prefix)) - 1] - even:
            after -= 1
        at = max(low, min(most, after))
        ends.append(at)
    return ends


def _doubtful(items: list[tuple], shards: int, low: int, high: int) -> list[tuple]:
    """The ranges of several groups in which a cut may fall for some capacity from low to high."""
    prefix = [0, *accumulate(x[1] for x in items)]
    least = most = 0
    found: set[int] = set()
    for _ in range(shards - 1):
        # The earliest cut comes no sooner than the end of the last range that fits whole; the latest may reach into the next.
        least = max(least, bisect_right(prefix, prefix[least] + low) - 1)
        most = min(len(items), bisect_right(prefix, prefix[most] + high))
        found.update(range(least, most))
    return [items[i] for i in sorted(found) if items[i][2] > 1]


def cuts(groups: DataFrame, shards: int, total: int, largest: int, n: int, detail: int = DETAIL) -> list[bytes]:
    """First keys of shards 1, 2, ... over ``groups`` (key binary, bytes), in key order; fewer if shards stay empty.

    Ranges of keys are opened wherever the greedy filling may cut, so that the
    capacity is that of single groups; cuts fall between groups or ranges.
    """
    bits = 4
    while bits < 16 and 4**bits < 8 * n:
        bits += 1

    def ranges(df: DataFrame, digits: int) -> list[tuple]:
        """(first key, bytes, number of groups, lead) of each range of keys that share so many bytes."""
        got = df.groupBy(F.substring("key", 1, digits).alias("lead")).agg(
            F.min("key").alias("first"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("groups")
        )
        return [(bytes(r["first"]), int(r["bytes"]), int(r["groups"]), bytes(r["lead"])) for r in got.collect()]

    items = sorted(ranges(groups, -(-bits // 8)))
    floor = max(largest, -(-total // shards))
    while open_ := _doubtful(items, shards, floor, smallest_capacity([x[1] for x in items], shards, floor)):
        inside = F.lit(False)
        for width in {len(x[3]) for x in open_}:
            inside = inside | F.substring("key", 1, width).isin([bytearray(x[3]) for x in open_ if len(x[3]) == width])
        if sum(x[2] for x in open_) <= detail:
            got = groups.filter(inside).select("key", "bytes").collect()
            fine = [(bytes(r["key"]), int(r["bytes"]), 1, bytes(r["key"])) for r in got]
        else:
            fine = ranges(groups.filter(inside), 1 + max(len(x[3]) for x in open_))
        items = sorted({*items} - {*open_} | {*fine})
    sizes = [x[1] for x in items]
    ends = even_cuts(sizes, shards, smallest_capacity(sizes, shards, floor))
    return [items[e][0] for e in ends[:-1] if e < len(items)]


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    A row's size is the UTF-8 bytes of its text plus 1; a null text has none
    and keeps size 1. Equal texts stay together, so a shard is no larger than
    the largest group or what an even share and one group come to. Slots
    follow the SHA-256 of the text, then doc_id, nulls first. Rows that repeat
    are rows of their own. An empty table gives no rows; with fewer groups
    than shards some shards stay empty. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    with scope() as keep:
        rows = docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("key"),
        )
        # Sorted once; a hot text's rows are told apart by doc_id, so that no range holds them all.
        placed = fence(rows).repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id")
        number = F.monotonically_increasing_id()
        sorted_rows = Fence(placed.withColumns({"part": F.shiftright(number, 33).cast("int"), "at": number.bitwiseAND(F.lit((1 << 33) - 1))}))
        groups = fence(sorted_rows.df.groupBy("key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
        total, largest, n = (int(x or 0) for x in groups.agg(F.sum("bytes"), F.max("bytes"), F.count(F.lit(1))).first())
        first = cuts(groups, shards, total, largest, n) if n and shards > 1 else []
        number = sum((F.when(F.col("key") >= F.lit(bytearray(key)), 1).otherwise(0) for key in first), F.lit(0))
        numbered = sorted_rows.df.withColumn("shard", number.cast("int"))
        # A range's rows of one shard follow those of the ranges before it: a sum for each range and shard, of which there are few.
        sums = numbered.groupBy("part", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least")).collect()
        before: dict[int, int] = {}
        shift = []
        for part, shard_, n, least in sorted(map(tuple, sums)):
            shift.append((part, shard_, before.get(shard_, 0) - least))
            before[shard_] = before.get(shard_, 0) + n
        keep(sorted_rows)
    spark = docs.sparkSession
    offsets = spark.createDataFrame(shift, "of int, own int, shift long")
    found = numbered.join(F.broadcast(offsets), (F.col("part") == F.col("of")) & (F.col("shard") == F.col("own")))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
