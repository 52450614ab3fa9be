"""SimHash near-dedup: fingerprints, links at few differing bits, connected groups.

Candidates come from an inverted index over the fingerprint's positional
bytes. Two fingerprints that differ in at most two bits share at least six of
their eight positional bytes, so postings are kept for each choice of six
positions: single bytes would give postings of a 256th of the table, choices
of six give some that hold next to nothing but near ones, however large the
table. A posting that is long all the same is split by more positions: its
members differ in two bytes only, that is in four half bytes, of which a pair
within two bits shares two at least; a part has 256 members at most. Postings
that a pair meets in are tallied over the index, one for six shared bytes,
seven for seven; pairs that reach the guaranteed minimum are verified bit by
bit. All links are found, none but links is kept.
"""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import Fence, fence, fresh, scope, sent_if_few, slices

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
BITS, BYTES, WIDTH = 2, 8, 3
#: Choices of the six positional bytes that a pair shares at least, as the two that it may differ in.
FREE = [(i, j) for i in range(BYTES) for j in range(i)]
#: Members of a posting above which it is split by half bytes too.
LONG = 64
#: Shingles hashed at once; a longer text is tallied in blocks.
BLOCK = 1 << 16


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """64 bits; bit i is set if it is in over half the shingles' XXH64 (seed 42). No words: zero."""
    words = WORDS.findall((text or "").translate(LOWER))
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + width - 1]
        joined = map(" ".join, zip(*(part[i:] for i in range(width)))) if len(words) >= width else [" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s.encode(), 42) for s in joined), np.uint64)
        votes += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = WIDTH, beside: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row as a signed long; between them the columns ``beside``, of whole numbers."""
    names = ["doc_id", *beside]

    def run(batches):
        for b in slices(batches):
            fp = [fingerprint(t, width) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(np.array(fp, np.uint64).view(np.int64))], [*names, "fp"])

    return docs.select("text", *(F.col(c).cast("long").alias(c) for c in names)).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def _mask(positions, width: int) -> int:
    """Ones in the bits of those positions, each ``width`` bits wide."""
    return _signed(sum((1 << width) - 1 << width * p for p in positions))


def _pairs(members: Column) -> Column:
    """(a, b) for each two of a posting's sorted members."""
    return F.flatten(F.transform(members, lambda x, i: F.transform(F.slice(members, i + 2, F.size(members)), lambda y: F.struct(x.alias("a"), y.alias("b")))))


def links(nodes: DataFrame, long: int = LONG) -> DataFrame:
    """(a, b), a < b: every two fingerprints of ``nodes`` (fp, distinct) within BITS bits."""
    listed = F.sort_array(F.collect_list("fp")).alias("m")
    with scope() as keep:
        fixed = F.array(*(F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(~_mask(free, 8))).alias("v")) for c, free in enumerate(FREE)))
        # Dealt out anew: a fingerprint becomes 28 rows, so the few files that hold them are too few tasks.
        dealt = nodes.select("fp").repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
        index = dealt.select("fp", F.explode(fixed).alias("key")).select("fp", "key.c", "key.v")
        # A posting has at most 65,536 members, as many as two bytes have values; nearly all have one and are dropped.
        postings = Fence(index.groupBy("c", "v").agg(listed).filter(F.size("m") > 1)).df
        short = postings.filter(F.size("m") <= long).select("c", "m")
        # The half bytes of two free bytes, any two of which may be the shared ones.
        shared = [[_mask(two, 4) for two in combinations((2 * i, 2 * i + 1, 2 * j, 2 * j + 1), 2)] for i, j in FREE]
        choice = F.element_at(F.array(*(F.array(*map(F.lit, masks)) for masks in shared)), F.col("c") + 1)
        members = postings.filter(F.size("m") > long).select("c", "v", F.explode("m").alias("fp")).select("c", "v", "fp", F.explode(choice).alias("mask"))
        parts = members.groupBy("c", "v", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("w")).agg(listed).filter(F.size("m") > 1).select("c", "m")
        met = short.unionByName(parts).select("c", F.explode(_pairs(F.col("m"))).alias("p"))
        # A pair meets in 1, 7 or 28 postings as it shares six, seven or eight bytes; parts of one posting count once.
        tally = met.groupBy("p.a", "p.b").agg(F.bit_count(F.bit_or(F.expr("shiftleft(1L, c)"))).alias("postings"))
        near = Fence(tally.filter("postings >= 1").filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b"), small=True)
        keep(near)
    return near.df


def classes(edges: DataFrame) -> DataFrame:
    """(node, root): for each node of ``edges`` (a, b) one node of its connected class, the same for all of the class.

    The graph is contracted: every node goes to the smallest of itself and its
    neighbours, edges follow, and those within one node are dropped, until none
    are left. Small is by number, in every third round by number with random
    bits turned over. Natural order settles dense classes in a round or two; in
    a random one at least a quarter of the nodes are expected to go, whatever
    the graph, so that the number of rounds grows with the logarithm of the
    longest chain and needs no limit. Each round is written to the shared
    folder; rounds shrink, and their maps are composed from the last one back.
    """
    maps: list[DataFrame] = []
    with scope() as keep:
        pairs = edges.select("a", "b").filter("a != b")
        both = Fence(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), small=True)
        while not both.df.isEmpty():
            turned = F.lit(_signed(random.Random(len(maps)).getrandbits(64)) if len(maps) % 3 == 2 else 0)
            least = both.df.groupBy(F.col("a").alias("node")).agg(F.min(F.col("b").bitwiseXOR(turned)).alias("m"))
            to = Fence(least.select("node", F.least("m", F.col("node").bitwiseXOR(turned)).bitwiseXOR(turned).alias("root")), small=True).df
            first, second = to.toDF("a", "x"), to.toDF("b", "y")
            moved = Fence(both.df.join(first, "a").join(second, "b").filter("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), small=True)
            both.release()
            both, maps = moved, [*maps, to]
        if not maps:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
        total = maps.pop()
        while maps:
            up = total.toDF("at", "above")
            near = maps.pop()
            total = near.join(up, near["root"] == up["at"], "left").select("node", F.coalesce("above", "root").alias("root"))
            if len(maps) % 4 == 0:
                total = fence(total, small=True)
        done = Fence(total, small=True)
        keep(done)
    return done.df


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node of ``edges`` (a, b)."""
    found = classes(edges)
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(least, "root").select("node", F.col("least").alias("root"))


def simhash_groups(docs: DataFrame, width: int = WIDTH, long: int = LONG) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of ``docs``.

    component_id is the smallest doc_id reachable over links of at most two
    differing bits. A null or empty text, or one without words, has fingerprint
    zero and is linked like any other; rows that repeat share a group; a null
    doc_id never names a group unless all of it are null. An empty table gives
    no rows. Other columns are ignored.
    """
    with scope() as keep:
        prints = Fence(fingerprints(docs, width))
        nodes = fence(prints.df.groupBy("fp").agg(F.min("doc_id").alias("first")), small=True)
        roots = classes(links(nodes.select("fp"), long))
        named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        groups = named.groupBy("root").agg(F.min("first").alias("component_id"))
        known = Fence(named.join(groups, "root").select("fp", "component_id"), small=True)
        keep(prints, known)
    return prints.df.join(known.df, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, long: int = LONG) -> DataFrame:
    """One row of each group of simhash_groups(), all columns: that of the smallest doc_id, of several such rows any one.

    Rows are told apart by a number of their own, as a doc_id may repeat or be
    null. A row with a null doc_id stays only where its whole group has none.
    The rows to drop are sent to the documents where they are few.
    """
    (row,) = fresh(docs, "row_number")
    with scope() as keep:
        rows = Fence(docs.withColumn(row, F.monotonically_increasing_id()))
        narrow = rows.df.select("doc_id", "text", F.col(row).alias("row"))
        prints = fence(fingerprints(narrow, width, ("row",)))
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
        nodes = fence(prints.groupBy("fp").agg(F.min(place).alias("first")), small=True)
        roots = classes(links(nodes.select("fp"), long))
        groups = nodes.join(roots, nodes["fp"] == roots["node"], "left").groupBy(F.coalesce("root", "fp").alias("group")).agg(F.min("first").alias("first"))
        gone = Fence(prints.select("row").join(groups.select("first.row"), "row", "left_anti").withColumnRenamed("row", row), small=True)
        keep(rows, gone)
    return rows.df.join(sent_if_few(gone.df), row, "left_anti").select(*docs.columns)
