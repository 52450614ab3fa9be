"""Exact dedup over content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own content says so. A chunk's identifier is its
64-bit hash, verified by its SHA-256: should different chunks share a hash,
their rank tells them apart. Texts are compared as ordered identifier lists.
Each text is read, cut and hashed once; what travels after that is one short
row for each distinct chunk of a task, and for each text a list of longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import Fence, fence, fresh, scope, sent_if_few

#: At least 512 characters, then up to the first white space before a word of that shape; 16384 at most.
#: The shape is rare enough that after an insertion cuts soon fall on the same places again.
CUT = r"(?s).{512,16384}?\s(?=[aeiou][^aeiou\s][aeiou])|.{1,16384}"


def chunks(text: Column) -> Column:
    """The text's chunks in order; their concatenation is the text. An empty text is one empty chunk."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(CUT), F.lit(0)))


def recipes(docs: DataFrame, hashed=F.xxhash64) -> Fence:
    """(row_uid, doc_id, text_sha256, recipe) for each row, where recipe is a list of verified chunk identifiers.

    A chunk's identifier is (h, k): its 64-bit hash and, should different
    chunks share the hash, the chunk's rank among them by SHA-256. Nearly
    always no two chunks do; then the list of hashes is the recipe.
    """
    with scope() as keep:
        text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        parts = F.transform(chunks(F.col("text")), lambda c: F.struct(hashed(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("d")))
        pieces = Fence(text.select(F.monotonically_increasing_id().alias("row_uid"), "doc_id", F.sha2("text", 256).alias("text_sha256"), parts.alias("parts")))
        known = pieces.df.select(F.explode("parts").alias("p")).groupBy("p.h", "p.d").agg(F.count(F.lit(1)).alias("n"))
        shared = fence(known.groupBy("h").agg(F.count(F.lit(1)).alias("different")).filter("different > 1").select("h"), small=True)
        plain = pieces.df.select("row_uid", "doc_id", "text_sha256", F.transform("parts", lambda p: F.struct(p["h"].alias("h"), F.lit(0).alias("k"))).alias("recipe"))
        if shared.isEmpty():
            done = pieces, plain
        else:
            clash = known.join(shared, "h").select("h", "d", (F.rank().over(Window.partitionBy("h").orderBy("d")) - 1).alias("k"))
            listed = pieces.df.select("row_uid", F.posexplode("parts").alias("pos", "p")).select("row_uid", "pos", "p.h", "p.d")
            ranked = listed.join(clash, ["h", "d"], "left").select("row_uid", F.struct("pos", "h", F.coalesce("k", F.lit(0)).alias("k")).alias("x"))
            lists = ranked.groupBy("row_uid").agg(F.sort_array(F.collect_list("x")).alias("all"))
            lists = lists.select("row_uid", F.transform("all", lambda x: F.struct(x["h"].alias("h"), x["k"].alias("k"))).alias("recipe"))
            whole = Fence(plain.drop("recipe").join(lists, "row_uid"))
            done = whole, whole.df
        keep(done[0])
    done[0].df = done[1]
    return done[0]


def exact_dedup(docs: DataFrame, hashed=F.xxhash64) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts
    the row with the largest doc_id stays (a null doc_id is the smallest; of
    rows that repeat that doc_id, one stays). An empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    with scope() as keep:
        rows = recipes(docs, hashed)
        tops = rows.df.groupBy("recipe").agg(F.max(F.struct("doc_id", "row_uid")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        groups = Fence(tops.filter("group_size > 1"), small=True)
        keep(rows, groups)
    # With groups read anew, a hot recipe's rows are split by AQE's skew join; single texts match nothing and stay as they are.
    joined = rows.df.join(groups.df, "recipe", "left")
    return joined.select(
        "doc_id",
        F.when(F.col("top").isNull(), F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("top").isNull() | (F.col("row_uid") == F.col("top.row_uid"))).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that exact_dedup() keeps, all columns.

    Texts to drop are known by doc_id and SHA-256; they are sent to the
    documents where they are few. Rows that repeat both are the only ones that
    can't be told apart so; they go through dropDuplicates, and only they.
    """
    sha, its_id, its_sha, stays, copies = fresh(docs, "text_key", "dropped_id", "dropped_key", "stays", "copies")
    with scope() as keep:
        seen = exact_dedup(docs.select("doc_id", "text")).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias(stays), F.count(F.lit(1)).alias(copies))
        odd = Fence(seen.filter(~F.col(stays) | (F.col(copies) > 1)).select(F.col("doc_id").alias(its_id), F.col("text_sha256").alias(its_sha), stays), small=True)
        keep(odd)
    marked = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    on = marked["doc_id"].eqNullSafe(odd.df[its_id]) & (marked[sha] == odd.df[its_sha])
    left = marked.join(sent_if_few(odd.df.filter(~F.col(stays))), on, "left_anti")
    twice = odd.df.filter(F.col(stays))
    if not twice.isEmpty():
        same = left["doc_id"].eqNullSafe(twice[its_id]) & (left[sha] == twice[its_sha])
        again = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", sha])
        left = left.join(twice, same, "left_anti").unionByName(again)
    return left.drop(sha)


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
