"""What the text operators share: reading tables, cutting lineage, deterministic splits."""

from __future__ import annotations

import contextlib
import contextvars

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.sources import store
from glyphlake.sources.store import delete, shared_dir

__all__ = ["Fence", "crc_mod", "delete", "fence", "fresh", "load", "scope", "scratch", "sent_if_few", "shared_dir", "slices"]

_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scope", default=None)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, kind: str = "fence") -> str:
    """A new folder name below shared_dir(), deleted when its scope() or else the driver's Python ends."""
    path = store.scratch(spark, kind)
    if (inside := _SCOPE.get()) is not None:
        inside.append(path)
    return path


@contextlib.contextmanager
def scope():
    """Folders named inside are deleted at its end, but for those handed to the function it gives, which go to the scope around it."""
    inside: list[str] = []
    kept: list[str] = []
    outer = _SCOPE.get()
    token = _SCOPE.set(inside)
    try:
        yield lambda *fences: kept.extend(f if isinstance(f, str) else f.path for f in fences)
    finally:
        _SCOPE.reset(token)
        for path in inside:
            if path in kept and outer is not None:
                outer.append(path)
            elif path not in kept and (spark := store.holder(path)):
                delete(spark, path)


class Fence:
    """A written and reread table: lineage ends here, and a lost executor costs a reread, not a recomputation.

    ``small`` tables, those with a few numbers for a document or less, are
    written by a sixteenth of the shuffle partitions' tasks: fewer, larger files.
    """

    def __init__(self, df: DataFrame, small: bool = False):
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession)
        if small:
            df = df.coalesce(max(2, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 16))
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def release(self) -> None:
        delete(self.spark, self.path)


def fence(df: DataFrame, small: bool = False) -> DataFrame:
    return Fence(df, small).df


#: Rows of a number and a digest that are sent to every executor, at most (some 70 MB); beyond them a join shuffles. What is sent is counted first.
SENT_ROWS = 500_000


def sent_if_few(table: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """The table, to be broadcast where a count shows that it has at most ``rows`` rows."""
    return F.broadcast(table) if table.count() <= rows else table


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, mod n; a null counts as the empty string."""
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % n


def slices(batches, rows: int = 512):
    """Arrow batches cut to a few rows, so that what Python holds at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
