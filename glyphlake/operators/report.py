"""Reports over runs: baselines, ratios, rollups, comparisons, Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions import text as fmt
from glyphlake.operators.evaluate import STAGE_ORDER
from glyphlake.operators.scan import running


def with_baseline(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Adds baseline and ratio: the mean of the group's baseline run, and the run's mean over it.

    The baseline is the case ``tiny-4w`` or ``tiny``, else the first case by name.
    """
    order = Window.partitionBy(*keys).orderBy(F.when(F.col("case_id").isin("tiny-4w", "tiny"), 0).otherwise(1), "case_id", "label")
    out = runs.withColumn("baseline", F.first("mean").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return out.withColumn("ratio", F.when(F.col("baseline") > 0, F.col("mean") / F.col("baseline")))


def smoke(runs: DataFrame) -> DataFrame:
    """Smoke runs with their ratio to a peer of the same platform (without case), replica and CPU; null without peers."""
    keyed = runs.withColumn("_rid", F.lower("rid"))
    keys = ["_rid", "replica", "cpu_name"]
    peers = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = with_baseline(keyed, keys).withColumn("peers", peers)
    return out.withColumn("ratio", F.when(F.col("peers") > 1, F.col("ratio"))).drop("_rid")


def case_rollup(runs: DataFrame) -> DataFrame:
    """For each platform and case of more than one finite ratio: median, least and largest ratio, and the median memory growth."""
    keyed = runs.withColumn("_rid", F.lower(F.coalesce("rid", F.lit("unknown"))))
    rated = with_baseline(keyed, ["_rid", "replica"]).withColumn("case_key", F.when(F.col("case_id") == "", F.col("label")).otherwise(F.col("case_id")))
    finite = F.when(F.col("ratio").isNotNull() & ~F.isnan("ratio") & (F.abs("ratio") < float("inf")), F.col("ratio"))
    rolled = rated.groupBy(F.col("_rid").alias("rid"), "case_key").agg(
        F.count(finite).alias("replicas"),
        F.median(finite).alias("ratio_median"),
        F.min(finite).alias("ratio_min"),
        F.max(finite).alias("ratio_max"),
        F.median(F.col("ws_last") - F.col("ws_loaded")).alias("ws_delta_median"),
    )
    return rolled.filter("replicas > 1")


def compare(stages: DataFrame, runs: list[str], keys: str = "key", run: str = "run", value: str = "value") -> DataFrame:
    """A matrix of mean values, a row for each key and a column for each run, ``-`` where a run lacks the key."""
    wide = stages.groupBy(keys).pivot(run, runs).agg(F.avg(value))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STAGE_ORDER)), F.col(keys)), F.lit(0)), F.lit(len(STAGE_ORDER) + 1))
    cells = [F.coalesce(F.format_string("%.2f", F.col(r)), F.lit("-")).alias(r) for r in runs]
    shown = wide.select(keys, place.alias("position"), *(F.when(F.col(r).isNull(), "-").otherwise(c).alias(r) for r, c in zip(runs, cells)))
    return shown.orderBy("position", keys)


def key_union(stages: DataFrame, key: str = "key") -> DataFrame:
    """(key, position): the keys of all runs, those of STAGE_ORDER in that order and the others by name; there are as many as stages."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STAGE_ORDER)), F.col(key)), F.lit(0)), F.lit(len(STAGE_ORDER) + 1))
    return stages.select(key).distinct().withColumn("position", F.row_number().over(Window.orderBy(place, key)))


#: What report tables are ordered by.
RUN_ORDER, SMOKE_ORDER, FILE_ORDER = ["replica", "case_id", "label"], ["rid", "case_id", "label"], ["folded", "sort_key"]


def run_order(runs: DataFrame) -> DataFrame:
    return runs.orderBy(*RUN_ORDER)


def smoke_order(runs: DataFrame) -> DataFrame:
    return runs.orderBy(*SMOKE_ORDER)


def sort_key_order(runs: DataFrame) -> DataFrame:
    """By sort_key without case, which FILE_ORDER calls folded."""
    return runs.withColumn("folded", F.lower("sort_key")).orderBy(*FILE_ORDER).drop("folded")


def with_places(runs: DataFrame, orders: dict[str, list[str]]) -> DataFrame:
    """Adds, for each name, the row's place in that order of all rows, from 1."""
    for name, order in orders.items():
        runs = running(runs, [], order, number=name)
    return runs


#: Column heads of the report's tables.
HEADS = ["RID", "case", "engine", "model", "n", "effective ISA", "median ms", "P95 ms", "vs replica baseline", "cls", "exact_lines", "CER", "WS peak", "Δ WS", "CPU"]


def report_cells(runs: DataFrame) -> DataFrame:
    """The cells of a report row as text, in HEADS' order; runs have a ratio."""
    number = lambda c: F.format_string("%.1f", F.col(c))
    delta: Column = F.col("ws_last") - F.col("ws_loaded")
    cells = [
        fmt.cell(F.col("rid")),
        fmt.cell(F.when(F.col("case_id") == "", F.col("label")).otherwise(F.col("case_id"))),
        fmt.cell(F.col("engine")),
        fmt.cell(F.col("model")),
        F.col("n").cast("string"),
        fmt.cell(F.col("effective_isa")),
        number("median"),
        number("p95"),
        F.when(F.col("ratio").isNull(), fmt.NONE).otherwise(F.format_string("%.2f", F.col("ratio"))),
        fmt.fraction(F.col("cls_correct"), F.col("cls_total")),
        fmt.fraction(F.col("exact_lines"), F.col("total_lines")),
        fmt.percent(F.col("cer")),
        fmt.megabytes(F.col("ws_peak")),
        fmt.megabytes(delta),
        fmt.cell(F.col("cpu_name")),
    ]
    return runs.select(*(c.alias(f"c{i}") for i, c in enumerate(cells)))


def markdown(title: str, runs: DataFrame, most: int = 10_000) -> str:
    """A Markdown table, built on the driver; a report of more than ``most`` runs is refused, not cut."""
    rows = report_cells(smoke_order(runs)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} runs")
    lines = [f"## {title}", "", "| " + " | ".join(HEADS) + " |", "| " + " | ".join("---" for _ in HEADS) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(r) + " |" for r in rows), ""])
