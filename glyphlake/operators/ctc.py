"""Greedy CTC decoding: class 0 is blank, class i is label i, the last class is a space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def labels_of(dictionary: list[str]) -> list[str]:
    """The labels of classes 1, 2, ...: the dictionary and a space."""
    return [*dictionary, " "]


def argmax(scores: Column) -> Column:
    """Index of the largest element; of equal ones the first."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def emitted_probability(scores: Column, probabilities: bool = False) -> Column:
    """The largest class's softmax (largest logit taken off first), or its value if scores are probabilities."""
    if probabilities:
        return F.array_max(scores).cast("double")
    top = F.array_max(scores).cast("double")
    return 1.0 / F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top))


def steps_of(dense: DataFrame, logits: str, classes: int, probabilities: bool = False) -> DataFrame:
    """Adds ``steps``: an array of (cls, prob), one for each row of ``classes`` scores in the flat array ``logits``."""
    count = F.floor(F.size(logits) / classes).cast("int")
    row = lambda s: F.slice(F.col(logits), s * classes + 1, classes)
    step = lambda s: F.struct(argmax(row(s)).alias("cls"), emitted_probability(row(s), probabilities).alias("prob"))
    return dense.withColumn("steps", F.when(count < 1, F.expr("cast(array() as array<struct<cls:int,prob:double>>)")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), step)))


def decode(lines: DataFrame, labels: list[str], steps: str = "steps") -> DataFrame:
    """Adds text, score and emitted to rows that hold their steps in an array; nothing is shuffled.

    A step is emitted when its class is not blank and differs from the step
    before. The score is the mean probability of the emitted steps, summed in
    double and kept in single precision, 0 if there are none.
    """
    table = F.array(*map(F.lit, labels))
    number = F.transform(F.col(steps), lambda x, i: F.struct(x["cls"].alias("cls"), x["prob"].alias("prob"), i.alias("i")))
    before = lambda x: F.get(F.col(steps), x["i"] - 1)["cls"]
    out = lines.withColumn("_emitted", F.filter(number, lambda x: (x["cls"] != 0) & ((x["i"] == 0) | (x["cls"] != before(x)))))
    total = F.aggregate("_emitted", F.lit(0.0), lambda s, x: s + x["prob"].cast("double"))
    return out.select(
        *lines.columns,
        F.array_join(F.transform("_emitted", lambda x: F.element_at(table, x["cls"])), "").alias("text"),
        F.when(F.size("_emitted") > 0, total / F.size("_emitted")).otherwise(0.0).cast("float").alias("score"),
        F.size("_emitted").alias("emitted"),
    )


def spans(steps: DataFrame, labels: list[str], line: str = "line") -> DataFrame:
    """(line, span, text, score, start, end) of each emitted run, from one row for each step (line, step, cls, prob).

    A run starts where a class other than blank begins and ends before the next
    other class, a blank included; its score is its first step's. Lines without
    a run have no rows: left-join from the lines where an empty list matters.
    """
    order = Window.partitionBy(line).orderBy("step")
    broken = F.coalesce((F.col("cls") != F.lag("cls").over(order)).cast("int"), F.lit(1))
    runs = steps.withColumn("_break", broken).withColumn("_run", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = runs.filter("cls <> 0").groupBy(line, "_run", "cls").agg(F.min("step").alias("start"), (F.max("step") + 1).alias("end"), F.min_by("prob", "step").alias("score"))
    text = F.element_at(F.array(*map(F.lit, labels)), F.col("cls").cast("int"))
    return found.select(line, (F.row_number().over(Window.partitionBy(line).orderBy("start")) - 1).alias("span"), text.alias("text"), "score", "start", "end")


def captured(lines: DataFrame, found: DataFrame, line: str = "line") -> DataFrame:
    """Lines with an array of their spans; a line without a run has an empty array, not null."""
    listed = found.groupBy(line).agg(F.sort_array(F.collect_list(F.struct("span", "text", "score", "start", "end"))).alias("spans"))
    empty = F.expr("cast(array() as array<struct<span:int,text:string,score:double,start:int,end:int>>)")
    return lines.join(listed, line, "left").withColumn("spans", F.coalesce("spans", empty))


def with_spans(lines: DataFrame, labels: list[str], steps: str = "steps") -> DataFrame:
    """Adds ``spans`` to rows that hold their steps in an array: the runs of spans(), an empty array where there are none; nothing is shuffled."""
    table, n = F.array(*map(F.lit, labels)), F.size(steps)
    at = lambda i: F.get(F.col(steps), i)
    breaks = F.filter(F.sequence(F.lit(0), n), lambda i: (i == 0) | (i == n) | (at(i)["cls"] != at(i - 1)["cls"]))
    cut = lambda a, b: F.struct(at(a)["cls"].alias("cls"), at(a)["prob"].alias("prob"), a.alias("a"), b.alias("b"))
    runs = F.filter(F.zip_with(F.slice(breaks, 1, F.size(breaks) - 1), F.slice(breaks, 2, F.size(breaks)), cut), lambda r: r["cls"] != 0)
    named = F.transform(runs, lambda r, i: F.struct(i.alias("span"), F.element_at(table, r["cls"]).alias("text"), r["prob"].alias("score"), r["a"].alias("start"), r["b"].alias("end")))
    empty = F.expr("cast(array() as array<struct<span:int,text:string,score:double,start:int,end:int>>)")
    return lines.withColumn("spans", F.when(n > 0, named).otherwise(empty))


def head(features: DataFrame, vector: str, weights: list[list[float]], bias: list[float]) -> DataFrame:
    """Adds label and score of a linear head: softmax of A.W + b, the lowest index of equal ones; 2 to 64 columns."""
    if not 2 <= len(bias) <= 64:
        raise ValueError("a head has 2 to 64 columns")
    logits = F.array(*(F.lit(float(b)) + sum((F.get(vector, i).cast("double") * float(row[k]) for i, row in enumerate(weights)), F.lit(0.0)) for k, b in enumerate(bias)))
    return features.withColumn("_logits", logits).withColumn("label", argmax(F.col("_logits"))).withColumn("score", emitted_probability(F.col("_logits"))).drop("_logits")


def turned(label: Column, score: Column, threshold: float = 0.0) -> Column:
    """Degrees by which a line is turned: 180 for an odd label above the threshold."""
    return F.when((label.bitwiseAND(F.lit(1)) != 0) & (score > threshold), 180).otherwise(0)
