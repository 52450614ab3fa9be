"""Scoring and summarising recognition runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.functions.geometry import iou
from glyphlake.functions.text import utf16_units
from glyphlake.operators.scan import null_safe, running

#: The order of stages in reports; others follow by name.
STAGE_ORDER = ["det_preprocess", "det_graph", "det_postprocess", "det_unclip", "crop", "cls_preprocess", "cls_graph", "cls_postprocess", "rec_preprocess", "rec_graph", "rec_postprocess"]


def _sorted(value: Column) -> Column:
    return F.array_sort(F.collect_list(value))


#: Indexes, from 0, of order statistics among n sorted values.
RULES = {
    "p95_rounded": lambda n: F.least(n - 1, F.floor(0.95 * (n - 1) + 0.5)),
    "p95_ceiling": lambda n: F.greatest(F.lit(0), F.ceil(0.95 * n) - 1),
    "upper_median": lambda n: F.floor(n / 2),
    "lower_median": lambda n: F.floor((n - 1) / 2),
}


def ranked(rows: DataFrame, keys: list[str], value: str, picks: dict[str, str], few: bool = False) -> DataFrame:
    """(keys, picks): exact order statistics of groups of any size; ``picks`` names a column and a rule of RULES.

    Equal values are counted before anything is shuffled, and the counts are
    summed in order of value over ranges of it. ``few`` says that a group has
    few distinct values at any size, as channels of a colour have: then a
    window over its counts does.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    if few:
        upto = counts.withColumn("_upto", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        upto = running(counts, keys, ["_v"], sums={"_upto": "_c"})
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("_n"))
    placed = _beside(upto, sizes, keys)
    at = {name: RULES[rule](F.col("_n")) for name, rule in picks.items()}
    return placed.groupBy(*keys).agg(*(F.max(F.when((F.col("_upto") > k) & (F.col("_upto") - F.col("_c") <= k), F.col("_v"))).alias(name) for name, k in at.items()))


def _beside(left: DataFrame, right: DataFrame, keys: list[str], kind: str = "left") -> DataFrame:
    """Left join on keys, null keys included."""
    there = right.withColumnsRenamed({k: f"_at_{k}" for k in keys})
    return left.join(there, null_safe(left, there, [(k, f"_at_{k}") for k in keys]), kind).drop(*(f"_at_{k}" for k in keys))


def stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, p95, min, max, sum of ``value`` for each key; median is the middle, or the mean of the middle two."""
    sums = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"))
    order = ranked(rows, keys, value, {"_lo": "lower_median", "_hi": "upper_median", "p95": "p95_rounded"})
    both = _beside(sums, order, keys)
    return both.select(*keys, "n", "mean", ((F.col("_lo") + F.col("_hi")) / 2).alias("median"), F.coalesce("p95", F.lit(0.0)).alias("p95"), "min", "max", "sum")


def upper_median(value: Column) -> Column:
    """sorted[n / 2] of a group of bounded size; ranked() takes any."""
    return F.element_at(_sorted(value), (F.floor(F.count(value) / 2) + 1).cast("int"))


def warmup(rows: DataFrame, keys: list[str], order: list[str], count: int = 1) -> DataFrame:
    """Adds ``warmup``: the first min(count, n - 1) rows of each run; ``order`` tells the rows of a run apart.

    Only the first rows of each run are gathered, and the last of them is held against all.
    """
    place = Window.partitionBy(*keys).orderBy(*order)
    first = rows.select(*keys, *order).withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= count)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    last = _beside(first, sizes, keys).filter("_n < _size").groupBy(*keys).agg(F.max(F.struct(*order)).alias("_last"))
    return _beside(rows, last, keys).select(*rows.columns, F.coalesce(F.struct(*order) <= F.col("_last"), F.lit(False)).alias("warmup"))


def build_summary(rows: DataFrame, keys: list[str], meta: DataFrame | None = None) -> DataFrame:
    """A line for each run of rows (file, seq, warmup, total_ms, lines); warm-up rows don't count in timing.

    Of equally slow rows the first (least seq) is the slowest. Rows may have
    maps stage_ms, operator_ms and conv_class_ms: their means by key are maps
    of the same names with _mean, null where no row has any. ``meta`` (keys,
    ws_loaded, ws_last) gives working_set_delta, null where either is.
    """
    timed = F.when(~F.col("warmup"), F.col("total_ms"))
    mean = F.coalesce(F.avg(timed), F.lit(0.0))
    measured = F.count(timed)
    lines = F.coalesce(F.sum(F.when(~F.col("warmup"), F.col("lines"))), F.lit(0))
    slowest = F.max_by(F.struct("file", "total_ms"), F.when(~F.col("warmup"), F.struct("total_ms", -F.col("seq"))))
    out = rows.groupBy(*keys).agg(
        measured.alias("n"),
        F.count(F.when(F.col("warmup"), 1)).alias("warmup"),
        mean.alias("mean"),
        F.coalesce(F.min(timed), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(timed), F.lit(0.0)).alias("max"),
        F.coalesce(F.sum(timed), F.lit(0.0)).alias("sum"),
        F.when(mean > 0, 1000.0 / mean).otherwise(0.0).alias("img_per_s"),
        F.when(measured > 0, lines / measured).otherwise(0.0).alias("lines_mean"),
        lines.alias("lines_total"),
        F.avg(F.when(F.col("warmup"), F.col("total_ms"))).alias("warmup_ms"),
        slowest["file"].alias("slowest_file"),
        slowest["total_ms"].alias("slowest_ms"),
    )
    kept = rows.filter("not warmup")
    order = ranked(kept, keys, "total_ms", {"_lo": "lower_median", "_hi": "upper_median", "p95": "p95_rounded"})
    out = _beside(out, order, keys).withColumns({"median": F.coalesce((F.col("_lo") + F.col("_hi")) / 2, F.lit(0.0)), "p95": F.coalesce("p95", F.lit(0.0))}).drop("_lo", "_hi")
    for column, means in (("stage_ms", key_means), ("operator_ms", metric_means), ("conv_class_ms", metric_means)):
        if column in rows.columns:
            # A run has as many keys as there are stages or operators.
            listed = means(kept, keys, column).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "key", "mean"))).alias("_l"))
            shown = F.map_from_entries(F.transform("_l", lambda x: F.struct(x["key"], x["mean"])))
            out = _beside(out, listed.select(*keys, shown.alias(f"{column}_mean")), keys)
    if meta is not None:
        out = _beside(out, meta.select(*keys, (F.col("ws_last") - F.col("ws_loaded")).alias("working_set_delta")), keys)
    return out


def key_means(rows: DataFrame, keys: list[str], metrics: str) -> DataFrame:
    """(keys, key, mean, position): the mean of each map key over the rows that have it, in STAGE_ORDER and then by name."""
    flat = rows.select(*keys, F.explode(metrics).alias("key", "value"))
    means = flat.groupBy(*keys, "key").agg(F.avg("value").alias("mean"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, STAGE_ORDER)), F.col("key")), F.lit(0)), F.lit(len(STAGE_ORDER) + 1))
    return means.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(place, "key")))


def metric_means(rows: DataFrame, keys: list[str], metrics: str) -> DataFrame:
    """(keys, key, mean, position): as key_means(), the largest mean first, ties by name."""
    means = rows.select(*keys, F.explode(metrics).alias("key", "value")).groupBy(*keys, "key").agg(F.avg("value").alias("mean"))
    return means.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("mean").desc(), "key")))


def stage_counters(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Total ms and calls of each stage, from rows with stage_ms and stage_calls maps."""
    flat = rows.select(*keys, "stage_calls", F.explode("stage_ms").alias("stage", "ms"))
    return flat.groupBy(*keys, "stage").agg(F.sum("ms").alias("ms"), F.sum(F.coalesce(F.try_element_at("stage_calls", F.col("stage")), F.lit(0))).alias("calls"))


def result_document(meta: DataFrame, summary: DataFrame, rows: DataFrame, run: str = "run", most: int = 10_000) -> DataFrame:
    """(run, part, meta, summary, rows): documents of each run, its rows by seq; a part has the rows of ``most`` numbers of seq."""
    pack = lambda df: F.struct(*(c for c in df.columns if c != run))
    part = F.floor(F.col("seq") / most).alias("part")
    by_seq = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)
    listed = rows.groupBy(run, part).agg(F.array_sort(F.collect_list(F.struct("seq", pack(rows).alias("row"))), by_seq).alias("_r"))
    listed = listed.select(run, "part", F.transform("_r", lambda x: x["row"]).alias("rows"))
    both = meta.select(run, pack(meta).alias("meta")).join(summary.select(run, pack(summary).alias("summary")), run)
    return listed.join(both, run).select(run, "part", "meta", "summary", "rows")


def metric_value(raw: Column) -> Column:
    """A JSON value that is a number or an object with ``ms``."""
    return F.coalesce(F.get_json_object(raw, "$.ms").try_cast("double"), raw.try_cast("double"))


def counter_deltas(snapshots: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Differences of cumulative (ms, calls) between rows in order; rows without new calls are dropped."""
    seen = running(snapshots, keys, [order], previous={"_ms": "ms", "_calls": "calls"})
    back = lambda c: F.col(c) - F.coalesce(F.col(f"_{c}"), F.lit(0))
    return seen.withColumns({"delta_ms": back("ms"), "delta_calls": back("calls")}).drop("_ms", "_calls").filter("delta_calls > 0")


def running_peak(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds ``peak``: the largest value of the run so far."""
    return running(rows, keys, [order], peaks={"peak": value})


def steady_tail(rows: DataFrame, keys: list[str], order: str, value: str, last: int = 50) -> DataFrame:
    """Upper median of the last ``last`` rows of each run."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("_n", n).filter(F.col("_n") <= last).groupBy(*keys).agg(upper_median(F.col(value)).alias("steady"))


def line_errors(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth lines (file, line, text, ...) with exact, chars and errors, in UTF-16 units.

    A line is exact if an equal predicted line of its file is left for it, in
    line order; then errors is 0, else the least edit distance to any predicted
    line of the file, at most chars. Files are told apart without case; a file
    that was not predicted is left out, one predicted without lines may have a
    row with a null text. Both sides are brought together by file once; a file
    is a page, whose lines are as many as a detector finds.
    """
    t = truth.select(F.lower("file").alias("_f"), F.struct("line", F.coalesce("text", F.lit("")).alias("_text"), F.struct(*truth.columns).alias("_row")).alias("_t"), F.lit(None).cast("struct<text:string>").alias("_p"))
    p = predicted.select(F.lower("file").alias("_f"), F.lit(None).cast(t.schema["_t"].dataType).alias("_t"), F.struct(F.col("text").alias("text")).alias("_p"))
    pages = t.unionByName(p).groupBy("_f").agg(F.array_sort(F.collect_list("_t")).alias("_t"), F.collect_list("_p").alias("_p")).filter((F.size("_t") > 0) & (F.size("_p") > 0))
    said = F.filter(F.transform("_p", lambda x: x["text"]), lambda x: x.isNotNull())
    pages = pages.select("_f", "_t", said.alias("_said"), F.transform(F.array_distinct(said), utf16_units).alias("_units"))

    def judged(x: Column, i: Column) -> Column:
        equal = F.size(F.filter("_said", lambda s: s == x["_text"]))
        before = F.size(F.filter(F.slice("_t", 1, i), lambda y: y["_text"] == x["_text"]))
        return F.struct(x["_row"].alias("_row"), (equal > before).alias("exact"), utf16_units(x["_text"]).alias("_u"))

    lines = pages.select("_units", F.explode(F.transform("_t", judged)).alias("_l")).select("_units", "_l.*")
    chars = F.length("_u")
    least = F.array_min(F.transform("_units", lambda s: F.levenshtein(F.col("_u"), s)))
    errors = F.when(F.col("exact"), 0).otherwise(F.least(chars, F.coalesce(least, chars)))
    return lines.select("_row.*", "exact", chars.alias("chars"), errors.alias("errors"))


def exact_matches(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """Truth lines with ``exact``, as line_errors() has it."""
    return line_errors(truth, predicted).select(*truth.columns, "exact")


def nearest_texts(rows: DataFrame, asked: Column | None = None, blocks: int = 32) -> DataFrame:
    """``best``: the least edit distance, in UTF-16 units, of the ``text`` of each row that is asked for (all by default) to that of any other row.

    Equal texts are compared once, and each text that is asked for meets the
    others block by block, a task each: the work is in the pairs, of which
    there are as many as rows asked for times rows. Null texts are compared
    with nothing: they, and a row that has no other, get null.
    """
    wanted = rows if asked is None else rows.filter(asked)
    texts = rows.filter("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    single = texts.filter("n = 1").join(wanted.select("text").distinct(), "text", "left_semi")
    queries = single.select(F.col("text").alias("_text"), utf16_units(F.col("text")).alias("_u"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")).repartition(blocks, "_block")
    others = texts.select(F.col("text").alias("_other"), utf16_units(F.col("text")).alias("_v"), F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int").alias("_block"))
    least = queries.join(others, "_block").filter("_text != _other").groupBy("_text").agg(F.min(F.levenshtein("_u", "_v")).alias("_least"))
    many = texts.filter("n > 1").select(F.col("text").alias("_text"), F.lit(0).alias("_least"))
    found = least.unionByName(many)
    return wanted.join(found, wanted["text"] == found["_text"], "left").select(*rows.columns, F.col("_least").alias("best"))


def accuracy(errors: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """exact_lines, total_lines, exact_img, images, errors, total_chars, cer, char_acc over line_errors()."""
    keys = keys or []
    pages = errors.groupBy(*keys, "file").agg(F.sum(F.col("exact").cast("int")).alias("hit"), F.count(F.lit(1)).alias("n"), F.sum("errors").alias("e"), F.sum("chars").alias("c"))
    cer = F.when(F.sum("c") > 0, F.sum("e") / F.sum("c")).otherwise(0.0)
    return pages.groupBy(*keys).agg(
        F.sum("hit").alias("exact_lines"),
        F.sum("n").alias("total_lines"),
        F.count(F.when(F.col("hit") == F.col("n"), 1)).alias("exact_img"),
        F.count(F.lit(1)).alias("images"),
        F.sum("e").alias("errors"),
        F.sum("c").alias("total_chars"),
        cer.alias("cer"),
        (1 - cer).alias("char_acc"),
    )


def measured_accuracy(errors: DataFrame, rows: DataFrame) -> DataFrame:
    """accuracy() over files whose rows aren't warm-up, rotations not scored: cls is always 0 of 0."""
    kept = rows.filter("not warmup").select(F.lower("file").alias("_f")).distinct()
    left = errors.join(kept, F.lower(errors["file"]) == kept["_f"], "left_semi")
    return accuracy(left).withColumns({"cls_correct": F.lit(0), "cls_total": F.lit(0)})


def match_modes(truth: DataFrame, predicted: DataFrame, key: str = "image") -> DataFrame:
    """(image, mode): none where either side is empty, boxes where both have any, else text.

    A truth box counts if it has an area, a predicted one if it is there.
    """
    t = truth.groupBy(key).agg(F.max(((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))).cast("int")).alias("_t"))
    p = predicted.groupBy(key).agg(F.max(F.col("x0").isNotNull().cast("int")).alias("_p"))
    mode = F.when(F.col("_t").isNull() | F.col("_p").isNull(), "none").when((F.col("_t") == 1) & (F.col("_p") == 1), "boxes").otherwise("text")
    return t.join(p, key, "full").select(key, mode.alias("mode"))


def iou_pairs(truth: DataFrame, predicted: DataFrame, least: float = 0.3, key: str = "image") -> DataFrame:
    """(image, gi, pi, iou) of boxes (x0, y0, x1, y1) of one image that overlap to ``least`` at least."""
    t = truth.select(key, F.col("line").alias("gi"), *(F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")))
    p = predicted.select(key, F.col("line").alias("pi"), *(F.col(c).alias(f"p_{c}") for c in ("x0", "y0", "x1", "y1")))
    touch = (F.col("t_x1") > F.col("p_x0")) & (F.col("p_x1") > F.col("t_x0")) & (F.col("t_y1") > F.col("p_y0")) & (F.col("p_y1") > F.col("t_y0"))
    overlap = iou([F.col(f"t_{c}") for c in ("x0", "y0", "x1", "y1")], [F.col(f"p_{c}") for c in ("x0", "y0", "x1", "y1")])
    return t.join(p, key).filter(touch).withColumn("iou", overlap).filter(F.col("iou") >= least).select(key, "gi", "pi", "iou")


def greedy_assignment(pairs: DataFrame, key: str = "image") -> DataFrame:
    """Pairs taken by overlap, best first, while both sides are free; ties by gi, then pi.

    An image's pairs arrive together and in that order, and are streamed: only
    the sides taken so far are held.
    """

    def run(batches):
        now, taken_g, taken_p = None, set(), set()
        for pdf in batches:
            keep = []
            for image, g, p in zip(pdf[key].tolist(), pdf["gi"].tolist(), pdf["pi"].tolist()):
                if image != now:
                    now, taken_g, taken_p = image, set(), set()
                free = g not in taken_g and p not in taken_p
                keep.append(free)
                if free:
                    taken_g.add(g)
                    taken_p.add(p)
            yield pdf[keep]

    ordered = pairs.repartition(key).sortWithinPartitions(key, F.col("iou").desc(), "gi", "pi")
    return ordered.mapInPandas(run, pairs.schema)


def rotation_score(assigned: DataFrame, truth: DataFrame, predicted: DataFrame, key: str = "image") -> DataFrame:
    """cls_correct and cls_total over assigned pairs; truth has cls_degrees, predicted rotation. Unmatched lines don't count."""
    t = truth.select(key, F.col("line").alias("gi"), "cls_degrees")
    p = predicted.select(key, F.col("line").alias("pi"), "rotation")
    both = assigned.join(t, [key, "gi"]).join(p, [key, "pi"])
    return both.agg(F.coalesce(F.sum((F.col("cls_degrees") == F.col("rotation")).cast("int")), F.lit(0)).alias("cls_correct"), F.count(F.lit(1)).alias("cls_total"))


def rotation_score_by_text(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """The same where boxes are lacking: k-th truth line of a text against the k-th predicted one; both sides meet once, by file and text."""
    t = truth.select(F.lower("file").alias("_f"), "text", "line", F.lit(True).alias("_truth"), F.col("cls_degrees").alias("_d"))
    p = predicted.select(F.lower("file").alias("_f"), "text", "line", F.lit(False).alias("_truth"), F.col("rotation").alias("_d"))
    number = Window.partitionBy("_f", "text").orderBy("_truth", "line")
    both = t.unionByName(p).filter("text is not null")
    placed = both.withColumn("_n", F.row_number().over(number)).withColumn("_first", F.min(F.when(F.col("_truth"), F.col("_n"))).over(Window.partitionBy("_f", "text")))
    placed = placed.withColumn("_k", F.when(F.col("_truth"), F.col("_n") - F.col("_first") + 1).otherwise(F.col("_n")))
    side = lambda truth: F.max(F.when(F.col("_truth") == truth, F.col("_d")))
    pairs = placed.groupBy("_f", "text", "_k").agg(side(True).alias("_t"), side(False).alias("_p")).filter("_t is not null and _p is not null")
    return pairs.agg(F.coalesce(F.sum((F.col("_t") == F.col("_p")).cast("int")), F.lit(0)).alias("cls_correct"), F.count(F.lit(1)).alias("cls_total"))


def width_batches(lines: DataFrame, most: int, page: str = "page", line: str = "line_no", width: str = "target_width") -> DataFrame:
    """Adds ``batch`` and ``slot``: lines of one page and exact width, in line order, cut at ``most``."""
    n = F.row_number().over(Window.partitionBy(page, width).orderBy(line)) - 1
    return lines.withColumn("batch", F.floor(n / most).cast("long")).withColumn("slot", (n % most).cast("long"))


def prefix_offsets(rows: DataFrame, keys: list[str], order: str, size: str) -> DataFrame:
    """Adds ``offset``: the sum of the sizes before each row of its group."""
    over = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum(size).over(over), F.lit(0)))


def zip_lines(rows: DataFrame, arrays: list[str]) -> DataFrame:
    """A row for each position of parallel arrays, in place of the arrays; shorter ones are filled with null."""
    rest = [c for c in rows.columns if c not in arrays]
    return rows.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("line", "_z")).select(*rest, "line", *(F.col(f"_z.{a}").alias(a) for a in arrays))


def longest_first(lines: DataFrame, page: str = "page", line: str = "line_no") -> DataFrame:
    """Adds ``turn``: lines by width over height, widest first, ties by line.

    Quotients of whole numbers are compared exactly: by their whole part and
    62 binary places, in which any two that differ do (sides are ints).
    """
    h = F.greatest(F.lit(1), F.col("height")).cast("long")
    keys, rest = [], F.col("width").cast("long")
    for _ in range(3):
        keys.append(F.call_function("div", rest, h))
        rest = F.pmod(rest, h) * (1 << 31)
    return lines.withColumn("turn", F.row_number().over(Window.partitionBy(page).orderBy(*(k.desc() for k in keys), line)))


def background_color(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """The mean colour of the fullest 16-level bucket; the runner-up where the first is dark, under 55 % and the second bright."""
    r, g, b = (F.col(c) for c in "rgb")
    bucket = F.shiftright(r, 4) * 256 + F.shiftright(g, 4) * 16 + F.shiftright(b, 4)
    sums = pixels.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b"), F.min("seq").alias("first"))
    over = Window.partitionBy(*keys)
    top = sums.withColumn("rank", F.row_number().over(over.orderBy(F.col("n").desc(), "first"))).withColumn("all", F.sum("n").over(over)).filter("rank <= 2")
    light = 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")
    top = top.withColumn("light", light).groupBy(*keys).agg(*(F.max(F.when(F.col("rank") == k, F.col(c))).alias(f"{c}{k}") for k in (1, 2) for c in ("r", "g", "b", "n", "light")), F.max("all").alias("all"))
    second = F.coalesce((F.col("n1") < 0.55 * F.col("all")) & (F.col("light1") < 80) & (F.col("light2") > 140), F.lit(False))
    return top.select(*keys, *(F.when(second, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(c) for c in "rgb"))


def ink_color(pixels: DataFrame, backgrounds: DataFrame, keys: list[str]) -> DataFrame:
    """Upper medians of the channels of those pixels at least 16 away from the background, and as far as the upper median of such."""
    back = backgrounds.select(*keys, *(F.col(c).alias(f"_{c}") for c in "rgb"))
    away = F.sqrt(sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in "rgb"), F.lit(0.0)))
    far = pixels.join(back, keys).withColumn("_d", away).filter("_d >= 16")
    middle = ranked(far, keys, "_d", {"_m": "upper_median"})
    kept = _beside(far, middle, keys).filter("_d >= _m")
    out = None
    for c in "rgb":  # a channel has 256 values at most
        one = ranked(kept, keys, c, {c: "upper_median"}, few=True)
        out = one if out is None else _beside(out, one, keys)
    return out
