"""The queries of the library's own operators, by name, and the SQL that should give the same rows.

Every query names its columns and their kinds once (i whole, d decimal to six
places, s text, b true or false); both engines' results are brought to them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.functions import geometry as geo
from glyphlake.functions import sizing
from glyphlake.functions import text as fmt
from glyphlake.operators import charboxes, ctc, dbpost, evaluate, imageops, models, raster, report
from glyphlake.plans import inputs
from glyphlake.sources import bench, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK = {"i": lambda c: c.cast("long"), "d": lambda c: F.round(c.cast("double"), 6) + 0.0, "s": lambda c: c.cast("string"), "b": lambda c: c.cast("boolean")}
_DUCK = {"i": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 6) + 0.0", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}


def query(columns: str, ctes: str = "", sql: str = ""):
    """Registers a query under the function's name; without SQL it has none to be held against."""
    kinds = [c.split(":") for c in columns.split()]

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(_SPARK[k](F.col(n)).alias(n) for n, k in kinds))

        QUERIES[f.__name__] = run
        if sql:
            shown = ", ".join(f'{_DUCK[k].format(chr(34) + n + chr(34))} AS "{n}"' for n, k in kinds)
            ORACLES[f.__name__] = f"WITH {ctes.strip()}{',' if ctes.strip() else ''} result AS ({sql.strip()}) SELECT {shown} FROM result"
        return f

    return add




def _quad() -> list:
    return [F.col(p) for p in geo.POINTS]


# --- decoding

_EMITTED = """
em AS (SELECT *, lag(cls) OVER (PARTITION BY line ORDER BY step) AS before FROM scored),
kept AS (SELECT * FROM em WHERE cls <> 0 AND (before IS NULL OR before <> cls)),
lines AS (SELECT DISTINCT line FROM scored)
"""


@query("line:i text:s score:d emitted:i", f"{inputs.LOGITS.strip()}, {_EMITTED.strip()}", """
SELECT l.line, coalesce(string_agg(['a', 'b', ' '][k.cls], '' ORDER BY k.step), '') AS text, coalesce(avg(k.prob), 0)::FLOAT AS score, count(k.cls) AS emitted
FROM lines l LEFT JOIN kept k ON l.line = k.line GROUP BY l.line""")
def ctc_decode(spark, sf_dir):
    dense = ctc.steps_of(inputs.logits(spark, sf_dir), "logits", inputs.CLASSES)
    return ctc.decode(dense.select("line", "steps"), ctc.labels_of(inputs.DICTIONARY))


@query("line:i step:i cls:i prob:d", inputs.LOGITS, "SELECT line, step, cls, prob FROM scored")
def ctc_argmax_softmax(spark, sf_dir):
    dense = ctc.steps_of(inputs.logits(spark, sf_dir), "logits", inputs.CLASSES)
    return dense.select("line", F.posexplode("steps").alias("step", "s")).select("line", "step", "s.cls", "s.prob")


@query("line:i span:i text:s score:d start:i end:i", f"{inputs.EVENT_STEPS.strip()}, {inputs.RUNS.strip()}", """
SELECT line, row_number() OVER (PARTITION BY line ORDER BY start) - 1 AS span, ['c', 'p', 's', ' '][cls] AS text, score, start, "end" FROM found""")
def ctc_spans(spark, sf_dir):
    return ctc.spans(inputs.steps(spark, sf_dir), ctc.labels_of(inputs.EVENT_DICTIONARY))


@query("line:i spans:i best:d steps:i", f"{inputs.EVENT_STEPS.strip()}, {inputs.RUNS.strip()}", """
SELECT l.line, count(f.line) AS spans, coalesce(max(f.score), 0) AS best, coalesce(sum(f."end" - f.start), 0) AS steps FROM (SELECT DISTINCT line FROM scored) l LEFT JOIN found f ON l.line = f.line GROUP BY l.line""")
def ctc_captured_lines(spark, sf_dir):
    steps = inputs.steps(spark, sf_dir)
    lines = ctc.captured(steps.select("line").distinct(), ctc.spans(steps, ctc.labels_of(inputs.EVENT_DICTIONARY)))
    best = F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0))
    length = F.aggregate("spans", F.lit(0), lambda s, x: s + x["end"] - x["start"])
    return lines.select("line", F.size("spans").alias("spans"), best.alias("best"), length.alias("steps"))


_WEIGHTS = [[((i * 7) % 11 - 5) / 8, ((i * 5) % 13 - 6) / 8] for i in range(64)]
_HEAD = """
h AS (SELECT vec_id AS line, 0.1::DOUBLE + list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * (((i * 7) % 11 - 5) / 8.0::DOUBLE))) AS a,
             -0.1::DOUBLE + list_sum(list_transform(range(0, 64), lambda i: embedding[i + 1]::DOUBLE * (((i * 5) % 13 - 6) / 8.0::DOUBLE))) AS b FROM embeddings)"""


@query("line:i label:i score:d turned:i", _HEAD, """
SELECT line, CASE WHEN b > a THEN 1 ELSE 0 END AS label, 1 / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS score,
       CASE WHEN b > a AND 1 / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) > 0.55 THEN 180 ELSE 0 END AS turned FROM h""")
def linear_head(spark, sf_dir):
    out = ctc.head(inputs.logits(spark, sf_dir), "logits", _WEIGHTS, [0.1, -0.1])
    return out.withColumn("turned", ctc.turned(F.col("label"), F.col("score"), 0.55))


@query("line:i label:s n:i", inputs.EVENT_STEPS, """
SELECT line, ['', 'c', 'p', 's', ' '][cls + 1] AS label, count(*) AS n FROM scored GROUP BY ALL""")
def dictionary_lookup(spark, sf_dir):
    from glyphlake.sources.bench import dictionary_table

    table = dictionary_table(spark, inputs.EVENT_DICTIONARY)  # a dictionary is a few thousand labels: small by its kind
    return inputs.steps(spark, sf_dir).join(F.broadcast(table), "cls").groupBy("line", "label").agg(F.count(F.lit(1)).alias("n"))


# --- characters

_CHARS = """
nb AS (SELECT *, row_number() OVER w - 1 AS span, lag("end") OVER w AS pe, lead(start) OVER w AS ns, max("end") OVER (PARTITION BY line) + 2 AS ts, line % 2 = 1 AS flip, line % 3 = 0 AS tall
       FROM found WINDOW w AS (PARTITION BY line ORDER BY start)),
lr AS (SELECT *, coalesce((pe + start) / 2.0, start) * 1.25 / ts AS a, coalesce(("end" + ns) / 2.0, "end") * 1.25 / ts AS b FROM nb),
tt AS (SELECT *, greatest(0, least(1, CASE WHEN flip THEN 1 - b ELSE a END)) AS t0, greatest(0, least(1, CASE WHEN flip THEN 1 - a ELSE b END)) AS t1 FROM lr)
"""


@query("line:i span:i bx1:d by1:d bx2:d by2:d bx3:d by3:d bx4:d by4:d", f"{inputs.EVENT_STEPS.strip()}, {inputs.RUNS.strip()}, {_CHARS.strip()}", """
SELECT line, span,
  CASE WHEN tall THEN 10 ELSE 10 + 90 * t0 END AS bx1, CASE WHEN tall THEN 20 + 70 * (1 - t0) ELSE 20 END AS by1,
  CASE WHEN tall THEN 10 ELSE 10 + 90 * t1 END AS bx2, CASE WHEN tall THEN 20 + 70 * (1 - t1) ELSE 20 END AS by2,
  CASE WHEN tall THEN 30 ELSE 10 + 90 * t1 END AS bx3, CASE WHEN tall THEN 20 + 70 * (1 - t1) ELSE 40 END AS by3,
  CASE WHEN tall THEN 30 ELSE 10 + 90 * t0 END AS bx4, CASE WHEN tall THEN 20 + 70 * (1 - t0) ELSE 40 END AS by4 FROM tt""")
def character_boxes(spark, sf_dir):
    found = ctc.spans(inputs.steps(spark, sf_dir), ctc.labels_of(inputs.EVENT_DICTIONARY))
    tall = F.col("line") % 3 == 0
    right, low = F.when(tall, 30.0).otherwise(100.0), F.when(tall, 90.0).otherwise(40.0)
    corners = dict(zip(geo.POINTS, (F.lit(10.0), F.lit(20.0), right, F.lit(20.0), right, low, F.lit(10.0), low)))
    steps = (F.max("end").over(Window.partitionBy("line")) + 2).alias("time_steps")
    lines = found.select("*", steps, F.lit(320).alias("content_width"), F.lit(400).alias("tensor_width"), F.when(F.col("line") % 2 == 1, 180).otherwise(0).alias("rotation"), *(v.alias(k) for k, v in corners.items()))
    return charboxes.character_boxes(lines)


# --- sizes

_LINES = "li AS (SELECT l_orderkey AS page, l_linenumber AS line_no, (l_partkey % 700 + 1)::INT AS w, (l_suppkey % 90 + 1)::INT AS h FROM lineitem)"


def _lines(spark, sf_dir):
    li = inputs.load(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_no"), (F.col("l_partkey") % 700 + 1).cast("int").alias("w"), (F.col("l_suppkey") % 90 + 1).cast("int").alias("h"))


@query("w:i h:i natural:i target:i rec:i cls_window:i cls:i", _LINES, """
SELECT w, h, ceil(w * 48.0::DOUBLE / h) AS natural, greatest(32, ((ceil(w * 48.0::DOUBLE / h)::BIGINT + 31) // 32) * 32) AS target,
       least(greatest(32, ((ceil(w * 48.0::DOUBLE / h)::BIGINT + 31) // 32) * 32), ceil(w * 48.0::DOUBLE / h)) AS rec,
       least(w, 4 * h) AS cls_window, least(160, ceil(least(w, 4 * h) * 80.0::DOUBLE / h)) AS cls FROM (SELECT DISTINCT w, h FROM li)""")
def line_sizes(spark, sf_dir):
    w, h = F.col("w"), F.col("h")
    target = sizing.recogniser_target(w, h)
    return _lines(spark, sf_dir).select("w", "h").distinct().select(
        "w", "h", sizing.natural_width(w, h).alias("natural"), target.alias("target"), sizing.recogniser_width(w, h, target).alias("rec"), sizing.classifier_window(w, h).alias("cls_window"), sizing.classifier_width(w, h).alias("cls")
    )


_PAGES = "pg AS (SELECT DISTINCT (o_orderkey % 1900 + 1)::INT AS w, (o_custkey % 1300 + 1)::INT AS h FROM orders)"


def _pages(spark, sf_dir):
    o = inputs.load(spark, sf_dir, "orders")
    return o.select((F.col("o_orderkey") % 1900 + 1).cast("int").alias("w"), (F.col("o_custkey") % 1300 + 1).cast("int").alias("h")).distinct()


@query("w:i h:i det_w:i det_h:i", f"{_PAGES}, pd AS (SELECT *, CASE WHEN w + h < 64 THEN greatest(w, 32) ELSE w END AS pw, CASE WHEN w + h < 64 THEN greatest(h, 32) ELSE h END AS ph FROM pg)", """
SELECT w, h, greatest(32, floor(floor(pw * least(1.0::DOUBLE, 960.0::DOUBLE / greatest(pw, ph))) / 32 + 0.5) * 32) AS det_w,
       greatest(32, floor(floor(ph * least(1.0::DOUBLE, 960.0::DOUBLE / greatest(pw, ph))) / 32 + 0.5) * 32) AS det_h FROM pd""")
def detector_sizes(spark, sf_dir):
    w, h = sizing.detector_size(F.col("w"), F.col("h"))
    return _pages(spark, sf_dir).select("w", "h", w.alias("det_w"), h.alias("det_h"))


@query("w:i h:i scaled_width:i scaled_height:i left:i top:i turned_w:i turned_h:i", f"{_PAGES}, sc AS (SELECT *, round_even(w * (256.0::DOUBLE / least(w, h)), 0)::BIGINT AS sw, round_even(h * (256.0::DOUBLE / least(w, h)), 0)::BIGINT AS sh FROM pg)", """
SELECT w, h, sw AS scaled_width, sh AS scaled_height, floor((sw - 224) / 2) AS "left", floor((sh - 224) / 2) AS top, CASE WHEN (w % 4) IN (1, 3) THEN h ELSE w END AS turned_w, CASE WHEN (w % 4) IN (1, 3) THEN w ELSE h END AS turned_h FROM sc""")
def orientation_sizes(spark, sf_dir):
    size = sizing.orientation_size(F.col("w"), F.col("h"))
    tw, th = sizing.rotated_size(F.col("w"), F.col("h"), F.col("w") % 4 * 90)
    return _pages(spark, sf_dir).select("w", "h", *(v.alias(k) for k, v in size.items()), tw.alias("turned_w"), th.alias("turned_h"))


@query("part:i lines:i crops:i threads:i budget:i", "w AS (SELECT p_partkey AS part, (p_size % 20)::INT AS asked, (p_partkey % 32 + 1)::INT AS cpus FROM part), l AS (SELECT *, least(least(CASE WHEN asked > 0 THEN asked ELSE least(cpus, 4) END, cpus), 16) AS lines FROM w)", """
SELECT part, lines, greatest(lines, least(cpus, 16)) AS crops, greatest(1, least(8, cpus // lines)) AS threads, greatest(2, least(12, 2 * lines // (part % 5 + 1))) AS budget FROM l""")
def worker_budgets(spark, sf_dir):
    p = inputs.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_size") % 20).alias("asked"), (F.col("p_partkey") % 32 + 1).cast("int").alias("cpus"))
    lines = sizing.line_workers(F.col("asked"), F.col("cpus"))
    p = p.withColumn("lines", lines)
    return p.select("part", "lines", sizing.crop_workers(F.col("lines"), F.col("cpus")).alias("crops"), sizing.recogniser_threads(F.col("cpus"), F.col("lines")).alias("threads"), sizing.line_budget(F.lit(2), F.col("lines"), F.col("part") % 5 + 1, F.lit(12)).alias("budget"))


@query("part:i bytes:i swaps:b row:i fits:b area:i drawn:i", "f AS (SELECT p_partkey AS part, (p_partkey % 4)::INT AS f, p_size AS w, (p_partkey % 50 + 1)::INT AS h, CASE WHEN p_size % 2 = 0 THEN 0 ELSE p_size * 4 + 3 END AS given FROM part), s AS (SELECT *, CASE WHEN f < 2 THEN 3 ELSE 4 END AS bpp, CASE WHEN given = 0 THEN w * CASE WHEN f < 2 THEN 3 ELSE 4 END ELSE given END AS r FROM f)", """
SELECT part, bpp AS bytes, f IN (1, 3) AS swaps, r AS row, r >= w * bpp AND (h - 1) * r + w * bpp <= 5000 AS fits, w * h AS area, [0, 180, 180, 0, 0, 180][(part % 6 + 1)::INT] AS drawn FROM s""")
def pixel_layouts(spark, sf_dir):
    p = inputs.load(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % 4).cast("int").alias("f"), F.col("p_size").alias("w"), (F.col("p_partkey") % 50 + 1).cast("int").alias("h"))
    p = p.withColumn("given", F.when(F.col("w") % 2 == 0, 0).otherwise(F.col("w") * 4 + 3))
    row = sizing.stride(F.col("given"), F.col("w"), F.col("f"))
    angle = F.element_at(F.array(*map(F.lit, (0, 90, 180, -90, 270, -180))), (F.col("part") % 6 + 1).cast("int"))
    return p.withColumn("row", row).select("part", sizing.bytes_per_pixel(F.col("f")).alias("bytes"), sizing.swaps_red_blue(F.col("f")).alias("swaps"), "row", sizing.fits_buffer(F.lit(5000), F.col("row"), F.col("w"), F.col("h"), F.col("f")).alias("fits"), sizing.checked_pixels(F.col("w"), F.col("h")).alias("area"), sizing.drawn_degrees(angle).alias("drawn"))


_EACH = f"{inputs.LINEITEM.strip()}, u AS (SELECT l_orderkey AS page, l_linenumber AS line_no, (l_partkey % 700 + 1)::INT AS w, (l_suppkey % 90 + 1)::INT AS h FROM li), tw AS (SELECT *, greatest(32, ((ceil(w * 48.0::DOUBLE / h)::BIGINT + 31) // 32) * 32) AS target FROM u)"


def _each_line(spark, sf_dir):
    li = inputs._lineitem(spark, sf_dir)
    return li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line_no"), (F.col("l_partkey") % 700 + 1).cast("int").alias("width"), (F.col("l_suppkey") % 90 + 1).cast("int").alias("height"))


@query("page:i line_no:i target_width:i batch:i slot:i", _EACH, "SELECT page, line_no, target AS target_width, (row_number() OVER w - 1) // 2 AS batch, (row_number() OVER w - 1) % 2 AS slot FROM tw WINDOW w AS (PARTITION BY page, target ORDER BY line_no)")
def width_batches(spark, sf_dir):
    lines = _each_line(spark, sf_dir)
    return evaluate.width_batches(lines.withColumn("target_width", sizing.recogniser_target(F.col("width"), F.col("height"))), 2)


@query("page:i line_no:i turn:i", _EACH, "SELECT page, line_no, row_number() OVER (PARTITION BY page ORDER BY w::DOUBLE / h DESC, line_no) AS turn FROM tw")
def longest_first(spark, sf_dir):
    return evaluate.longest_first(_each_line(spark, sf_dir))


@query("page:i line_no:i bytes:i offset:i", _EACH, """SELECT page, line_no, w * h * 3 AS bytes, coalesce(sum(w * h * 3) OVER (PARTITION BY page ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM u""")
def crop_offsets(spark, sf_dir):
    lines = _each_line(spark, sf_dir).withColumn("bytes", F.col("width") * F.col("height") * 3)
    return evaluate.prefix_offsets(lines, ["page"], "line_no", "bytes")


@query("page:i line:i role:s length:i", "", "SELECT conv_id AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line, role, length(text) AS length FROM conversations")
def positional_lines(spark, sf_dir):
    c = inputs.load(spark, sf_dir, "conversations")
    listed = c.groupBy(F.col("conv_id").alias("page")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("length")))).alias("v"))
    return evaluate.zip_lines(listed.select("page", F.transform("v", lambda x: x["role"]).alias("role"), F.transform("v", lambda x: x["length"]).alias("length")), ["role", "length"])


# --- boxes

@query("line:i min_x:d min_y:d max_x:d max_y:d area:d convex:b inside:b grow:d", inputs.QUADS, """
SELECT line, least(x1, x2, x3, x4) AS min_x, least(y1, y2, y3, y4) AS min_y, greatest(x1, x2, x3, x4) AS max_x, greatest(y1, y2, y3, y4) AS max_y,
  ((x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y4 - x4 * y3) + (x4 * y1 - x1 * y4)) / 2 AS area,
  (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1) > 0 AND (x3 - x2) * (y4 - y2) - (y3 - y2) * (x4 - x2) > 0 AND (x4 - x3) * (y1 - y3) - (y4 - y3) * (x1 - x3) > 0 AND (x1 - x4) * (y2 - y4) - (y1 - y4) * (x2 - x4) > 0 AS convex,
  NOT (greatest((x2 - x1) * (40 - y1) - (y2 - y1) * (50 - x1), (x3 - x2) * (40 - y2) - (y3 - y2) * (50 - x2), (x4 - x3) * (40 - y3) - (y4 - y3) * (50 - x3), (x1 - x4) * (40 - y4) - (y1 - y4) * (50 - x4)) > 0
   AND least((x2 - x1) * (40 - y1) - (y2 - y1) * (50 - x1), (x3 - x2) * (40 - y2) - (y3 - y2) * (50 - x2), (x4 - x3) * (40 - y3) - (y4 - y3) * (50 - x3), (x1 - x4) * (40 - y4) - (y1 - y4) * (50 - x4)) < 0) AS inside,
  abs(((x1 * y2 - x2 * y1) + (x2 * y3 - x3 * y2) + (x3 * y4 - x4 * y3) + (x4 * y1 - x1 * y4)) / 2) * 1.4::DOUBLE
   / (sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) + sqrt((x3 - x2) ** 2 + (y3 - y2) ** 2) + sqrt((x4 - x3) ** 2 + (y4 - y3) ** 2) + sqrt((x1 - x4) ** 2 + (y1 - y4) ** 2)) AS grow FROM q""")
def quad_measures(spark, sf_dir):
    q = _quad()
    box = geo.aabb(q)
    return inputs.quads(spark, sf_dir).select("line", *(c.alias(n) for c, n in zip(box, ("min_x", "min_y", "max_x", "max_y"))), geo.signed_area(q).alias("area"), geo.is_positive_convex(q).alias("convex"), geo.point_in_quad(F.lit(50.0), F.lit(40.0), q).alias("inside"), geo.unclip_distance(q).alias("grow"))


@query("line:i center_x:d center_y:d long_edge:d short_edge:d angle:d", f"{inputs.QUADS.strip()}, e AS (SELECT *, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS ac, sqrt((x1 - x4) ** 2 + (y1 - y4) ** 2) AS dn FROM q)", """
SELECT line, (x1 + x2 + x3 + x4) / 4 AS center_x, (y1 + y2 + y3 + y4) / 4 AS center_y, greatest(ac, dn) AS long_edge, least(ac, dn) AS short_edge,
       degrees(CASE WHEN ac >= dn THEN atan2(y2 - y1, x2 - x1) ELSE atan2(y4 - y1, x4 - x1) END) AS angle FROM e""")
def quad_frames(spark, sf_dir):
    return inputs.quads(spark, sf_dir).select("line", *(v.alias(k) for k, v in geo.quad_frame(_quad()).items()))


@query("line:i sx:d sy:d", inputs.QUADS, """
SELECT line, CASE size % 4 WHEN 1 THEN 400 - 1 - y1 WHEN 2 THEN 400 - 1 - x1 WHEN 3 THEN y1 ELSE x1 END AS sx,
       CASE size % 4 WHEN 1 THEN x1 WHEN 2 THEN 300 - 1 - y1 WHEN 3 THEN 300 - 1 - x1 ELSE y1 END AS sy FROM q""")
def to_source(spark, sf_dir):
    x, y = geo.to_source(F.col("x1"), F.col("y1"), F.lit(400), F.lit(300), F.col("size") % 4 * 90)
    return inputs.quads(spark, sf_dir).select("line", x.alias("sx"), y.alias("sy"))


@query("line:i ox1:d oy1:d ox2:d oy2:d ox3:d oy3:d ox4:d oy4:d", f"""{inputs.QUADS.strip()},
pts AS (SELECT line, unnest([0, 1, 2, 3]) AS i, unnest([x3, x1, x4, x2]) AS x, unnest([y3, y1, y4, y2]) AS y FROM q),
rk AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY x + y, i) AS lo, row_number() OVER (PARTITION BY line ORDER BY x + y DESC, i) AS hi FROM pts),
md AS (SELECT line, i, x, y, row_number() OVER (PARTITION BY line ORDER BY y - x, i DESC) AS k FROM rk WHERE lo > 1 AND hi > 1)""", """
SELECT a.line, a.x AS ox1, a.y AS oy1, b.x AS ox2, b.y AS oy2, c.x AS ox3, c.y AS oy3, d.x AS ox4, d.y AS oy4
FROM rk a JOIN md b ON a.line = b.line AND a.lo = 1 AND b.k = 1 JOIN rk c ON a.line = c.line AND c.hi = 1 JOIN md d ON a.line = d.line AND d.k = 2""")
def order_clockwise(spark, sf_dir):
    shuffled = [F.col(c) for c in ("x3", "y3", "x1", "y1", "x4", "y4", "x2", "y2")]
    out = geo.order_clockwise(shuffled)
    return inputs.quads(spark, sf_dir).select("line", *(c.alias(f"o{p}") for c, p in zip(out, geo.POINTS)))


_PERSPECTIVE = f"""{inputs.QUADS.strip()},
d1 AS (SELECT *, floor(greatest(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2), sqrt((x3 - x4) ** 2 + (y3 - y4) ** 2))) AS pw, floor(greatest(sqrt((x1 - x4) ** 2 + (y1 - y4) ** 2), sqrt((x2 - x3) ** 2 + (y2 - y3) ** 2))) AS ph,
   x1 - x2 + x3 - x4 AS sx, y1 - y2 + y3 - y4 AS sy, x2 - x3 AS ax, y2 - y3 AS ay, x4 - x3 AS bx, y4 - y3 AS byy FROM q),
d2 AS (SELECT *, (sx * byy - bx * sy) / (ax * byy - bx * ay) AS g, (ax * sy - sx * ay) / (ax * byy - bx * ay) AS h FROM d1)"""


@query("line:i width:i height:i vertical:b mx:d my:d", _PERSPECTIVE, """
SELECT line, CASE WHEN ph >= 1.5 * pw THEN ph ELSE pw END AS width, CASE WHEN ph >= 1.5 * pw THEN pw ELSE ph END AS height, ph >= 1.5 * pw AS vertical,
       ((x2 - x1 + g * x2) * 0.25 + (x4 - x1 + h * x4) * 0.75 + x1) / (g * 0.25 + h * 0.75 + 1) AS mx, ((y2 - y1 + g * y2) * 0.25 + (y4 - y1 + h * y4) * 0.75 + y1) / (g * 0.25 + h * 0.75 + 1) AS my FROM d2""")
def perspective_crops(spark, sf_dir):
    p = geo.Perspective.of(_quad())
    (w, h), (x, y) = p.size(), p.map(F.lit(0.25), F.lit(0.75))
    return inputs.quads(spark, sf_dir).select("line", w.alias("width"), h.alias("height"), p.vertical.alias("vertical"), x.alias("mx"), y.alias("my"))


@query("line:i px:d py:d", inputs.QUADS, """
SELECT line, greatest(0, least(640, round_even(x3 / 416 * 640, 0))) AS px, greatest(0, least(200, round_even(y3 / 320 * 200, 0))) AS py FROM q""")
def map_to_source(spark, sf_dir):
    return inputs.quads(spark, sf_dir).select("line", geo.to_map(F.col("x3"), F.lit(416), F.lit(640)).alias("px"), geo.to_map(F.col("y3"), F.lit(320), F.lit(200)).alias("py"))


_IOU = f"""{inputs.BOXES.strip()},
ov AS (SELECT gt.image, gt.line AS gi, pr.line AS pi, least(gt.x1, pr.x1) - greatest(gt.x0, pr.x0) AS iw, least(gt.y1, pr.y1) - greatest(gt.y0, pr.y0) AS ih,
              (gt.x1 - gt.x0) * (gt.y1 - gt.y0) + (pr.x1 - pr.x0) * (pr.y1 - pr.y0) AS areas FROM gt JOIN pr USING (image)),
pairs AS (SELECT image, gi, pi, iw * ih / (areas - iw * ih) AS iou FROM ov WHERE iw > 0 AND ih > 0 AND iw * ih / (areas - iw * ih) >= 0.3)"""


@query("image:i gi:i pi:i iou:d", _IOU, "SELECT * FROM pairs")
def iou_matches(spark, sf_dir):
    return evaluate.iou_pairs(inputs.truth_boxes(spark, sf_dir), inputs.predicted_boxes(spark, sf_dir))


_GREEDY = f"""{_IOU},
listed AS (SELECT image, list([{{'g': gi::BIGINT, 'p': pi::BIGINT, 'o': iou}}] ORDER BY iou DESC, gi, pi) AS l FROM pairs GROUP BY image),
taken AS (SELECT image, unnest(list_reduce(l, lambda s, x: CASE WHEN len(list_filter(s, lambda t: t.g = x[1].g OR t.p = x[1].p)) = 0 THEN s || x ELSE s END, [])) AS t FROM listed),
ga AS (SELECT image, t.g AS gi, t.p AS pi, t.o AS iou FROM taken)"""


@query("image:i gi:i pi:i iou:d", _GREEDY, "SELECT * FROM ga")
def greedy_assignment(spark, sf_dir):
    return evaluate.greedy_assignment(evaluate.iou_pairs(inputs.truth_boxes(spark, sf_dir), inputs.predicted_boxes(spark, sf_dir)))


@query("cls_correct:i cls_total:i", _GREEDY, "SELECT coalesce(sum((cls_degrees = rotation)::INT), 0) AS cls_correct, count(*) AS cls_total FROM ga JOIN gt ON ga.image = gt.image AND ga.gi = gt.line JOIN pr ON ga.image = pr.image AND ga.pi = pr.line")
def rotation_by_box(spark, sf_dir):
    t, p = inputs.truth_boxes(spark, sf_dir), inputs.predicted_boxes(spark, sf_dir)
    return evaluate.rotation_score(evaluate.greedy_assignment(evaluate.iou_pairs(t, p)), t, p)


# Each box in turn is put behind the last one, from the right, that it may not pass.
_BEHIND = "coalesce(list_max(list_filter(range(1, len(s) + 1), lambda k: NOT (abs(e[1].y - s[k].y) < 10 AND e[1].x < s[k].x))), 0)"


@query("page:i line_no:i place:i", f"""{inputs.BOXES.strip()},
listed AS (SELECT image, list([{{'n': line::BIGINT, 'x': x0, 'y': y0}}] ORDER BY y0, x0, line) AS l FROM gt GROUP BY image),
ordered AS (SELECT image, list_reduce(l, lambda s, e: s[1 : {_BEHIND}] || e || s[{_BEHIND} + 1 :]) AS l FROM listed)""", "SELECT image AS page, unnest(l).n AS line_no, unnest(range(0, len(l))) AS place FROM ordered")
def reading_order(spark, sf_dir):
    boxes = inputs.truth_boxes(spark, sf_dir).select(F.col("image").alias("page"), F.col("line").alias("line_no"), F.col("x0").alias("x1"), F.col("y0").alias("y1"))
    return dbpost.sort_reading_order(boxes)


# --- summaries

@query("run:s n:i mean:d median:d p95:d min:d max:d sum:d", f"{inputs.BENCH.strip()}, sm AS (SELECT run, count(*) AS n, avg(total_ms) AS mean, median(total_ms) AS median, list_sort(list(total_ms)) AS v, min(total_ms) AS min, max(total_ms) AS max, sum(total_ms) AS sum FROM br GROUP BY run)", """
SELECT run, n, mean, median, v[least(n - 1, floor(0.95::DOUBLE * (n - 1) + 0.5))::BIGINT + 1] AS p95, min, max, sum FROM sm""")
def stage_stats(spark, sf_dir):
    return evaluate.stats(inputs.bench_rows(spark, sf_dir), ["run"], "total_ms")


@query("run:s rounded:d ceiling:d upper:d lower:d", f"{inputs.BENCH.strip()}, sm AS (SELECT run, count(*) AS n, list_sort(list(total_ms)) AS v FROM br GROUP BY run)", """
SELECT run, v[least(n - 1, floor(0.95::DOUBLE * (n - 1) + 0.5))::BIGINT + 1] AS rounded, v[greatest(1, ceil(0.95::DOUBLE * n))::BIGINT] AS ceiling, v[n // 2 + 1] AS upper, v[(n - 1) // 2 + 1] AS lower FROM sm""")
def percentile_rules(spark, sf_dir):
    picks = {"rounded": "p95_rounded", "ceiling": "p95_ceiling", "upper": "upper_median", "lower": "lower_median"}
    return evaluate.ranked(inputs.bench_rows(spark, sf_dir), ["run"], "total_ms", picks)


_SUMMARY = f"""{inputs.BENCH.strip()},
wu AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq) <= least(3, count(*) OVER (PARTITION BY run) - 1) AS warm FROM br),
me AS (SELECT run, count(*) AS n, avg(total_ms) AS mean, median(total_ms) AS median, list_sort(list(total_ms)) AS v, min(total_ms) AS min, max(total_ms) AS max, sum(total_ms) AS sum, sum(lines) AS lt,
              avg(total_ms / 2) AS crop, avg(total_ms / 8) FILTER (seq % 3 = 0) AS det, count(*) FILTER (seq % 3 = 0) AS third,
              avg(total_ms) FILTER (seq % 3 = 1) AS op1, avg(total_ms) FILTER (seq % 2 = 1) AS conv1 FROM wu WHERE NOT warm GROUP BY run),
al AS (SELECT run, count(*) FILTER (warm) AS warmup, avg(total_ms) FILTER (warm) AS warmup_ms, max(total_ms) - min(total_ms) AS delta FROM wu GROUP BY run),
sl AS (SELECT run, file, total_ms AS slowest_ms FROM wu WHERE NOT warm QUALIFY row_number() OVER (PARTITION BY run ORDER BY total_ms DESC, seq) = 1)"""


@query("run:s n:i warmup:i mean:d median:d p95:d min:d max:d sum:d img_per_s:d lines_mean:d lines_total:i warmup_ms:d slowest_file:s slowest_ms:d working_set_delta:d stages:s crop:d det:d op1:d conv1:d", _SUMMARY, """
SELECT run, n, warmup, mean, median, v[least(n - 1, floor(0.95::DOUBLE * (n - 1) + 0.5))::BIGINT + 1] AS p95, min, max, sum, 1000 / mean AS img_per_s, lt::DOUBLE / n AS lines_mean, lt AS lines_total,
       warmup_ms, file AS slowest_file, slowest_ms, CASE WHEN run <> 'error' THEN delta END AS working_set_delta, 'det_graph,crop,rec_graph,zeta' AS stages, crop, det, op1, conv1 FROM me JOIN al USING (run) JOIN sl USING (run)""")
def build_summary(spark, sf_dir):
    rows = evaluate.warmup(inputs.bench_rows(spark, sf_dir), ["run"], ["seq"], 3)
    out = evaluate.build_summary(rows, ["run"], inputs.bench_meta(spark, sf_dir))
    mean = lambda column, key: F.try_element_at(f"{column}_mean", F.lit(key))
    return out.select("*", F.array_join(F.map_keys("stage_ms_mean"), ",").alias("stages"), mean("stage_ms", "crop").alias("crop"), mean("stage_ms", "det_graph").alias("det"), mean("operator_ms", "op1").alias("op1"), mean("conv_class_ms", "conv1").alias("conv1"))


@query("user:i key:s mean:d position:i", """
km AS (SELECT user_id AS u, CASE event_type WHEN 'view' THEN 'crop' WHEN 'click' THEN 'det_graph' WHEN 'purchase' THEN 'zeta' ELSE event_type END AS key, avg(value) AS mean FROM events GROUP BY 1, 2)""", """
SELECT u AS "user", key, mean, row_number() OVER (PARTITION BY u ORDER BY CASE key WHEN 'det_graph' THEN 2 WHEN 'crop' THEN 5 ELSE 12 END, key) AS position FROM km""")
def stage_means(spark, sf_dir):
    key = F.when(F.col("event_type") == "view", "crop").when(F.col("event_type") == "click", "det_graph").when(F.col("event_type") == "purchase", "zeta").otherwise(F.col("event_type"))
    rows = inputs.load(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.create_map(key, F.col("value")).alias("stage_ms"))
    return evaluate.key_means(rows, ["user"], "stage_ms")


@query("run:s seq:i delta_ms:d delta_calls:i", f"{inputs.BENCH.strip()}, cu AS (SELECT run, seq, seq * 3 + total_ms AS ms, seq // 9 AS calls FROM br), de AS (SELECT run, seq, ms - coalesce(lag(ms) OVER w, 0) AS delta_ms, calls - coalesce(lag(calls) OVER w, 0) AS delta_calls FROM cu WINDOW w AS (PARTITION BY run ORDER BY seq))", "SELECT * FROM de WHERE delta_calls > 0")
def counter_deltas(spark, sf_dir):
    rows = inputs.bench_rows(spark, sf_dir)
    snapshots = rows.select("run", "seq", (F.col("seq") * 3 + F.col("total_ms")).alias("ms"), F.floor(F.col("seq") / 9).alias("calls"))
    return evaluate.counter_deltas(snapshots, ["run"], "seq")


@query("run:s seq:i peak:d", inputs.BENCH, "SELECT run, seq, max(working_set_mb) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS peak FROM br")
def running_peak(spark, sf_dir):
    return evaluate.running_peak(inputs.bench_rows(spark, sf_dir), ["run"], "seq", "working_set_mb")


@query("run:s steady:d", f"{inputs.BENCH.strip()}, lr AS (SELECT * FROM br QUALIFY row_number() OVER (PARTITION BY run ORDER BY seq DESC) <= 50), sv AS (SELECT run, list_sort(list(total_ms)) AS v, count(*) AS n FROM lr GROUP BY run)", "SELECT run, v[n // 2 + 1] AS steady FROM sv")
def steady_tail(spark, sf_dir):
    return evaluate.steady_tail(inputs.bench_rows(spark, sf_dir), ["run"], "seq", "total_ms")


@query("event_id:i k:d", "", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k')::DOUBLE ELSE json_extract_string(props, '$.k')::DOUBLE END AS k FROM events""")
def polymorphic_metric(spark, sf_dir):
    e = inputs.load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"ms": '), k, F.lit(', "calls": 1}'))).otherwise(k)
    return e.select("event_id", evaluate.metric_value(raw).alias("k"))


_KEY = "CASE event_type WHEN 'view' THEN 'crop' WHEN 'click' THEN 'det_graph' WHEN 'purchase' THEN 'zeta' ELSE event_type END"


@query("user:i key:s mean:d position:i", f"km AS (SELECT user_id AS u, {_KEY} AS key, avg(value) AS mean FROM events GROUP BY 1, 2)", """
SELECT u AS "user", key, mean, row_number() OVER (PARTITION BY u ORDER BY mean DESC, key) AS position FROM km""")
def operator_means(spark, sf_dir):
    return evaluate.metric_means(_stage_rows(spark, sf_dir), ["user"], "stage_ms")


@query("user:i stage:s ms:d calls:i", "", f"""SELECT user_id AS "user", {_KEY} AS stage, sum(value) AS ms, sum(event_id % 4) AS calls FROM events GROUP BY 1, 2""")
def stage_counters(spark, sf_dir):
    return evaluate.stage_counters(_stage_rows(spark, sf_dir), ["user"])


def _stage_rows(spark, sf_dir):
    key = F.when(F.col("event_type") == "view", "crop").when(F.col("event_type") == "click", "det_graph").when(F.col("event_type") == "purchase", "zeta").otherwise(F.col("event_type"))
    return inputs.load(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.create_map(key, F.col("value")).alias("stage_ms"), F.create_map(key, F.col("event_id") % 4).alias("stage_calls"))


@query("run:s part:i rows:i first_file:s mean:d", f"{inputs.BENCH.strip()}, av AS (SELECT run, avg(total_ms) AS mean FROM br GROUP BY run)", """SELECT run, seq // 1000 AS part, count(*) AS rows, arg_min(file, seq) AS first_file, any_value(mean) AS mean FROM br JOIN av USING (run) GROUP BY ALL""")
def result_documents(spark, sf_dir):
    rows = inputs.bench_rows(spark, sf_dir)
    document = evaluate.result_document(rows.select("run").distinct().withColumn("rid", F.lit("x")), evaluate.stats(rows, ["run"], "total_ms"), rows, most=1000)
    return document.select("run", "part", F.size("rows").alias("rows"), F.col("rows")[0]["file"].alias("first_file"), F.col("summary.mean").alias("mean"))


# --- accuracy

@query("file:s line:i text:s exact:b chars:i errors:i", inputs.LINES, "SELECT file, line, text, exact, chars, errors FROM le")
def line_errors(spark, sf_dir):
    return evaluate.line_errors(inputs.truth_lines(spark, sf_dir), inputs.predicted_lines(spark, sf_dir))


@query("exact_lines:i total_lines:i exact_img:i images:i errors:i total_chars:i cer:d char_acc:d", f"{inputs.LINES.strip()}, im AS (SELECT file, sum(exact::INT) AS hit, count(*) AS n, sum(errors) AS e, sum(chars) AS c FROM le GROUP BY file)", """
SELECT sum(hit) AS exact_lines, sum(n) AS total_lines, count(*) FILTER (hit = n) AS exact_img, count(*) AS images, sum(e) AS errors, sum(c) AS total_chars, sum(e)::DOUBLE / sum(c) AS cer, 1 - sum(e)::DOUBLE / sum(c) AS char_acc FROM im""")
def accuracy(spark, sf_dir):
    return evaluate.accuracy(evaluate.line_errors(inputs.truth_lines(spark, sf_dir), inputs.predicted_lines(spark, sf_dir)))


@query("cls_correct:i cls_total:i", inputs.LINES.replace("t AS (SELECT *, lower(file) AS f, row_number() OVER (PARTITION BY lower(file), text ORDER BY line) AS k FROM tl WHERE lower(file) IN (SELECT lower(file) FROM pl))", "t AS (SELECT *, lower(file) AS f, row_number() OVER (PARTITION BY lower(file), text ORDER BY line) AS k FROM tl)"), """
SELECT coalesce(sum((cls_degrees = rotation)::INT), 0) AS cls_correct, count(*) AS cls_total FROM t JOIN p ON t.f = p.f AND t.text = p.text AND t.k = p.k""")
def rotation_by_text(spark, sf_dir):
    return evaluate.rotation_score_by_text(inputs.truth_lines(spark, sf_dir), inputs.predicted_lines(spark, sf_dir))


@query("exact_lines:i total_lines:i images:i errors:i cls_correct:i cls_total:i", f"{inputs.LINES.strip()}, kf AS (SELECT * FROM le WHERE right(file, 1) NOT IN ('1', '2'))", """
SELECT sum(exact::INT) AS exact_lines, count(*) AS total_lines, count(DISTINCT file) AS images, sum(errors) AS errors, 0 AS cls_correct, 0 AS cls_total FROM kf""")
def accuracy_measured_only(spark, sf_dir):
    truth = inputs.truth_lines(spark, sf_dir)
    rows = truth.select(F.lower("file").alias("file")).distinct().withColumn("warmup", F.substring("file", -1, 1).isin("1", "2"))
    return evaluate.measured_accuracy(evaluate.line_errors(truth, inputs.predicted_lines(spark, sf_dir)), rows)


@query("image:i mode:s", f"{inputs.BOXES.strip()}, tm AS (SELECT image, max((x1 > x0 AND image % 5 <> 0)::INT) AS t FROM gt GROUP BY image), pm AS (SELECT image, max((image % 7 <> 0)::INT) AS p FROM pr GROUP BY image)", """
SELECT coalesce(tm.image, pm.image) AS image, CASE WHEN t IS NULL OR p IS NULL THEN 'none' WHEN t = 1 AND p = 1 THEN 'boxes' ELSE 'text' END AS mode FROM tm FULL JOIN pm ON tm.image = pm.image""")
def match_modes(spark, sf_dir):
    t = inputs.truth_boxes(spark, sf_dir).withColumn("x1", F.when(F.col("image") % 5 == 0, F.col("x0")).otherwise(F.col("x1")))
    p = inputs.predicted_boxes(spark, sf_dir).withColumn("x0", F.when(F.col("image") % 7 != 0, F.col("x0")))
    return evaluate.match_modes(t, p)


# --- reports

_BASE = "first_value(mean) OVER (PARTITION BY {0} ORDER BY CASE WHEN case_id IN ('tiny-4w', 'tiny') THEN 0 ELSE 1 END, case_id, label)"
_RATED = f"{inputs.RUNS_TABLE.strip()}, bs AS (SELECT *, {_BASE.format('lower(rid), replica')} AS baseline FROM rn), rt AS (SELECT *, CASE WHEN baseline > 0 THEN mean / baseline END AS ratio FROM bs)"


@query("run:i baseline:d ratio:d", _RATED, "SELECT run, baseline, ratio FROM rt")
def replica_baseline(spark, sf_dir):
    return report.with_baseline(inputs.runs(spark, sf_dir).withColumn("_rid", F.lower("rid")), ["_rid", "replica"])


@query("run:i peers:i ratio:d", f"{inputs.RUNS_TABLE.strip()}, bs AS (SELECT *, {_BASE.format('lower(rid), replica, cpu_name')} AS baseline, count(*) OVER (PARTITION BY lower(rid), replica, cpu_name) AS peers FROM rn)", "SELECT run, peers, CASE WHEN peers > 1 AND baseline > 0 THEN mean / baseline END AS ratio FROM bs")
def smoke_peers(spark, sf_dir):
    return report.smoke(inputs.runs(spark, sf_dir))


@query("rid:s case_key:s replicas:i ratio_median:d ratio_min:d ratio_max:d ws_delta_median:d", _RATED, """
SELECT lower(rid) AS rid, CASE WHEN case_id = '' THEN label ELSE case_id END AS case_key, count(ratio) AS replicas, median(ratio) AS ratio_median, min(ratio) AS ratio_min, max(ratio) AS ratio_max, median(ws_last - ws_loaded) AS ws_delta_median
FROM rt GROUP BY 1, 2 HAVING count(ratio) > 1""")
def case_rollup(spark, sf_dir):
    return report.case_rollup(inputs.runs(spark, sf_dir))


_KINDS = ["click", "error", "purchase", "signup", "view"]
_CELLS = ", ".join(f"coalesce(printf('%.2f', avg(value * 1.00013::DOUBLE) FILTER (event_type = '{k}')), '-') AS {k}" for k in _KINDS)
_STAGE = "CASE event_id % 40 WHEN 0 THEN 'crop' WHEN 1 THEN 'det_graph' WHEN 2 THEN 'rec_graph' ELSE 'k' || (event_id % 40) END"


def _keyed(spark, sf_dir):
    k = F.col("event_id") % 40
    key = F.when(k == 0, "crop").when(k == 1, "det_graph").when(k == 2, "rec_graph").otherwise(F.concat(F.lit("k"), k.cast("string")))
    return inputs.load(spark, sf_dir, "events").select(key.alias("key"), F.col("event_type").alias("run"), (F.col("value") * 1.00013).alias("value"))


@query("key:s position:i click:s error:s purchase:s signup:s view:s", "", f"SELECT {_STAGE} AS key, CASE {_STAGE} WHEN 'det_graph' THEN 2 WHEN 'crop' THEN 5 WHEN 'rec_graph' THEN 10 ELSE 12 END AS position, {_CELLS} FROM events GROUP BY 1, 2")
def compare_runs(spark, sf_dir):
    return report.compare(_keyed(spark, sf_dir), _KINDS)


@query("key:s position:i", f"ks AS (SELECT DISTINCT {_STAGE} AS key FROM events)", "SELECT key, row_number() OVER (ORDER BY CASE key WHEN 'det_graph' THEN 2 WHEN 'crop' THEN 5 WHEN 'rec_graph' THEN 10 ELSE 12 END, key) AS position FROM ks")
def key_union(spark, sf_dir):
    return report.key_union(_keyed(spark, sf_dir))


@query("run:i bench:i smoke:i files:i", inputs.RUNS_TABLE, "SELECT run, row_number() OVER (ORDER BY replica, case_id, label) AS bench, row_number() OVER (ORDER BY rid, case_id, label) AS smoke, row_number() OVER (ORDER BY lower(rid || label), rid || label) AS files FROM rn")
def report_orders(spark, sf_dir):
    runs = inputs.runs(spark, sf_dir).withColumn("sort_key", F.concat("rid", "label"))
    return report.with_places(runs.withColumn("folded", F.lower("sort_key")), {"bench": report.RUN_ORDER, "smoke": report.SMOKE_ORDER, "files": report.FILE_ORDER})


_LABEL = f"""{inputs.RUNS_TABLE.strip()}, sd AS (SELECT *, CASE WHEN contains(lower(library), 'netstandard') THEN 'ns2' WHEN hwintrinsic = '0' THEN 'scalar' WHEN avx = '0' THEN 'noavx' WHEN avx2 = '0' THEN 'noavx2' WHEN avx512 = '0' THEN 'noavx512' ELSE '' END AS simd FROM rn)"""


@query("run:i simd:s run_label:s simd_rank:i model_rank:i kind_of:s", _LABEL, """
SELECT run, simd, trim(rid || ' ' || engine || ' ' || model || ' ' || workers || 'w' || CASE WHEN simd = '' THEN '' ELSE ' ' || simd END) AS run_label,
  CASE simd WHEN '' THEN 0 WHEN 'noavx512' THEN 1 WHEN 'noavx2' THEN 2 WHEN 'noavx' THEN 3 WHEN 'ns2' THEN 4 ELSE 5 END AS simd_rank, CASE model WHEN 'medium' THEN 0 WHEN 'small' THEN 1 WHEN 'tiny' THEN 2 ELSE 3 END AS model_rank,
  CASE WHEN lower(kind) IN ('simd', 'engine') THEN lower(kind) WHEN contains(file_name, '-engines-') THEN 'engine' ELSE 'simd' END AS kind_of FROM sd""")
def run_labels(spark, sf_dir):
    r = inputs.runs(spark, sf_dir)
    r = r.withColumn("simd", fmt.simd_suffix(*(F.col(c) for c in ("library", "hwintrinsic", "avx", "avx2", "avx512"))))
    label = fmt.run_label(*(F.col(c) for c in ("rid", "engine", "model", "workers", "simd")))
    return r.select("run", "simd", label.alias("run_label"), fmt.simd_rank(F.col("simd")).alias("simd_rank"), fmt.model_rank(F.col("model")).alias("model_rank"), fmt.benchmark_kind(F.col("kind"), F.col("file_name")).alias("kind_of"))


@query("run:i model:s delta:s part:s", inputs.RUNS_TABLE, """
SELECT run, replace(model, '|', '\\|') AS model, CASE WHEN ws_last IS NULL THEN '—' ELSE printf('%.1f', run::DOUBLE) END AS delta, CASE WHEN ws_last IS NULL THEN '—' ELSE run || '/' || (run + 5) END AS part FROM rn""")
def report_format(spark, sf_dir):
    r = inputs.runs(spark, sf_dir)
    seen = F.when(F.col("ws_last").isNotNull(), F.col("run"))
    return r.select("run", fmt.cell(F.col("model")).alias("model"), fmt.megabytes(seen.cast("double")).alias("delta"), fmt.fraction(seen, F.col("run") + 5).alias("part"))


# --- text

@query("page:i text:s hash:s", """
ln AS (SELECT conv_id AS page, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS text, hex(encode(string_agg(coalesce(text, '') || chr(0), '' ORDER BY turn))) AS packed FROM conversations GROUP BY conv_id),
hs AS (SELECT page, text, list_reduce(list_transform(range(1, length(packed), 2), lambda i: ('0x' || substr(packed, i, 2))::HUGEINT), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT, 14695981039346656037::HUGEINT) AS h FROM ln)""", """
SELECT page, text, lower(lpad(hex((h // 4294967296)::BIGINT), 8, '0')) || lower(lpad(hex((h % 4294967296)::BIGINT), 8, '0')) AS hash FROM hs""")
def packed_text_hash(spark, sf_dir):
    c = inputs.load(spark, sf_dir, "conversations")
    lines = c.select(F.col("conv_id").alias("page"), F.col("turn").alias("line_no"), "text")
    return fmt.page_text(lines).select("page", "text", fmt.fnv1a_hex("packed_text").alias("hash"))


@query("page:i line:i distance:i", """
f AS (SELECT conv_id AS page, turn AS line, regexp_replace(coalesce(text, ''), '[^ -~]', '?', 'g') AS t FROM conversations),
w AS (SELECT *, lag(t) OVER (PARTITION BY page ORDER BY line) AS b FROM f)""", "SELECT page, line, levenshtein(t, b) AS distance FROM w WHERE b IS NOT NULL")
def edit_distance(spark, sf_dir):
    """Each turn's whole text against the turn before; folded to ASCII, as the other engine counts bytes."""
    c = inputs.load(spark, sf_dir, "conversations")
    turns = c.select(F.col("conv_id").alias("page"), F.col("turn").alias("line"), fmt.ascii_fold(F.coalesce("text", F.lit(""))).alias("t"))
    before = turns.withColumn("b", F.lag("t").over(Window.partitionBy("page").orderBy("line"))).filter("b is not null")
    return before.select("page", "line", F.levenshtein(fmt.utf16_units(F.col("t")), fmt.utf16_units(F.col("b"))).alias("distance"))


@query("item:i best:i", "t AS (SELECT item_id, regexp_replace(text, '[^ -~]', '?', 'g') AS s FROM benchmark)", "SELECT a.item_id AS item, min(levenshtein(a.s, b.s)) AS best FROM t a JOIN t b ON a.item_id <> b.item_id WHERE a.item_id % 50 = 0 GROUP BY 1")
def nearest_texts(spark, sf_dir):
    """Every row whose id is divisible by 50, against all rows."""
    rows = inputs.load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("item"), fmt.ascii_fold(F.col("text")).alias("text"))
    return evaluate.nearest_texts(rows, F.col("item") % 50 == 0)


# --- pixels

@query("line:i on:i", "b AS (SELECT vec_id AS line, embedding AS v FROM embeddings)", "SELECT line, len(list_filter(v, lambda x: x > 0.2::FLOAT)) AS \"on\" FROM b")
def binarize(spark, sf_dir):
    rows = inputs.logits(spark, sf_dir)
    bits = raster.binarize(F.col("logits"), F.lit(0.2).cast("float"))
    return rows.select("line", F.aggregate(bits, F.lit(0), lambda s, x: s + x).alias("on"))


@query("page:i y:i x:i boundary:b", inputs.GRID, """
SELECT a.page, a.y, a.x, count(b.page) < 8 AS boundary FROM (SELECT * FROM g WHERE p > 0.4) a LEFT JOIN (SELECT * FROM g WHERE p > 0.4) b
ON a.page = b.page AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3""")
def boundary_pixels(spark, sf_dir):
    return raster.boundary_pixels(inputs.grid(spark, sf_dir).filter("p > 0.4").select("page", "y", "x"))


@query("page:i y:i x:i", inputs.GRID, """
SELECT DISTINCT page, y - dy AS y, x - dx AS x FROM g, (SELECT unnest([0, 1]) AS dy), (SELECT unnest([0, 1]) AS dx) WHERE p > 0.4 AND y - dy >= 0 AND x - dx >= 0""")
def dilate_pixels(spark, sf_dir):
    return raster.dilate_pixels(inputs.grid(spark, sf_dir).filter("p > 0.4"))


@query("page:i y:i min_x:i max_x:i", inputs.GRID, "SELECT page, y, min(x) AS min_x, max(x) AS max_x FROM g WHERE p > 0.4 GROUP BY 1, 2")
def row_extremes(spark, sf_dir):
    return raster.row_extremes(inputs.grid(spark, sf_dir).filter("p > 0.4"), ["page"])


_EDGES = [(1, 1, 9, 2), (9, 2, 8, 9), (8, 9, 2, 7), (2, 7, 1, 1)]
_ON = " OR ".join(f"(x BETWEEN {min(a, c)} AND {max(a, c)} AND y BETWEEN {min(b, d)} AND {max(b, d)} AND {c - a} * (y - {b}) = {d - b} * (x - {a}))" for a, b, c, d in _EDGES)
_CROSS = " + ".join(f"(CASE WHEN ({b} > y) <> ({d} > y) AND {c - a}::DOUBLE * (y - {b}) / {d - b} + {a} > x THEN 1 ELSE 0 END)" for a, b, c, d in _EDGES)


@query("page:i quad:i score:d", inputs.GRID, f"""
SELECT u.page, 1 AS quad, coalesce(s.score, 0) AS score FROM (SELECT DISTINCT page FROM g) u LEFT JOIN (SELECT page, avg(p) AS score FROM g WHERE {_ON} OR ({_CROSS}) % 2 = 1 GROUP BY page) s ON u.page = s.page""")
def polygon_scores(spark, sf_dir):
    grid = inputs.grid(spark, sf_dir)
    quads = grid.select("page").distinct().select("page", F.lit(1).alias("quad"), *(F.lit(float(v)).alias(n) for v, n in zip((1.4, 1.9, 9.2, 2.0, 8.7, 9.9, 2.0, 7.5), geo.POINTS)))
    return raster.polygon_scores(grid, quads)


@query("line:i kept:i", inputs.EVENT_STEPS, """SELECT line, count(*) AS kept FROM (SELECT *, lag(cls) OVER (PARTITION BY line ORDER BY step) AS b FROM scored) WHERE b IS NULL OR b <> cls GROUP BY line""")
def consecutive_repeats(spark, sf_dir):
    listed = inputs.steps(spark, sf_dir).groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "cls"))), lambda x: x["cls"]).alias("v"))
    return listed.select("line", F.size(raster.without_repeats(F.col("v"))).alias("kept"))


@query("key:s font:s", "", "SELECT lower(p_brand) AS key, min(CASE WHEN p_size % 2 = 0 THEN lower(p_brand) ELSE p_brand END) AS font FROM part GROUP BY 1")
def distinct_fonts(spark, sf_dir):
    from glyphlake.sources.generate import distinct_fonts as distinct

    return distinct(inputs.load(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("font")))


_FREE = f"""{inputs.BOXES.strip()},
listed AS (SELECT image AS page, list([{{'n': line::BIGINT, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}] ORDER BY line) AS l FROM gt GROUP BY image),
kept AS (SELECT page, unnest(list_reduce(l, lambda s, e: CASE WHEN len(list_filter(s, lambda t: greatest(0, e[1].x0 - 2) < t.x1 AND t.x0 < least(460, e[1].x1 + 2) AND greatest(0, e[1].y0 - 2) < t.y1 AND t.y0 < least(1000, e[1].y1 + 2))) = 0 THEN s || e ELSE s END, [])) AS t FROM listed)"""


@query("page:i line:i x0:d y0:d x1:d y1:d", _FREE, "SELECT page, t.n AS line, t.x0 AS x0, t.y0 AS y0, t.x1 AS x1, t.y1 AS y1 FROM kept")
def free_rectangles(spark, sf_dir):
    from glyphlake.sources.generate import free_boxes

    boxes = inputs.truth_boxes(spark, sf_dir).withColumnRenamed("image", "page")
    return free_boxes(boxes, 460, 1000)


_BACK = f"""{inputs.PIXELS.strip()},
bk AS (SELECT image, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) AS k, count(*) AS n, avg(r) AS r, avg(g) AS g, avg(b) AS b, min(seq) AS f FROM px GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY n DESC, f) AS rank, sum(n) OVER (PARTITION BY image) AS total, 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b AS light FROM bk),
bg AS (SELECT a.image, CASE WHEN s.image IS NOT NULL AND a.n < 0.55::DOUBLE * a.total AND a.light < 80 AND s.light > 140 THEN s.r ELSE a.r END AS r, CASE WHEN s.image IS NOT NULL AND a.n < 0.55::DOUBLE * a.total AND a.light < 80 AND s.light > 140 THEN s.g ELSE a.g END AS g,
              CASE WHEN s.image IS NOT NULL AND a.n < 0.55::DOUBLE * a.total AND a.light < 80 AND s.light > 140 THEN s.b ELSE a.b END AS b FROM rk a LEFT JOIN rk s ON a.image = s.image AND s.rank = 2 WHERE a.rank = 1)"""


@query("image:i r:d g:d b:d ink:s", _BACK, "SELECT image, r, g, b, CASE WHEN 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b > 140 THEN '17,17,17' ELSE '245,245,247' END AS ink FROM bg")
def background_colors(spark, sf_dir):
    back = evaluate.background_color(inputs.pixels(spark, sf_dir), ["image"])
    return back.withColumn("ink", geo.contrast_ink(F.col("r"), F.col("g"), F.col("b")))


@query("image:i r:i g:i b:i", f"""{_BACK},
fr AS (SELECT px.*, sqrt((px.r - bg.r) ** 2 + (px.g - bg.g) ** 2 + (px.b - bg.b) ** 2) AS d FROM px JOIN bg USING (image)),
md AS (SELECT image, list_sort(list(d)) AS v, count(*) AS n FROM fr WHERE d >= 16 GROUP BY image),
kp AS (SELECT image, list_sort(list(r)) AS r, list_sort(list(g)) AS g, list_sort(list(b)) AS b, count(*) AS n FROM fr JOIN md USING (image) WHERE d >= 16 AND d >= md.v[md.n // 2 + 1] GROUP BY image)""", "SELECT image, r[n // 2 + 1] AS r, g[n // 2 + 1] AS g, b[n // 2 + 1] AS b FROM kp")
def ink_colors(spark, sf_dir):
    px = inputs.pixels(spark, sf_dir)
    return evaluate.ink_color(px, evaluate.background_color(px, ["image"]), ["image"])


# --- pages

# A bar of 0.9 is found as its rectangle, grown on all sides by area x ratio / perimeter, rounded and scaled by two.
_BARS = """
br AS (SELECT vec_id AS page, unnest([0, 1, 2]) AS line_no, label + 2 AS l, 30 + vec_id % 7 AS r FROM embeddings),
gr AS (SELECT *, 3 + 13 * line_no AS t, 8 + 13 * line_no AS b, (r - l) * 5 * 1.4::DOUBLE / (2 * (r - l + 5)) AS d FROM br),
bx AS (SELECT page, line_no, greatest(0, 2 * round(l - d)) AS x0, least(80, 2 * round(r + d)) AS x1, greatest(0, 2 * round(t - d)) AS y0, least(80, 2 * round(b + d)) AS y1 FROM gr)"""


@query("page:i line_no:i x1:d y1:d x2:d y2:d x3:d y3:d x4:d y4:d score:d", _BARS, "SELECT page, line_no, x0 AS x1, y0 AS y1, x1 AS x2, y0 AS y2, x1 AS x3, y1 AS y3, x0 AS x4, y1 AS y4, 0.9::FLOAT AS score FROM bx")
def detect_boxes(spark, sf_dir):
    return dbpost.detect(inputs.vector_maps(spark, sf_dir))


@query("page:i line_no:i text:s score:d rotation:i")
def recognise_pages(spark, sf_dir):
    """Pages of two bars through stub models; tested against plain Python."""
    return models.recognise(models.synthetic_pages(inputs.page_labels(spark, sf_dir)), models.StubModels())


def _pixel_sql(width: str, height: str, full_width: str, full_height: int, pad: str, table: str = "nation", key: str = "n_nationkey") -> str:
    """The pixel behind each value of a tensor of planes, ``pad`` beyond the page."""
    return f"""
SELECT page, c AS channel, y, x, CASE WHEN x < w AND y < h THEN (7 * ((y * w + x) * 3 + c) + 3 * page) % 256 ELSE {pad} END AS pixel
FROM (SELECT {key}::BIGINT AS page, {width} AS w, {height} AS h, {full_width} AS fw FROM {table}), (SELECT unnest(range(0, 3)) AS c), (SELECT unnest(range(0, {full_height})) AS y), (SELECT unnest(range(0, 160)) AS x) WHERE x < fw"""


def _pixels_of(tensors, back):
    """(page, channel, y, x, pixel): ``back`` takes a value and its channel to the pixel."""
    flat = tensors.select("page", "height", "width", F.posexplode("values").alias("i", "v"))
    area = F.col("height") * F.col("width")
    channel = F.floor(F.col("i") / area).cast("int")
    return flat.select("page", channel.alias("channel"), (F.floor(F.col("i") / F.col("width")) % F.col("height")).alias("y"), (F.col("i") % F.col("width")).alias("x"), F.rint(back(F.col("v").cast("double"), channel)).alias("pixel"))


@query("page:i channel:i y:i x:i pixel:i", "", _pixel_sql("CASE WHEN n_nationkey % 2 = 0 THEN 32 ELSE 20 END", "CASE WHEN n_nationkey % 2 = 0 THEN 32 ELSE 11 END", "32", 32, "0"))
def detector_pixels(spark, sf_dir):
    """Detector inputs of pages that need no scaling, the odd ones tiny and padded."""
    pick = lambda a, b: lambda page: F.when(page % 2 == 0, a).otherwise(b)
    pages = inputs.patterns(spark, sf_dir, pick(32, 20), pick(32, 11))
    of = lambda values, c: F.element_at(F.array(*map(F.lit, values)), c + 1)
    return _pixels_of(imageops.model_inputs(pages, imageops.detector_input), lambda v, c: (v * of(imageops.DEVIATION, c) + of(imageops.MEAN, c)) * 255)


@query("page:i channel:i y:i x:i pixel:i", "", _pixel_sql("40 + 25 * r_regionkey", "80", "160", 80, "0", "region", "r_regionkey"))
def classifier_pixels(spark, sf_dir):
    """Classifier inputs of lines as high as it takes them; beyond the line values are -1, as of black."""
    pages = inputs.patterns(spark, sf_dir, lambda page: page * 25 + 40, lambda page: F.lit(80), "region", "r_regionkey")
    return _pixels_of(imageops.model_inputs(pages, imageops.classifier_input), lambda v, c: (v + 1) * 127.5)


@query("page:i channel:i y:i x:i pixel:i", "", _pixel_sql("5 + 4 * n_nationkey", "48", "((5 + 4 * n_nationkey + 31) // 32) * 32", 48, "128"))
def recogniser_pixels(spark, sf_dir):
    """Recogniser inputs of lines as high as it takes them; beyond the line values are 0, of which half a pixel is rounded up to 128."""
    pages = inputs.patterns(spark, sf_dir, lambda page: page * 4 + 5, lambda page: F.lit(48))

    def prepare(image):
        return imageops.recogniser_input(image, -(-image.shape[1] // 32) * 32)

    return _pixels_of(imageops.model_inputs(pages, prepare), lambda v, c: F.when(v == 0, 128).otherwise((v + 1) * 127.5))


@query("page:i label:i score:d degrees:i", "", "SELECT n_nationkey AS page, (3 * n_nationkey) // 20 AS label, 0.7 AS score, 90 * ((3 * n_nationkey) // 20) AS degrees FROM nation")
def orientation_pages(spark, sf_dir):
    """A stand-in classifier that reads the class from the level of pages of one colour."""
    n = inputs.load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page"))
    data = F.unhex(F.repeat(F.lpad(F.hex(F.col("page") * 3), 2, "0"), F.lit(3 * 30 * 40)))
    pages = n.select("page", F.lit(30).alias("width"), F.lit(40).alias("height"), F.lit(0).alias("stride"), F.lit(0).alias("pixel_format"), data.alias("data"))

    def classify(tensor):
        level = round(float(tensor[0].mean() * imageops.DEVIATION[0] + imageops.MEAN[0]) * 255)
        return [0.7 if k == level // 20 else 0.1 for k in range(4)]

    return models.page_orientation(pages, classify)


# --- files

@query("run:s position:i file:s total_ms:d crop:d op:d", f"""{inputs.BENCH.strip()}, nb AS (SELECT *, row_number() OVER (PARTITION BY run, seq // 1000 ORDER BY seq) - 1 AS position FROM br)""", """
SELECT run, position, file, total_ms, total_ms / 2 AS crop, total_ms AS op FROM nb""")
def result_files(spark, sf_dir):
    """Result documents written as JSON files and scanned again; operator times are numbers or objects."""
    rows = inputs.bench_rows(spark, sf_dir).drop("conv_class_ms")
    mixed = F.transform_values("operator_ms", lambda k, v: F.struct(v.alias("ms"), F.lit(1).alias("calls")))
    rows = rows.withColumn("operator_ms", mixed)
    document = evaluate.result_document(rows.select("run").distinct().withColumn("rid", F.col("run")), evaluate.stats(rows, ["run"], "total_ms"), rows, most=1000)
    folder = store.scratch(spark)
    bench.write_results(document.select("meta", "summary", "rows"), folder)
    found = bench.meta_columns(bench.read_results(spark, folder))
    return found.select(F.col("rid").alias("run"), F.col("seq").alias("position"), "row.file", "row.total_ms", F.col("row.stage_ms")["crop"].alias("crop"), evaluate.metric_value(F.element_at(F.map_values("row.operator_ms"), 1)).alias("op"))


def _truth_files(spark, sf_dir, degrees):
    """Ground truth of the order lines as JSON files of a thousand pages each."""
    b = inputs.truth_boxes(spark, sf_dir)
    line = F.struct(F.concat(F.lit("t"), F.col("line").cast("string")).alias("text"), F.array(*(F.col(c).cast("int") for c in ("x0", "y0", "x1", "y1"))).alias("bbox"), degrees.alias("cls_degrees"))
    pages = b.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("line", line.alias("l")))).alias("v"))
    image = F.struct(F.concat(F.lit("IMG-"), F.col("image").cast("string")).alias("file"), F.lit(460).alias("width"), F.lit(1000).alias("height"), F.transform("v", lambda x: x["l"]).alias("lines"))
    files = pages.groupBy(F.floor(F.col("image") / 1000).alias("k")).agg(F.collect_list(image).alias("images")).select(F.lit(1).alias("version"), "images")
    folder = store.scratch(spark)
    files.write.option("maxRecordsPerFile", 1).json(folder)
    return folder


_TRUTH = "SELECT 'img-' || image AS file, row_number() OVER (PARTITION BY image ORDER BY line) - 1 AS line, 't' || line AS text, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1, {0} AS cls_degrees FROM gt"


@query("file:s line:i text:s x0:i y0:i x1:i y1:i cls_degrees:i", inputs.BOXES, _TRUTH.format("cls_degrees"))
def truth_files(spark, sf_dir):
    return bench.read_truth(spark, _truth_files(spark, sf_dir, F.col("cls_degrees")))


@query("file:s line:i text:s x0:i y0:i x1:i y1:i cls_degrees:i", inputs.BOXES, _TRUTH.format("CASE WHEN line % 2 = 0 THEN cls_degrees ELSE 0 END"))
def truth_files_lenient(spark, sf_dir):
    """Degrees are missing in every other line."""
    return bench.read_truth(spark, _truth_files(spark, sf_dir, F.when(F.col("line") % 2 == 0, F.col("cls_degrees"))), lenient=True)
