"""Synthetic inputs of the operators, derived from the star-schema tables.

No table holds images, boxes or logits; each input here is made from columns
by arithmetic that both engines share, and its SQL stands beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEPS, CLASSES = 16, 4
DICTIONARY = ["a", "b"]
EVENT_DICTIONARY = ["c", "p", "s"]


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, logits): 16 steps of 4 class scores."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("line"), F.col("embedding").alias("logits"))


LOGITS = """
steps AS (SELECT vec_id AS line, s AS step, list_transform(embedding[s * 4 + 1 : s * 4 + 4], lambda x: x::DOUBLE) AS v
          FROM embeddings, (SELECT unnest(range(0, 16)) AS s)),
scored AS (SELECT line, step, list_position(v, list_max(v)) - 1 AS cls, 1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))) AS prob FROM steps)
"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line, step, cls, prob): a user's events in order; a view is a blank."""
    e = load(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("line"), (F.row_number().over(order) - 1).alias("step"), kind.alias("cls"), (F.col("value") / 500).alias("prob"))


EVENT_STEPS = """
scored AS (SELECT user_id AS line, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
                  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS cls, value / 500 AS prob FROM events)
"""

RUNS = """
marked AS (SELECT *, CASE WHEN lag(cls) OVER (PARTITION BY line ORDER BY step) = cls THEN 0 ELSE 1 END AS brk FROM scored),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY line ORDER BY step ROWS UNBOUNDED PRECEDING) AS run FROM marked),
found AS (SELECT line, run, cls, min(step) AS start, max(step) + 1 AS "end", arg_min(prob, step) AS score FROM runs WHERE cls <> 0 GROUP BY line, run, cls)
"""


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows; those of an order are numbered anew, so that rows that share a line number become lines of their own."""
    li = load(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *sorted(set(li.columns) - {"l_orderkey", "l_linenumber"}))
    return li.withColumn("l_linenumber", F.row_number().over(order))


LINEITEM = """
li AS (SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount, l_extendedprice, l_linestatus, l_partkey, l_quantity, l_returnflag, l_shipdate, l_suppkey, l_tax) AS l_linenumber) FROM lineitem)
"""


def truth_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, line, x0, y0, x1, y1, cls_degrees): a box for every row."""
    li = _lineitem(spark, sf_dir)
    x, y = F.col("l_partkey") % 400, (F.col("l_suppkey") * 4) % 1000
    return li.select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("line"), x.cast("double").alias("x0"), y.cast("double").alias("y0"),
        (x + 40 + F.col("l_quantity")).alias("x1"), (y + 12 + F.col("l_suppkey") % 9).cast("double").alias("y1"), F.when(F.col("l_returnflag") == "R", 180).otherwise(0).alias("cls_degrees"),
    )


def predicted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, line, x0, y0, x1, y1, rotation): the boxes, moved a little."""
    li = _lineitem(spark, sf_dir)
    x, y = F.col("l_partkey") % 400 + F.col("l_suppkey") % 7, (F.col("l_suppkey") * 4) % 1000 + F.col("l_partkey") % 5
    return li.select(
        F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("line"), x.cast("double").alias("x0"), y.cast("double").alias("y0"),
        (x + 40 + F.col("l_quantity") + F.col("l_suppkey") % 3).alias("x1"), (y + 12 + F.col("l_suppkey") % 9).cast("double").alias("y1"),
        F.when(F.col("l_linestatus") == "O", 180).otherwise(0).alias("rotation"),
    )


BOXES = f"""{LINEITEM.strip()},
gt AS (SELECT l_orderkey AS image, l_linenumber AS line, (l_partkey % 400)::DOUBLE AS x0, ((l_suppkey * 4) % 1000)::DOUBLE AS y0, l_partkey % 400 + 40 + l_quantity AS x1,
              ((l_suppkey * 4) % 1000 + 12 + l_suppkey % 9)::DOUBLE AS y1, CASE WHEN l_returnflag = 'R' THEN 180 ELSE 0 END AS cls_degrees FROM li),
pr AS (SELECT l_orderkey AS image, l_linenumber AS line, (l_partkey % 400 + l_suppkey % 7)::DOUBLE AS x0, ((l_suppkey * 4) % 1000 + l_partkey % 5)::DOUBLE AS y0,
              l_partkey % 400 + l_suppkey % 7 + 40 + l_quantity + l_suppkey % 3 AS x1, ((l_suppkey * 4) % 1000 + l_partkey % 5 + 12 + l_suppkey % 9)::DOUBLE AS y1,
              CASE WHEN l_linestatus = 'O' THEN 180 ELSE 0 END AS rotation FROM li)
"""


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, line, x1, y1 ... x4, y4): slanted quads, some of them upright."""
    p = load(spark, sf_dir, "part")
    x, y, s = (F.col("p_partkey") % 300).cast("double"), (F.col("p_partkey") % 170).cast("double"), (F.col("p_size") % 9).cast("double")
    w = F.when(F.col("p_size") % 4 == 0, 10 + F.col("p_size") % 7).otherwise(60 + F.col("p_size")).cast("double")
    h = F.when(F.col("p_size") % 4 == 0, 50 + F.col("p_size")).otherwise(14 + F.col("p_size") % 11).cast("double")
    out = [x, y, x + w, y + s, x + w - s / 2, y + h + s, x - s / 2, y + h]
    return p.select((F.col("p_partkey") % 100).alias("image"), F.col("p_partkey").alias("line"), F.col("p_size").alias("size"), *(v.alias(n) for v, n in zip(out, ("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4"))))


QUADS = """
base AS (SELECT p_partkey % 100 AS image, p_partkey AS line, p_size AS size, (p_partkey % 300)::DOUBLE AS x, (p_partkey % 170)::DOUBLE AS y, (p_size % 9)::DOUBLE AS s,
                (CASE WHEN p_size % 4 = 0 THEN 10 + p_size % 7 ELSE 60 + p_size END)::DOUBLE AS w, (CASE WHEN p_size % 4 = 0 THEN 50 + p_size ELSE 14 + p_size % 11 END)::DOUBLE AS h FROM part),
q AS (SELECT image, line, size, x AS x1, y AS y1, x + w AS x2, y + s AS y2, x + w - s / 2 AS x3, y + h + s AS y3, x - s / 2 AS x4, y + h AS y4 FROM base)
"""


def bench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, file, seq, total_ms, lines, working_set_mb, stage_ms, operator_ms, conv_class_ms): events as timed pages, a run for each event type."""
    k, v = F.col("event_id"), F.col("value")
    return load(spark, sf_dir, "events").select(
        F.col("event_type").alias("run"), F.concat(F.lit("img-"), k.cast("string")).alias("file"), k.alias("seq"), v.alias("total_ms"), (k % 17).alias("lines"), (v * 2 + F.col("user_id")).alias("working_set_mb"),
        F.map_concat(F.create_map(F.lit("crop"), v / 2), F.when(k % 3 == 0, F.create_map(F.lit("zeta"), v / 4, F.lit("det_graph"), v / 8)).otherwise(F.create_map(F.lit("rec_graph"), v / 16))).alias("stage_ms"),
        F.create_map(F.concat(F.lit("op"), (k % 3).cast("string")), v).alias("operator_ms"), F.create_map(F.concat(F.lit("conv"), (k % 2).cast("string")), v).alias("conv_class_ms"),
    )


def bench_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, ws_loaded, ws_last): memory as a run's own record gives it; one kind of run has no last value."""
    e = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("run")).agg(F.min("value").alias("ws_loaded"), F.max("value").alias("ws_last"))
    return e.select("run", "ws_loaded", F.when(F.col("run") != "error", F.col("ws_last")).alias("ws_last"))


BENCH = """
br AS (SELECT event_type AS run, 'img-' || event_id AS file, event_id AS seq, value AS total_ms, event_id % 17 AS lines, value * 2 + user_id AS working_set_mb FROM events)
"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report line for each customer of a few: platform, case, replica, means and memory."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    return c.select(
        k.alias("run"), pick(["linux-x64", "Linux-X64", "win-x64", "osx-arm64"], k).alias("rid"), F.concat(F.lit("r"), k.cast("string")).alias("label"),
        pick(["tiny-4w", "small-4w", "medium-4w", "tiny", ""], k).alias("case_id"), F.floor(k / 20).alias("replica"), F.concat(F.lit("cpu"), (k % 2).cast("string")).alias("cpu_name"),
        pick(["sharp", "vulkan"], k).alias("engine"), pick(["tiny", "small", "medium", "a|b"], k).alias("model"), (k % 5).alias("workers"), F.col("c_acctbal").alias("mean"),
        (F.col("c_acctbal") / 2).alias("ws_loaded"), F.when(k % 7 > 0, F.col("c_acctbal") + 10).alias("ws_last"), F.when(k % 6 == 0, "0").alias("avx512"), F.when(k % 10 == 0, "0").alias("avx2"),
        F.when(k % 14 == 0, "0").alias("avx"), F.when(k % 22 == 0, "0").alias("hwintrinsic"), F.when(k % 26 == 0, ".NETStandard,Version=v2.0").alias("library"),
        F.when(k % 3 == 0, "Engine").when(k % 3 == 1, "other").alias("kind"), F.concat(F.lit("out"), F.when(k % 2 == 0, "-engines-").otherwise("-"), k.cast("string"), F.lit(".json")).alias("file_name"),
    )


RUNS_TABLE = """
rn AS (SELECT c_custkey AS run, ['linux-x64', 'Linux-X64', 'win-x64', 'osx-arm64'][c_custkey % 4 + 1] AS rid, 'r' || c_custkey AS label,
  ['tiny-4w', 'small-4w', 'medium-4w', 'tiny', ''][c_custkey % 5 + 1] AS case_id, c_custkey // 20 AS replica, 'cpu' || (c_custkey % 2) AS cpu_name,
  ['sharp', 'vulkan'][c_custkey % 2 + 1] AS engine, ['tiny', 'small', 'medium', 'a|b'][c_custkey % 4 + 1] AS model, c_custkey % 5 AS workers, c_acctbal AS mean,
  c_acctbal / 2 AS ws_loaded, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal + 10 END AS ws_last, CASE WHEN c_custkey % 6 = 0 THEN '0' END AS avx512, CASE WHEN c_custkey % 10 = 0 THEN '0' END AS avx2,
  CASE WHEN c_custkey % 14 = 0 THEN '0' END AS avx, CASE WHEN c_custkey % 22 = 0 THEN '0' END AS hwintrinsic, CASE WHEN c_custkey % 26 = 0 THEN '.NETStandard,Version=v2.0' END AS library,
  CASE WHEN c_custkey % 3 = 0 THEN 'Engine' WHEN c_custkey % 3 = 1 THEN 'other' END AS kind, 'out' || CASE WHEN c_custkey % 2 = 0 THEN '-engines-' ELSE '-' END || c_custkey || '.json' AS file_name FROM customer)
"""


def truth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line, text, cls_degrees): words of order lines as ground truth."""
    b = truth_boxes(spark, sf_dir)
    word = F.concat(F.lit("w"), (F.col("x0").cast("long") % 23).cast("string"), F.lit("-"), (F.col("y0").cast("long") % 5).cast("string"))
    return b.select(F.concat(F.lit("IMG-"), F.col("image").cast("string")).alias("file"), "line", word.alias("text"), "cls_degrees")


def predicted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = predicted_boxes(spark, sf_dir)
    word = F.concat(F.lit("w"), (F.col("x0").cast("long") % 23).cast("string"), F.lit("-"), (F.col("y0").cast("long") % 5).cast("string"))
    return b.select(F.concat(F.lit("img-"), F.col("image").cast("string")).alias("file"), "line", word.alias("text"), "rotation")


LINES = (
    BOXES
    + """,
tl AS (SELECT 'IMG-' || image AS file, line, 'w' || (x0::BIGINT % 23) || '-' || (y0::BIGINT % 5) AS text, cls_degrees FROM gt),
pl AS (SELECT 'img-' || image AS file, line, 'w' || (x0::BIGINT % 23) || '-' || (y0::BIGINT % 5) AS text, rotation FROM pr),
t AS (SELECT *, lower(file) AS f, row_number() OVER (PARTITION BY lower(file), text ORDER BY line) AS k FROM tl WHERE lower(file) IN (SELECT lower(file) FROM pl)),
p AS (SELECT *, lower(file) AS f, row_number() OVER (PARTITION BY lower(file), text ORDER BY line) AS k FROM pl),
em AS (SELECT t.file, t.line, t.text, t.f, length(t.text) AS chars, p.f IS NOT NULL AS exact FROM t LEFT JOIN p ON t.f = p.f AND t.text = p.text AND t.k = p.k),
best AS (SELECT em.f, em.line, min(levenshtein(em.text, p.text)) AS d FROM em JOIN p ON em.f = p.f WHERE NOT em.exact GROUP BY em.f, em.line),
le AS (SELECT em.*, CASE WHEN exact THEN 0 ELSE least(chars, coalesce(d, chars)) END AS errors FROM em LEFT JOIN best USING (f, line))
"""
)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, y, x, p): a small map of values for each user."""
    e = load(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.groupBy(F.col("user_id").alias("page"), (k % 11).alias("y"), (F.floor(k / 11) % 13).alias("x")).agg((F.max("value") / 500).alias("p"))


GRID = """
g AS (SELECT user_id AS page, event_id % 11 AS y, (event_id // 11) % 13 AS x, max(value) / 500 AS p FROM events GROUP BY 1, 2, 3)
"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, seq, r, g, b): colours of an order's lines."""
    li = _lineitem(spark, sf_dir)
    return li.select(F.col("l_suppkey").alias("image"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % 40).alias("r"), (F.col("l_quantity").cast("long") % 30).alias("g"), (F.col("l_partkey") % 251).alias("b"))


PIXELS = f"""{LINEITEM.strip()},
px AS (SELECT l_suppkey AS image, l_orderkey * 1000 + l_linenumber AS seq, l_partkey % 40 AS r, l_quantity::BIGINT % 30 AS g, l_partkey % 251 AS b FROM li)
"""


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, label), spread over the cluster: each row becomes a page of pixels, which is far more work than the row is bytes."""
    rows = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), "label")
    return rows.repartition(4 * spark.sparkContext.defaultParallelism, "page")


def patterns(spark: SparkSession, sf_dir: str, width, height, table: str = "nation", key: str = "n_nationkey") -> DataFrame:
    """(page, width, height, stride, pixel_format, data): a page of BGR pixels for each row of a small table; byte k is (7 k + 3 page) mod 256."""
    n = load(spark, sf_dir, table).select(F.col(key).cast("long").alias("page"))
    sized = n.select("page", width(F.col("page")).cast("int").alias("width"), height(F.col("page")).cast("int").alias("height"))
    byte = lambda k: F.lpad(F.hex((k * 7 + F.col("page") * 3) % 256), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") * 3 - 1), byte), ""))
    return sized.select("page", "width", "height", F.lit(0).alias("stride"), F.lit(0).alias("pixel_format"), data.alias("data"))


def vector_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, width, height, map_width, map_height, probability): maps of 40 x 40 with three bars each, their ends by the vector's label and number."""
    e = page_labels(spark, sf_dir)
    row, column = lambda k: F.floor(k / 40) % 13, lambda k: k % 40
    on = lambda k: (row(k) >= 3) & (row(k) < 9) & (column(k) >= F.col("label") + 2) & (column(k) <= F.col("page") % 7 + 30)
    cell = lambda k: F.when(on(k), 0.9).otherwise(0.05).cast("float")
    return e.select("page", *(F.lit(v).alias(n) for n, v in (("width", 80), ("height", 80), ("map_width", 40), ("map_height", 40))), F.transform(F.sequence(F.lit(0), F.lit(1599)), cell).alias("probability"))
