"""Benchmark results, ground truth and dictionaries: reading and writing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas as DDL; reading parses them, so that importing needs no session.
ROW = (
    "file string, width int, height int, warmup boolean, total_ms double, stage_ms map<string,double>, stage_calls map<string,bigint>, "
    "operator_ms map<string,string>, conv_class_ms map<string,string>, detected int, lines int, hash string, texts array<string>, "
    "rotations array<int>, boxes array<array<double>>, working_set_mb double"
)
TRUTH = (
    "version int, seed int, images array<struct<file:string,width:int,height:int,background_rgb:array<int>,sha256:string,"
    "lines:array<struct<text:string,bbox:array<int>,natural_width_at_height_48:int,angle_degrees:double,orientation_degrees:double,"
    "cls_degrees:int,font:string,font_size:int,color_rgb:array<int>>>>>"
)
#: Names under which meta values are found, by column.
META = {
    "rid": "rid", "engine": "mode", "model": "model", "case_id": "caseId", "kind": "benchmarkKind", "workers": "workers", "replica": "replica",
    "library": "libraryTfm", "hwintrinsic": "hwintrinsic", "avx": "avx", "avx2": "avx2", "avx512": "avx512", "cpu_name": "cpuName",
    "effective_isa": "effectiveIsa", "ws_loaded": "working_set_mb_loaded", "ws_last": "working_set_mb_last", "ws_peak": "working_set_mb_peak",
}


def _colons(ddl: str) -> str:
    """Fields of a table's DDL as those of a struct: ``a int, b int`` as ``a:int,b:int``."""
    return ",".join(":".join(field.split(" ", 1)) for field in ddl.split(", "))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(path, meta, summary, seq, row): a line for each row of each result file below ``path``.

    A file is {meta, summary, rows} or, as older ones are, a bare array of
    rows. Files that don't parse are skipped; none at all is an error.
    """
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    raw = text.select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("value"))
    wrapped = F.from_json("value", "meta string, summary string, rows string")
    legacy = F.col("value").startswith("[")
    parts = raw.select("path", F.when(~legacy, wrapped).alias("d"), F.when(legacy, F.col("value")).alias("bare"))
    rows = F.from_json(F.coalesce("d.rows", "bare"), f"array<struct<{_colons(ROW)}>>")
    out = parts.select("path", F.col("d.meta").alias("meta"), F.col("d.summary").alias("summary"), rows.alias("rows")).filter("rows is not null")
    if out.isEmpty():
        raise FileNotFoundError(f"no readable result below {path}")
    return out.select("path", "meta", "summary", F.posexplode("rows").alias("seq", "row"))


def meta_columns(results: DataFrame) -> DataFrame:
    """Results with the meta values of META as text columns."""
    return results.select("*", *(F.get_json_object("meta", f"$.{v}").alias(k) for k, v in META.items()))


def write_results(document: DataFrame, path: str) -> None:
    """Result documents (meta, summary, rows), each a JSON file of its own."""
    document.write.mode("overwrite").option("maxRecordsPerFile", 1).json(path)


def read_truth(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """(file, line, text, x0, y0, x1, y1, cls_degrees, ...) of ground truth files; files are keyed without case.

    cls_degrees must be 0 or 180; the lenient form takes a missing one as 0.
    """
    images = spark.read.option("multiLine", True).schema(TRUTH).json(path).select(F.explode("images").alias("i"))
    lines = images.select(F.lower("i.file").alias("file"), "i.width", "i.height", F.posexplode("i.lines").alias("line", "l"))
    return lines.select("file", "width", "height", "line", "l.text", *(F.get("l.bbox", k).alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))), checked_degrees(F.col("l.cls_degrees"), lenient).alias("cls_degrees"))


def checked_degrees(degrees: Column, lenient: bool = False) -> Column:
    known = F.coalesce(degrees, F.lit(0)) if lenient else degrees
    return F.when(known.isin(0, 180), known).otherwise(F.raise_error(F.lit("cls_degrees must be 0 or 180")).cast("int"))


def parse_dictionary(data: bytes) -> list[str]:
    """Labels of a dictionary file: strict UTF-8, a leading mark and line ends taken off, the last empty line dropped."""
    lines = data.decode("utf-8", "strict").removeprefix("﻿").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    labels = [x[:-1] if x.endswith("\r") else x for x in lines]
    if not any(labels):
        raise ValueError("the dictionary has no labels")
    return labels


def dictionary_table(spark: SparkSession, labels: list[str]) -> DataFrame:
    """(cls, label): blank 0, labels from 1, the space last."""
    return spark.createDataFrame([(0, ""), *enumerate([*labels, " "], 1)], "cls int, label string")


#: Pages of the generated set, and the file that tells it from other folders.
GENERATED, METADATA = 100, "metadata.json"


def scan_images(spark: SparkSession, folder: str, count: int | None = None) -> DataFrame:
    """Image files of a folder by name without case; ``count`` is a limit on the ordered list.

    A folder with metadata.json is a generated set: its ``img-*.jpg`` must be
    100. Of any other folder it's all ``*.jpg``; none is an error.
    """
    files = spark.read.format("binaryFile").load(folder).select("path", "modificationTime", "length")
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select(name.alias("name")).filter(F.lower("name").endswith(".jpg") | (F.col("name") == METADATA))
    generated, numbered, pictures = found.agg(
        F.count(F.when(F.col("name") == METADATA, 1)), F.count(F.when(F.col("name").like("img-%.jpg"), 1)), F.count(F.when(F.col("name").like("%.jpg"), 1))
    ).first()
    if generated and numbered != GENERATED:
        raise ValueError(f"a generated set has {GENERATED} pages, not {numbered}")
    if not pictures:
        raise FileNotFoundError(f"no *.jpg in {folder}")
    images = spark.read.format("binaryFile").option("pathGlobFilter", "img-*.jpg" if generated else "*.jpg").load(folder)
    ordered = images.orderBy(F.lower("path"), "path")
    return ordered if count is None else ordered.limit(count)


def decode_images(spark: SparkSession, folder: str) -> DataFrame:
    """(page, path, width, height, stride, pixel_format, data) of images, packed BGR, without EXIF rotation; read_lines() takes them.

    Pages are numbered by path's hash. Grey images, one channel, become three
    equal ones; four channels are BGRA; others are an error.
    """
    images = spark.read.format("image").option("dropInvalid", True).load(folder).select("image.*")
    channels = F.col("nChannels")
    kind = F.when(channels.isin(1, 3), 0).when(channels == 4, 2).otherwise(F.raise_error(F.concat(F.lit("an image of channels: "), channels.cast("string"))).cast("int"))
    grey = F.unhex(F.regexp_replace(F.hex("data"), "(..)", "$1$1$1"))
    stride = F.col("width") * F.when(channels == 1, 3).otherwise(channels)
    return images.select(F.xxhash64("origin").alias("page"), F.col("origin").alias("path"), "width", "height", stride.alias("stride"), kind.alias("pixel_format"), F.when(channels == 1, grey).otherwise(F.col("data")).alias("data"))


def response_json(pages: DataFrame) -> DataFrame:
    """A JSON answer for each page (text, model, elapsed struct<decode,ocr,total>, lines) of recognised lines.

    ``lines``: an array of structs with text, score, x1 ... y4, box_score,
    label_score, rotation and, where characters were asked for, ``characters``
    of (text, score, x1 ... y4); left out where null.
    """
    corners = lambda x: F.array(*(F.array(x[f"x{k}"], x[f"y{k}"]) for k in range(1, 5)))
    kind = pages.schema["lines"].dataType.elementType
    sign = lambda c: F.struct(c["text"].alias("text"), c["score"].alias("score"), corners(c).alias("box"))

    def line(x: Column) -> Column:
        shown = {"text": x["text"], "recognitionScore": x["score"], "box": corners(x), "detectionScore": x["box_score"], "classificationScore": x["label_score"], "appliedRotationDegrees": x["rotation"]}
        if "characters" in kind.names:
            shown["characters"] = F.transform(x["characters"], sign)
        return F.struct(*(v.alias(k) for k, v in shown.items()))

    answer = F.struct(F.col("text").alias("text"), F.size("lines").alias("detectedCount"), F.col("model").alias("model"), F.col("elapsed").alias("elapsedMs"), F.transform("lines", line).alias("lines"))
    return pages.select(F.to_json(answer).alias("json"))


def check_request(length: int, width: int, height: int, model: str) -> None:
    """Limits of a request: 20 MB, 40 million pixels, a known model."""
    if length > 20 << 20 or width * height > 40_000_000 or not re.fullmatch("tiny|small|medium", model):
        raise ValueError("request out of limits")
