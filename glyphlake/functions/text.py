"""Text of pages, its hash, and formats of report cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of 64-bit FNV-1a.
FNV_START, FNV_PRIME = 14695981039346656037, 1099511628211


#: Texts that are hashed side by side, at least.
ABREAST = 24


def fnv1a(texts: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of each, byte by byte for all that are long enough; the few longest are finished one by one."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    joined = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
    starts = np.r_[0, lengths.cumsum()[:-1]].astype(np.int64) if len(order) else np.zeros(0, np.int64)
    h = np.full(len(order), FNV_START, np.uint64)
    at, live = 0, len(order)
    while live >= ABREAST:
        live = int(np.searchsorted(-lengths, -at, "left"))  # those longer than ``at``
        if live < ABREAST:
            break
        h[:live] = (h[:live] ^ joined[starts[:live] + at]) * np.uint64(FNV_PRIME)
        at += 1
    for k in range(min(live, len(order))):
        x = int(h[k])
        for byte in texts[order[k]][at:]:
            x = (x ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
        h[k] = x
    out = np.empty_like(h)
    out[order] = h
    return out


@F.pandas_udf(T.StringType())
def fnv1a_hex(text: pd.Series) -> pd.Series:
    """64-bit FNV-1a over UTF-8, 16 hex digits. JVM longs can't hold the unsigned products, so this is an Arrow function."""
    known = text.notna()
    out = pd.Series([None] * len(text), dtype=object)
    out[known.to_numpy()] = [f"{h:016x}" for h in fnv1a([s.encode() for s in text[known]]).tolist()]
    return out


def utf16_units(text: Column) -> Column:
    """The text with each character beyond 16 bits as two, one for each of its UTF-16 units, so that lengths and edit distances count units."""
    spaced = F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), "(.{4})", "0000$1 ")
    # Surrogates can't stand alone in a text; their places in a private plane can.
    wide = F.regexp_replace(spaced, "0000(D[89A-F][0-9A-F]{2}) ", "000F$1 ")
    return F.when(text.rlike("[\\x{10000}-\\x{10FFFF}]"), F.decode(F.unhex(F.replace(wide, F.lit(" "), F.lit(""))), "UTF-32")).otherwise(text)


def page_text(lines: DataFrame, page: str = "page", line: str = "line_no", text: str = "text") -> DataFrame:
    """(page, text, packed_text): lines joined by line breaks, and each line followed by NUL."""
    ordered = lines.groupBy(page).agg(F.array_sort(F.collect_list(F.struct(F.col(line).alias("n"), F.coalesce(text, F.lit("")).alias("t")))).alias("_lines"))
    texts = F.transform("_lines", lambda x: x["t"])
    packed = F.array_join(F.transform("_lines", lambda x: F.concat(x["t"], F.lit("\x00"))), "")
    return ordered.select(page, F.array_join(texts, "\n").alias("text"), packed.alias("packed_text"))


def ascii_fold(text: Column) -> Column:
    return F.regexp_replace(text, "[^ -~]", "?")


def simd_suffix(library: Column, hwintrinsic: Column, avx: Column, avx2: Column, avx512: Column) -> Column:
    """What a run had switched off, the strongest first; off is the string 0."""
    off = lambda c: c == "0"
    return F.coalesce(
        F.when(F.lower(library).contains("netstandard"), "ns2"),
        F.when(off(hwintrinsic), "scalar"),
        F.when(off(avx), "noavx"),
        F.when(off(avx2), "noavx2"),
        F.when(off(avx512), "noavx512"),
        F.lit(""),
    )


def run_label(rid: Column, engine: Column, model: Column, workers: Column, simd: Column) -> Column:
    """``rid engine model 4w simd``; null if neither rid nor model is known."""
    extra = F.when(simd == "", "").otherwise(F.concat(F.lit(" "), simd))
    label = F.trim(F.concat(rid, F.lit(" "), engine, F.lit(" "), model, F.lit(" "), F.coalesce(workers.cast("string"), F.lit("")), F.lit("w"), extra))
    return F.when((rid == "") & (model == ""), None).otherwise(label)


def simd_rank(simd: Column) -> Column:
    return F.when(simd.isin("", "default"), 0).when(simd == "noavx512", 1).when(simd == "noavx2", 2).when(simd == "noavx", 3).when(simd == "ns2", 4).when(simd.isin("scalar", "nohw"), 5).otherwise(6)


def model_rank(model: Column) -> Column:
    return F.when(model == "medium", 0).when(model == "small", 1).when(model == "tiny", 2).otherwise(3)


def benchmark_kind(kind: Column, file_name: Column) -> Column:
    """The given kind if it is one of the two, else by the file's name."""
    given = F.lower(kind)
    return F.when(given.isin("simd", "engine"), given).when(F.lower(file_name).contains("-engines-"), "engine").otherwise("simd")


NONE = "—"


def percent(value: Column) -> Column:
    return F.when(value.isNull(), NONE).otherwise(F.concat(F.format_string("%.2f", value * 100), F.lit("%")))


def megabytes(value: Column) -> Column:
    return F.when(value.isNull(), NONE).otherwise(F.format_string("%.1f", value))


def fraction(part: Column, whole: Column) -> Column:
    return F.when(part.isNull() | whole.isNull(), NONE).otherwise(F.concat(part.cast("string"), F.lit("/"), whole.cast("string")))


def cell(value: Column) -> Column:
    """A Markdown table cell: bars are escaped."""
    return F.replace(F.coalesce(value, F.lit("")), F.lit("|"), F.lit("\\|"))
