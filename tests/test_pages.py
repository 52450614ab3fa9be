import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.functions import geometry, sizing
from glyphlake.functions.text import fnv1a_hex, page_text
from glyphlake.operators import dbpost, evaluate, imageops, models, raster, report
from glyphlake.sources import bench, generate


def test_rotation_orders():
    rows = np.arange(6, dtype=np.uint8).reshape(2, 3)[..., None].repeat(3, 2)
    padded = b"".join(r.tobytes() + b"\xff" * 4 for r in rows)
    image = imageops.pixels(padded, 3, 2, 13)
    want = {0: "012345", 90: "251403", 180: "543210", 270: "304152"}
    for degrees, order in want.items():
        assert "".join(map(str, imageops.rotate(image, degrees)[..., 0].ravel())) == order
    with pytest.raises(ValueError):
        imageops.rotate(image, 45)


@pytest.mark.parametrize("kind", [0, 1, 2, 3])
def test_formats_give_the_same_pixels(kind):
    rng = np.random.default_rng(1)
    for w, h in ((37, 29), (41, 23), (53, 17), (120, 20)):
        bgr = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        packed = bgr[:, :, ::-1] if kind in (1, 3) else bgr
        if kind > 1:
            packed = np.concatenate([packed, rng.integers(0, 256, (h, w, 1), dtype=np.uint8)], 2)
        stride = w * 4 + 16
        data = b"".join(r.tobytes().ljust(stride, b"\0") for r in packed)
        assert (imageops.pixels(data, w, h, stride, kind) == bgr).all()
    with pytest.raises(ValueError):
        imageops.pixels(b"123", 2, 2)


def test_inputs_have_their_shapes_and_windows():
    image = np.random.default_rng(2).integers(0, 256, (20, 120, 3), dtype=np.uint8)
    assert imageops.detector_input(image).shape == (3, 32, 128)
    assert imageops.detector_input(image[:10, :10]).shape == (3, 32, 32)
    other = image.copy()
    other[:, 80:] = 0
    assert (imageops.classifier_input(image) == imageops.classifier_input(other)).all()
    line = imageops.recogniser_input(image, 320)
    assert line.shape == (3, 48, 320) and (line[:, :, 288:] == 0).all()
    assert imageops.orientation_input(np.zeros((19, 17, 3), np.uint8)).shape == (3, 224, 224)


#: Fixed values: (channel, x, y, value) of the page classifier's input for the pattern below.
SAMPLES = [
    (0, 0, 0, -0.6109256744384766),
    (0, 16, 0, 0.6905555725097656),
    (0, 112, 0, -0.3369295597076416),
    (0, 222, 0, -0.49105238914489746),
    (1, 0, 0, 1.0280113220214844),
    (1, 16, 0, 0.8179271221160889),
    (1, 112, 0, -0.8627451658248901),
    (1, 222, 0, -0.10994398593902588),
    (2, 0, 0, 0.600784182548523),
    (2, 16, 0, 0.39163386821746826),
    (2, 112, 0, 0.4787799119949341),
    (2, 222, 0, 0.6705011129379272),
]


def test_page_input_agrees_with_known_samples():
    pattern = ((np.arange(17 * 19 * 3) * 37 + 11) % 256).astype(np.uint8).reshape(19, 17, 3)
    tensor = imageops.orientation_input(pattern)
    for channel, x, y, value in SAMPLES:
        assert tensor[channel, y, x] == pytest.approx(value, abs=3e-7)


def test_crop_of_an_axis_aligned_quad_is_the_region():
    image = np.random.default_rng(3).integers(0, 256, (40, 60, 3), dtype=np.uint8)
    assert (imageops.crop(image, [5, 4, 35, 4, 35, 20, 5, 20]) == image[4:20, 5:35]).all()
    tall = imageops.crop(image, [5, 4, 15, 4, 15, 34, 5, 34])
    assert tall.shape == (10, 30, 3) and (tall == np.rot90(image[4:34, 5:15], -1)).all()
    whole = imageops.crop(image, [4, 5, 43, 6, 42, 31, 5, 30])
    bands = [imageops.crop(image, [4, 5, 43, 6, 42, 31, 5, 30], (a, min(a + 8, whole.shape[0]))) for a in range(0, whole.shape[0], 8)]
    assert (np.concatenate(bands) == whole).all()


def flood(mask, diagonal):
    h, w = mask.shape
    labels, n = np.zeros((h, w), int), 0
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if diagonal else [])
    for y in range(h):
        for x in range(w):
            if mask[y, x] and not labels[y, x]:
                n += 1
                stack = [(y, x)]
                labels[y, x] = n
                while stack:
                    a, b = stack.pop()
                    for dy, dx in steps:
                        c, d = a + dy, b + dx
                        if 0 <= c < h and 0 <= d < w and mask[c, d] and not labels[c, d]:
                            labels[c, d] = n
                            stack.append((c, d))
    return labels, n


@pytest.mark.parametrize("diagonal", [True, False])
def test_regions_equal_a_flood_fill(diagonal):
    rng = np.random.default_rng(4)
    for share in (0.2, 0.5, 0.7):
        mask = rng.random((23, 31)) < share
        got, n = raster.label_regions(mask, diagonal)
        want, m = flood(mask, diagonal)
        assert n == m and (got == want).all()


def test_holes_are_entered_once_for_each_neighbour():
    ring = np.zeros((9, 9), bool)
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    holes = raster.hole_contours(ring)
    assert len(holes) == 1 and holes[0].tolist() == [[4, 4]] * 4
    assert len(raster.foreground_contours(ring)) == 1


def test_pixel_tables_agree_with_numpy(spark):
    mask = np.random.default_rng(5).random((12, 14)) < 0.6
    on = spark.createDataFrame([(1, int(y), int(x)) for y, x in zip(*np.nonzero(mask))], "page long, y int, x int")
    edge = {(r.y, r.x) for r in raster.boundary_pixels(on).filter("boundary").collect()}
    assert edge == set(zip(*map(list, np.nonzero(raster.boundary(mask)))))
    grown = {(r.y, r.x) for r in raster.dilate_pixels(on).collect()}
    assert grown == set(zip(*map(list, np.nonzero(raster.dilate(mask)))))


def test_bad_maps_are_refused(spark):
    with pytest.raises(ValueError):
        raster.threshold_map(np.array([[0.1, np.nan]], np.float32))
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([([0.1, float("nan")],)], "p array<float>").select(raster.binarize(F.col("p"))).collect()


def test_polygon_score_counts_inside_and_edges():
    p = np.zeros((20, 20), np.float32)
    p[5:11, 4:13] = 1
    square = np.array([[4, 5], [12, 5], [12, 10], [4, 10]], np.float32)
    assert raster.polygon_score(p, square) == 1.0
    assert raster.polygon_score(p, square + np.float32([1, 0])) == pytest.approx(8 / 9)
    tip = np.array([[10, 2], [18, 10], [10, 18], [2, 10]], np.float32)
    assert 0 < raster.polygon_score(p, tip) < 1


def test_minimum_rectangle_and_order():
    rect = dbpost.minimum_rectangle(np.array([[0, 0], [10, 0], [10, 4], [0, 4], [5, 2]]))
    assert rect.tolist() == [[0, 0], [10, 0], [10, 4], [0, 4]]
    assert dbpost.minimum_rectangle(np.array([[0, 0], [1, 1], [2, 2]])) is None
    tip = dbpost.order_clockwise(np.array([[5, 0], [10, 5], [5, 10], [0, 5]]))
    assert tip.tolist() == [[5, 0], [10, 5], [5, 10], [0, 5]]


def test_order_clockwise_forms_agree(spark):
    rng = np.random.default_rng(6)
    quads = [rng.permutation(np.array([[x, y], [x + w, y + s], [x + w - s, y + h + s], [x - s, y + h]])).ravel().tolist() for x, y, w, h, s in rng.integers(1, 40, (60, 5)).astype(float)]
    quads += [[5.0, 0.0, 10.0, 5.0, 5.0, 10.0, 0.0, 5.0], [10.0, 5.0, 5.0, 10.0, 0.0, 5.0, 5.0, 0.0]]
    df = spark.createDataFrame([(i, *q) for i, q in enumerate(quads)], "i long, " + ", ".join(f"{p} double" for p in geometry.POINTS))
    out = geometry.order_clockwise([F.col(p) for p in geometry.POINTS])
    for r in df.select("i", *(c.alias(f"o{k}") for k, c in enumerate(out))).collect():
        assert list(r[1:]) == dbpost.order_clockwise(np.array(quads[r.i]).reshape(4, 2)).ravel().tolist()


def test_unclip_of_a_box():
    grown = dbpost.unclip(np.array([[10, 10], [110, 10], [110, 30], [10, 30]]), 1.4)
    d = 100 * 20 * 1.4 / 240
    assert grown[:, 0].min() == round(10 - d) and grown[:, 1].max() == round(30 + d)


def inside(p, polygon):
    """Whether a point is in a convex polygon, in either direction."""
    turns = [(b - a)[0] * (p - a)[1] - (b - a)[1] * (p - a)[0] for a, b in zip(polygon, np.roll(polygon, -1, 0))]
    return min(turns) >= -1e-9 or max(turns) <= 1e-9


@pytest.mark.parametrize("d", [0.2, 1.0, 6.3, 47.0])
def test_offset_is_the_polygon_and_a_disc(d):
    rng = np.random.default_rng(12)
    for _ in range(20):
        x, y, w, h = rng.integers(0, 400, 4) + [0, 0, 60, 12]
        angle = rng.uniform(0, 2 * np.pi)
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        box = np.rint(np.array([[0, 0], [w, 0], [w, h], [0, h]]) @ turn.T + [x, y])
        if rng.random() < 0.5:
            box = box[::-1]
        grown = dbpost.offset(box, d)
        assert (grown == np.rint(grown)).all()
        # Every vertex is about d away from the box, and so is every point on the way.
        for p in np.concatenate([grown, (grown + np.roll(grown, -1, 0)) / 2]):
            edges = [(a, b) for a, b in zip(box, np.roll(box, -1, 0))]
            gap = min(np.linalg.norm(p - (a + np.clip(np.dot(p - a, b - a) / max(1e-9, np.dot(b - a, b - a)), 0, 1) * (b - a))) for a, b in edges)
            assert abs(gap - d) < 1.3
        assert all(inside(c, grown) for c in box) or d < 2  # rounding may dent a narrow rim


def test_offset_of_few_corners_and_of_repeats():
    assert len(dbpost.offset(np.array([[0, 0], [5, 0], [5, 0], [0.2, 0.1]]), 3)) == 0
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    assert (dbpost.offset(np.concatenate([square, square[:1]]), 3) == dbpost.offset(square, 3)).all()
    assert dbpost.whole(np.array([-2.5, -0.4, 0.5, 1.5])).tolist() == [-3, 0, 1, 2]
    dent = np.array([[0, 0], [40, 0], [40, 40], [20, 8], [0, 40]], float)
    assert [20, 8] in dbpost.offset(dent, 4).tolist()


def test_parallelograms_have_a_perspective_without_area(spark):
    flat = [0, 0, 10, 0, 12, 0, 2, 0]
    width, height, _, m = imageops.perspective([0, 0, 30, 6, 28, 16, -2, 10])
    assert (width, height, m[2].tolist()) == (30, 10, [0, 0, 1])
    p = geometry.Perspective.of([F.lit(float(v)) for v in flat])
    row = spark.range(1).select(p.valid.alias("valid"), p.g.alias("g"), p.h.alias("h"), p.map(F.lit(1.0), F.lit(0.5))[0].alias("x")).first()
    assert (row.valid, row.g, row.h, row.x) == (True, 0.0, 0.0, 11.0)
    bent = geometry.Perspective.of([F.lit(float(v)) for v in (0, 0, 10, 0, 20, 0, 5, 0)])
    assert spark.range(1).select(F.coalesce(bent.valid, F.lit(False)).alias("v")).first().v is False


def plain_warp(image, quad):
    """Bicubic sampling, a pixel and a tap at a time."""
    width, height, vertical, m = imageops.perspective(quad)

    def weight(t):
        t = abs(t)
        return (1.25 * t - 2.25) * t * t + 1 if t <= 1 else ((-0.75 * t + 3.75) * t - 6) * t + 3 if t < 2 else 0.0

    out = np.zeros((height, width, 3), np.uint8)
    for v in range(height):
        for u in range(width):
            x, y, z = m @ [u / width, v / height, 1]
            x, y = x / z, y / z
            total = np.zeros(3)
            for j in range(int(np.floor(y)) - 1, int(np.floor(y)) + 3):
                for i in range(int(np.floor(x)) - 1, int(np.floor(x)) + 3):
                    total += weight(x - i) * weight(y - j) * image[min(max(j, 0), image.shape[0] - 1), min(max(i, 0), image.shape[1] - 1)]
            out[v, u] = np.clip(np.floor(total + 0.5), 0, 255)
    return np.rot90(out, -1) if vertical else out


@pytest.mark.parametrize("quad", [[4, 5, 43, 6, 42, 17, 5, 16], [10, 3, 21, 9, 12, 36, 2, 30], [-3, -2, 30, 4, 26, 20, -4, 11]])
def test_slanted_crops_equal_sampling_pixel_by_pixel(quad):
    image = np.random.default_rng(9).integers(0, 256, (40, 48, 3), dtype=np.uint8)
    got, want = imageops.crop(image, quad), plain_warp(image, quad)
    assert got.shape == want.shape and np.abs(got.astype(int) - want).max() <= 1 and (got == want).mean() > 0.999


def test_guards_of_sizes_and_options(monkeypatch):
    monkeypatch.setattr(imageops, "MAX_CROP_PIXELS", 100)
    with pytest.raises(ValueError, match="crop"):
        imageops.crop(np.zeros((40, 40, 3), np.uint8), [0, 0, 30, 0, 30, 10, 0, 10])
    monkeypatch.setattr(imageops, "MAX_IMAGE_PIXELS", 100)
    with pytest.raises(ValueError, match="page"):
        imageops.pixels(b"\0" * 3000, 100, 10)
    for bad in ({"limit": 16}, {"limit": 5000}, {"max_candidates": 0}, {"bitmap_threshold": 1.5}):
        with pytest.raises(ValueError):
            dbpost.Options(**bad)
    blank = np.zeros((32, 32, 3), np.uint8)
    for bad in ((1.5, 4), (0.0, 0)):
        with pytest.raises(ValueError):
            models.lines_of(blank, models.StubModels(), dbpost.Options(), *bad)


def test_batches_don_t_change_what_is_read():
    rng = np.random.default_rng(3)
    image = np.full((200, 160, 3), 10, np.uint8)
    for y in range(8, 190, 26):
        image[y : y + 12, 10 : 60 + int(rng.integers(0, 90))] = 250
    one, many = (models.lines_of(image, models.StubModels(), dbpost.Options(), 0.0, n) for n in (1, 16))
    assert len(one) > 4 and one == many


def test_reading_order_is_not_transitive(spark):
    corner = lambda x, y: (np.array([[x, y]]), (x, y))
    assert [b[1] for b in dbpost.reading_order([corner(30, 0), corner(20, 8), corner(10, 16)])] == [(20, 8), (30, 0), (10, 16)]
    assert [b[1] for b in dbpost.reading_order([corner(20, 8), corner(10, 16)])] == [(10, 16), (20, 8)]
    rng = random.Random(7)
    rows = [(p, i, float(rng.randrange(100)), float(rng.randrange(60))) for p in range(30) for i in range(25)]
    got = dbpost.sort_reading_order(spark.createDataFrame(rows, "page long, line_no int, x1 double, y1 double")).collect()
    for p in range(30):
        own = sorted((r for r in got if r.page == p), key=lambda r: r.place)
        want = dbpost.reading_order([corner(x, y) for q, _, x, y in sorted(rows, key=lambda r: (r[3], r[2], r[1])) if q == p])
        assert [(r.x1, r.y1) for r in own] == [b[1] for b in want]


def test_detect_two_bars(spark):
    p = np.full((64, 96), 0.01, np.float32)
    p[10:20, 10:70] = 0.9
    p[34:44, 30:90] = 0.9
    boxes = dbpost.detect_boxes(p, 192, 128)
    assert len(boxes) == 2 and all(s == pytest.approx(0.9) for _, s in boxes)
    assert boxes[0][0][0, 1] < boxes[1][0][0, 1] and boxes[0][0][:, 0].min() < 20
    assert dbpost.detect_boxes(np.zeros((32, 32)), 32, 32) == []
    assert dbpost.Options.for_channels(16).box_threshold == 0.4 and dbpost.Options.for_channels(16, box_threshold=0.6).box_threshold == 0.6
    with pytest.raises(ValueError):
        dbpost.Options(unclip_ratio=11)


def brute_greedy(pairs):
    used_g, used_p, out = set(), set(), []
    for image, g, p, o in sorted(pairs, key=lambda r: (-r[3], r[1], r[2])):
        if (image, g) not in used_g and (image, p) not in used_p:
            used_g.add((image, g))
            used_p.add((image, p))
            out.append((image, g, p, o))
    return sorted(out)


def test_greedy_assignment(spark):
    rng = random.Random(9)
    pairs = [(i, g, p, rng.choice([0.3, 0.5, 0.8])) for i in range(20) for g in range(6) for p in range(6) if rng.random() < 0.5]
    got = evaluate.greedy_assignment(spark.createDataFrame(pairs, "image long, gi int, pi int, iou double"))
    assert sorted(tuple(r) for r in got.collect()) == brute_greedy(pairs)


def test_line_errors_use_all_predictions_but_consume_exact_ones(spark):
    truth = spark.createDataFrame([("A.jpg", 0, "abc", 0), ("A.jpg", 1, "abc", 0), ("A.jpg", 2, "xyz", 0), ("none.jpg", 0, "q", 0)], "file string, line int, text string, cls_degrees int")
    predicted = spark.createDataFrame([("a.JPG", 0, "abc", 0), ("a.JPG", 1, "abd", 0), ("b.jpg", 0, "z", 0)], "file string, line int, text string, rotation int")
    rows = {r.line: r for r in evaluate.line_errors(truth, predicted).collect()}
    assert len(rows) == 3 and [(rows[i].exact, rows[i].errors) for i in range(3)] == [(True, 0), (False, 0), (False, 3)]
    total = evaluate.accuracy(evaluate.line_errors(truth, predicted)).first()
    assert (total.exact_lines, total.total_lines, total.exact_img, total.cer) == (1, 3, 0, pytest.approx(3 / 9))


def test_percentile_rules_differ(spark):
    picks = {"a": "p95_rounded", "b": "p95_ceiling", "c": "upper_median", "d": "lower_median"}
    for n in (1, 2, 7, 99, 100):
        rows = spark.range(1, n + 1).selectExpr("double(id) as v", "1 as k").unionByName(spark.createDataFrame([(None, 1)], "v double, k int"))
        r = evaluate.ranked(rows, ["k"], "v", picks).first()
        assert (r.a, r.b, r.c, r.d) == (min(n - 1, int(0.95 * (n - 1) + 0.5)) + 1, max(1, -(-95 * n // 100)), n // 2 + 1, (n - 1) // 2 + 1)
        assert rows.groupBy("k").agg(evaluate.upper_median(F.col("v")).alias("c")).first().c == r.c


def test_worker_formulas_and_errors(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(sizing.line_workers(F.lit(0), F.lit(8))) == 4 and pick(sizing.line_workers(F.lit(64), F.lit(32))) == 16
    assert pick(sizing.crop_workers(F.lit(4), F.lit(32))) == 16 and pick(sizing.recogniser_threads(F.lit(32), F.lit(2))) == 8
    for bad in (sizing.stride(F.lit(5), F.lit(10), F.lit(0)), sizing.drawn_degrees(F.lit(45)), sizing.checked_pixels(F.lit(10_000), F.lit(10_000)), sizing.bytes_per_pixel(F.lit(7))):
        with pytest.raises(Exception):
            pick(bad)


def test_to_source(spark):
    pts = [(1, 2), (5, 2), (5, 4), (1, 4)]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in pts], "x double, y double")
    sx, sy = geometry.to_source(F.col("x"), F.col("y"), F.lit(20), F.lit(10), F.lit(90))
    assert [tuple(r) for r in df.select(sx, sy).collect()] == [(17, 1), (17, 5), (15, 5), (15, 1)]


def test_hash_and_page_text(spark):
    lines = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, None)], "page long, line_no int, text string")
    rows = {r.page: r for r in page_text(lines).withColumn("h", fnv1a_hex("packed_text")).collect()}
    assert rows[1].text == "a\nb" and rows[1].packed_text == "a\x00b\x00"
    h = 14695981039346656037
    for byte in b"a\x00b\x00":
        h = (h ^ byte) * 1099511628211 % 2**64
    assert rows[1].h == f"{h:016x}"


def test_results_and_truth(spark, tmp_path):
    row = {"file": "a.jpg", "width": 4, "height": 3, "warmup": False, "total_ms": 5.5, "stage_ms": {"crop": 1.0}, "operator_ms": {"x": {"ms": 2.5, "calls": 1}, "y": 3.5}, "lines": 1, "texts": ["t"], "rotations": [0]}
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.json").write_text(json.dumps({"meta": {"rid": "r1", "mode": "sharp", "workers": 4}, "rows": [row, row]}))
    (tmp_path / "sub" / "two.json").write_text(json.dumps([row]))
    (tmp_path / "bad.json").write_text("{not json")
    got = bench.meta_columns(bench.read_results(spark, str(tmp_path)))
    assert got.count() == 3 and got.filter("rid = 'r1'").count() == 2
    metrics = got.select(F.explode("row.operator_ms").alias("k", "v")).select("k", evaluate.metric_value(F.col("v")).alias("ms"))
    assert {(r.k, r.ms) for r in metrics.collect()} == {("x", 2.5), ("y", 3.5)}
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        (tmp_path / "none" / "x.json").write_text("no")
        bench.read_results(spark, str(tmp_path / "none"))
    truth = {"version": 1, "images": [{"file": "IMG.jpg", "width": 9, "height": 9, "lines": [{"text": "t", "bbox": [0, 1, 2, 3], "cls_degrees": 180}, {"text": "u", "bbox": [0, 1, 2, 3]}]}]}
    (tmp_path / "metadata.json").write_text(json.dumps(truth))
    path = str(tmp_path / "metadata.json")
    assert [r.cls_degrees for r in bench.read_truth(spark, path, lenient=True).orderBy("line").collect()] == [180, 0]
    with pytest.raises(Exception, match="cls_degrees"):
        bench.read_truth(spark, path).collect()


def test_dictionary():
    assert bench.parse_dictionary("﻿a\r\nb\n".encode()) == ["a", "b"]
    for bad in (b"\n\n", b"\xff\xfe"):
        with pytest.raises(ValueError):
            bench.parse_dictionary(bad)


def test_generated_pages_don_t_overlap(spark):
    lines = generate.pages(spark, 12)
    again = generate.pages(spark, 12)
    assert lines.exceptAll(again).count() == 0
    boxes = {}
    for r in lines.collect():
        assert r.cls_degrees in (0, 180) and 0 <= r.x0 < r.x1 <= r.width and 0 <= r.y0 < r.y1 <= r.height
        for a in boxes.setdefault(r.file, []):
            assert r.x1 + 2 <= a.x0 - 0 or a.x1 <= r.x0 or r.y1 <= a.y0 or a.y1 <= r.y0
        boxes[r.file].append(r)


def test_recognise_with_a_stub(spark):
    pages = models.synthetic_pages(spark.createDataFrame([(1, 0), (2, 9)], "page long, label int"))
    rows = models.recognise(pages, models.StubModels()).collect()
    assert {r.page for r in rows} == {1, 2} and all(r.emitted > 0 and r.target_width % 32 == 0 for r in rows)
    four = models.page_orientation(pages, lambda t: np.array([0.1, 0.2, 0.6, 0.1])).collect()
    assert {(r.label, r.degrees) for r in four} == {(2, 180)}
    with pytest.raises(Exception, match="four"):
        models.page_orientation(pages, lambda t: np.array([0.5, 0.5])).collect()


def test_recognised_pages_equal_plain_python(spark, tmp_path):
    from glyphlake.plans import registry

    rows = [(i, i % 10) for i in range(23)]
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r.page, r.line_no, r.text, r.score, r.rotation) for r in registry.QUERIES["recognise_pages"](spark, str(tmp_path)).collect())
    want = []
    for page, label in rows:
        image = np.full((96, 128, 3), 16, np.uint8)
        for y in (14, 62):
            image[y : y + 20, label + 10 : 110] = 255
        for line in models.lines_of(image, models.StubModels(), dbpost.Options()):
            text, probabilities, before = "", [], 0
            for step in line[-1]:
                if step["cls"] and step["cls"] != before:
                    text += "ab "[step["cls"] - 1]
                    probabilities.append(step["prob"])
                before = step["cls"]
            want.append((page, line[0], text, round(float(np.float32(sum(probabilities) / len(probabilities))), 6), line[12]))
    assert len(got) == 46 and [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in sorted(want)]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in sorted(want)], abs=1e-6)


def test_markdown_escapes_bars(spark):
    from glyphlake.plans import inputs

    runs = report.with_baseline(inputs.runs(spark, "/root/testdata/sf0.001").limit(8), ["replica"])
    full = runs.withColumns({"n": F.lit(3), "effective_isa": F.lit("avx2"), "median": F.lit(1.25), "p95": F.lit(2.0), "cls_correct": F.lit(1), "cls_total": F.lit(2), "exact_lines": F.lit(None).cast("int"), "total_lines": F.lit(4), "cer": F.lit(0.1234), "ws_peak": F.lit(7.0)})
    text = report.markdown("Smoke", full)
    assert "| 1/2 | — | 12.34% | 7.0 |" in text and "a\\|b" in text
