import io
import json

import pytest

from glyphlake.operators import evaluate, imageops, models
from glyphlake.sources import bench, model_set
from glyphlake.sources.model_set import Bundle, FileProvider, Kind


def test_model_sets(tmp_path):
    for name, data in (("det", b"d"), ("rec", b"r"), ("dict", "a\nb\n".encode())):
        (tmp_path / name).write_bytes(data)
    at = lambda n: str(tmp_path / n)
    models = model_set.from_paths(at("det"), at("rec"), at("dict"))
    assert models.labels == ["a", "b", " "] and models.classifier is None
    with pytest.raises(FileNotFoundError):
        model_set.from_paths(at("det"), at("none"), at("dict"))
    parts = [FileProvider(Kind.DETECTION, at("det")), FileProvider(Kind.RECOGNITION, at("rec")), FileProvider(Kind.DICTIONARY, at("dict"))]
    (tmp_path / "out").mkdir()
    loaded = model_set.from_bundle(Bundle(*parts), at("out"))
    assert open(loaded.recogniser, "rb").read() == b"r"
    with pytest.raises(ValueError):
        Bundle(parts[1], parts[0], parts[2])

    class Memory:
        kind = Kind.CLASSIFICATION

        def open(self):
            return io.BytesIO(b"c")

    assert open(model_set.from_bundle(Bundle(*parts, Memory()), at("out")).classifier, "rb").read() == b"c"
    assert model_set.normalized(" Small ") == "small" and model_set.normalized(None) == "tiny"
    with pytest.raises(ValueError):
        model_set.normalized("huge")


def test_named_sets_are_loaded_once(tmp_path):
    (tmp_path / "tiny").mkdir()
    for n in ("det.onnx", "rec.onnx"):
        (tmp_path / "tiny" / n).write_bytes(b"x")
    (tmp_path / "tiny" / "dict.txt").write_text("a\n")
    assert model_set.named(str(tmp_path), "tiny") is model_set.named(str(tmp_path), "tiny")


def test_image_scan_orders_without_case_and_counts(spark, tmp_path):
    for n in ("img-b.jpg", "img-A.jpg", "img-c.jpg", "x.jpg", "img-d.png"):
        (tmp_path / n).write_bytes(b"1")
    names = lambda **k: [r.path.rsplit("/", 1)[1] for r in bench.scan_images(spark, str(tmp_path), **k).collect()]
    assert names() == ["img-A.jpg", "img-b.jpg", "img-c.jpg", "x.jpg"] and names(count=2) == ["img-A.jpg", "img-b.jpg"]
    (tmp_path / "metadata.json").write_text("{}")
    with pytest.raises(ValueError, match="100"):
        names()
    for k in range(97):
        (tmp_path / f"img-{k:03}.jpg").write_bytes(b"1")
    assert len(names()) == 100 and "x.jpg" not in names()
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        bench.scan_images(spark, str(tmp_path / "none"))


def png(width, height, channels, rows):
    """An image file of 1 (grey), 3 (RGB) or 4 (RGBA) channels."""
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def test_decoded_images_are_what_the_page_path_takes(spark, tmp_path):
    for name, channels in (("grey", 1), ("rgb", 3), ("rgba", 4)):
        rows = [bytes((40 * y + 7 * x + c) % 256 for x in range(5) for c in range(channels)) for y in range(4)]
        (tmp_path / f"{name}.png").write_bytes(png(5, 4, channels, rows))
    pages = {r.path.rsplit("/", 1)[1]: r for r in bench.decode_images(spark, str(tmp_path)).collect()}
    for name, channels in (("grey", 1), ("rgb", 3), ("rgba", 4)):
        r = pages[f"{name}.png"]
        image = imageops.pixels(bytes(r.data), r.width, r.height, r.stride, r.pixel_format)
        want = [[[(40 * y + 7 * x + (c if channels > 1 else 0)) % 256 for c in (2, 1, 0)] for x in range(5)] for y in range(4)]
        assert image.tolist() == want
    assert models.read_lines(bench.decode_images(spark, str(tmp_path)), models.StubModels()).count() == 0


# A model file is nested fields, each a number and a value: whole numbers, or bytes with their length.


def varint(n):
    return bytes([n]) if n < 128 else bytes([n % 128 + 128]) + varint(n // 128)


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def node(kind, inputs, output, **attributes):
    out = b"".join(field(1, i) for i in inputs) + field(2, output) + field(4, kind)
    for name, value in attributes.items():
        listed = isinstance(value, list)
        out += field(5, field(1, name) + (b"".join(field(8, v) for v in value) if listed else field(3, value)) + field(20, 7 if listed else 2))
    return field(1, out)


def onnx(nodes, *outputs):
    tensor = lambda name: field(1, name) + field(2, field(1, field(1, 1)))
    graph = b"".join(nodes) + field(2, "g") + field(11, tensor("x")) + b"".join(field(12, tensor(o)) for o in outputs)
    return field(1, 6) + field(7, graph) + field(8, field(1, "") + field(2, 11))


def test_pages_are_read_through_model_files(spark, tmp_path):
    mean = lambda axes, keep: node("ReduceMean", ["x"], "m", axes=axes, keepdims=keep)
    files = {
        "det.onnx": onnx([mean([1], 1), node("Sigmoid", ["m"], "y")], "y"),
        "cls.onnx": onnx([mean([1, 2, 3], 0), node("Unsqueeze", ["m"], "a", axes=[1]), node("Neg", ["a"], "b"), node("Concat", ["a", "b"], "c", axis=1), node("Softmax", ["c"], "y", axis=1)], "y"),
        # The logits are the second output: the first has another width.
        "rec.onnx": onnx([mean([1, 2], 1), node("Transpose", ["m"], "t", perm=[0, 3, 1, 2]), node("Squeeze", ["t"], "a", axes=[3]), node("Neg", ["a"], "b"), node("Concat", ["b", "a", "b", "b"], "y", axis=2)], "a", "y"),
        "dict.txt": b"a\nb\n",
    }
    (tmp_path / "tiny").mkdir()
    for name, data in files.items():
        (tmp_path / "tiny" / name).write_bytes(data)
    pages = models.synthetic_pages(spark.createDataFrame([(1, 0), (2, 40)], "page long, label int"))
    here = model_set.named(str(tmp_path), "tiny")
    sent = model_set.ship(spark, model_set.from_bundle(Bundle(*(FileProvider(k, str(tmp_path / "tiny" / n)) for k, n in ((Kind.DETECTION, "det.onnx"), (Kind.RECOGNITION, "rec.onnx"), (Kind.DICTIONARY, "dict.txt"), (Kind.CLASSIFICATION, "cls.onnx"))))))
    for set_ in (here, sent):
        rows = models.recognise(pages, set_, alignment=True).collect()
        assert sorted((r.page, r.line_no, r.text, r.emitted, len(r.spans)) for r in rows) == [(p, n, "a", 1, 1) for p in (1, 2) for n in (0, 1)]
    text = {r.page: (r.lines, r.text) for r in models.page_texts(models.recognise(pages, sent)).collect()}
    assert text == {1: (2, "a\na"), 2: (2, "a\na")}
    import numpy as np

    assert here.turn(np.zeros((3, 3, 80, 160), np.float32)).shape == (3, 2)
    streams = [io.BytesIO(files[n]) for n in ("det.onnx", "rec.onnx", "dict.txt")]
    loaded = model_set.from_streams(*streams)
    assert loaded.classifier is None and not any(x.closed for x in streams) and open(loaded.detector, "rb").read() == files["det.onnx"]


def test_box_threshold_follows_the_model_file(tmp_path):
    weight = lambda name, dims, packed: field(5, (field(1, b"".join(varint(d) for d in dims)) if packed else b"".join(field(1, d) for d in dims)) + field(2, 1) + field(8, name) + field(9, b"\0" * 4))
    for channels, packed, want in ((16, False, 0.4), (24, True, 0.45), (300, True, 0.45)):
        nodes = [node("Neg", ["x"], "n"), node("Conv", ["n", "w1"], "c", strides=[2, 2]), node("Conv", ["c", "w2"], "y")]
        data = onnx(nodes, "y")
        graph = next(v for k, v in models._fields(data) if k == 7) + weight("w2", [8, 3, 3, 3], packed) + weight("w1", [channels, 3, 3, 3], packed)
        path = tmp_path / "det.onnx"
        path.write_bytes(field(1, 6) + field(7, graph))
        assert models.first_channels(path.read_bytes()) == channels and models.options_for(str(path)).box_threshold == want
        assert models.options_for(str(path), box_threshold=0.6).box_threshold == 0.6
    assert models.first_channels(onnx([node("Neg", ["x"], "y")], "y")) is None


def test_sets_load_beside_other_work(tmp_path):
    import asyncio

    for name, data in (("d", b"d"), ("r", b"r"), ("t", b"a\n")):
        (tmp_path / name).write_bytes(data)
    loaded = asyncio.run(model_set.load_async(model_set.from_paths, *(str(tmp_path / n) for n in "drt")))
    assert loaded.labels == ["a", " "]


def test_a_set_that_fails_to_load_leaves_no_file(tmp_path):
    (tmp_path / "d").write_bytes(b"x")
    part = lambda kind: FileProvider(kind, str(tmp_path / "d"))
    (tmp_path / "empty").write_bytes(b"\n")
    (tmp_path / "out").mkdir()
    with pytest.raises(ValueError):
        model_set.from_bundle(Bundle(part(Kind.DETECTION), part(Kind.RECOGNITION), FileProvider(Kind.DICTIONARY, str(tmp_path / "empty"))), str(tmp_path / "out"))
    assert not list((tmp_path / "out").iterdir())


def test_results_are_written_and_read_again(spark, tmp_path):
    rows = spark.createDataFrame([("r", 1, "b.jpg", 2.0), ("r", 0, "a.jpg", 4.0)], "run string, seq int, file string, total_ms double")
    meta = spark.createDataFrame([("r", "linux")], "run string, rid string")
    document = evaluate.result_document(meta, evaluate.stats(rows, ["run"], "total_ms"), rows)
    bench.write_results(document.drop("run").coalesce(1), str(tmp_path / "out"))
    got = bench.meta_columns(bench.read_results(spark, str(tmp_path / "out")))
    assert [(r.seq, r.row.file, r.rid) for r in got.orderBy("seq").collect()] == [(0, "a.jpg", "linux"), (1, "b.jpg", "linux")]


def test_limits_of_requests():
    bench.check_request(1000, 100, 100, "tiny")
    for bad in ((21 << 20, 1, 1, "tiny"), (1, 10_000, 10_000, "tiny"), (1, 1, 1, "other")):
        with pytest.raises(ValueError):
            bench.check_request(*bad)


def test_answers_are_json(spark):
    corner = ", ".join(f"{p} double" for p in ("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4"))
    sign = f"struct<text:string,score:double,{corner.replace(' double', ':double').replace(' ', '')}>"
    line = sign[:-1] + f",box_score:double,label_score:double,rotation:int,characters:array<{sign}>>"
    box = [float(k) for k in range(8)]
    rows = [("t\nu", "tiny", (1.0, 2.0, 3.0), [("t", 0.5, *box, 0.9, 1.0, 180, [("t", 0.25, *box)]), ("u", 0.5, *box, 0.9, 1.0, 0, None)])]
    page = spark.createDataFrame(rows, f"text string, model string, elapsed struct<decode:double,ocr:double,total:double>, lines array<{line}>")
    got = json.loads(bench.response_json(page).first().json)
    corners = [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0], [6.0, 7.0]]
    shared = {"recognitionScore": 0.5, "box": corners, "detectionScore": 0.9, "classificationScore": 1.0}
    assert got["text"] == "t\nu" and got["detectedCount"] == 2 and got["elapsedMs"] == {"decode": 1.0, "ocr": 2.0, "total": 3.0}
    assert got["lines"] == [{"text": "t", **shared, "appliedRotationDegrees": 180, "characters": [{"text": "t", "score": 0.25, "box": corners}]}, {"text": "u", **shared, "appliedRotationDegrees": 0}]


def test_null_and_empty_inputs(spark):
    none = spark.createDataFrame([], "run string, total_ms double")
    assert evaluate.stats(none, ["run"], "total_ms").count() == 0
    nulls = spark.createDataFrame([("r", None), ("r", 2.0)], "run string, total_ms double")
    row = evaluate.stats(nulls, ["run"], "total_ms").first()
    assert (row.n, row.mean, row.p95) == (1, 2.0, 2.0)
    unnamed = spark.createDataFrame([(None, 3.0), (None, 1.0)], "run string, total_ms double")
    assert evaluate.stats(unnamed, ["run"], "total_ms").first().median == 2.0
