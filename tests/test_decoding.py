import math
import random

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import charboxes, ctc

LABELS = ctc.labels_of(["p", "ß", "漢"])


def plain_decode(cls, prob):
    """(text, score, spans) by a loop over the steps."""
    spans, open_ = [], None
    for i, c in enumerate([*cls, 0]):
        if open_ is not None and (i == len(cls) or c != open_[0]):
            spans.append((LABELS[open_[0] - 1], open_[1], open_[2], i))
            open_ = None
        if i < len(cls) and c and open_ is None:
            open_ = (c, prob[i], i)
    return "".join(s[0] for s in spans), sum(s[1] for s in spans) / len(spans) if spans else 0.0, spans


def lines():
    rng = random.Random(21)
    fixed = [[0], [4], [2, 2, 2], [1, 0, 1], [3, 3, 1, 1, 0, 0, 4], [0, 0, 0, 0], [4, 1, 4, 1]]
    return [(c, [round(rng.random(), 3) for _ in c]) for c in fixed + [[rng.choice([0, 0, 1, 2, 3, 4]) for _ in range(rng.randint(1, 30))] for _ in range(60)]]


def test_text_score_and_spans(spark):
    cases = lines()
    rows = [(i, s, c, p) for i, (cls, prob) in enumerate(cases) for s, (c, p) in enumerate(zip(cls, prob))]
    steps = spark.createDataFrame(rows, "line long, step int, cls int, prob double")
    listed = steps.groupBy("line").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "cls", "prob"))), lambda x: F.struct(x["cls"].alias("cls"), x["prob"].alias("prob"))).alias("steps"))
    text = {r.line: r for r in ctc.with_spans(ctc.decode(listed, LABELS), LABELS).collect()}
    spans = {r.line: r.spans for r in ctc.captured(steps.select("line").distinct(), ctc.spans(steps, LABELS)).collect()}
    for i, case in enumerate(cases):
        want, score, runs = plain_decode(*case)
        assert text[i].text == want and text[i].score == pytest.approx(score) and text[i].emitted == len(runs)
        for found in (spans[i], text[i].spans):
            assert [(s.text, s.score, s.start, s.end) for s in found] == runs


def test_lines_without_steps_have_empty_spans(spark):
    none = spark.createDataFrame([(1, [])], "line long, steps array<struct<cls:int,prob:double>>")
    row = ctc.with_spans(ctc.decode(none, LABELS), LABELS).first()
    assert (row.text, row.score, row.emitted, row.spans) == ("", 0.0, 0, [])


@pytest.mark.parametrize("shift", [0.0, 700.0, -700.0])
def test_dense_scores_survive_shifts(spark, shift):
    rng = random.Random(8)
    logits = [[rng.uniform(-4, 4) for _ in range(5)] for _ in range(12)] + [[2.5] * 5, [0, 1, 1, 0, 1]]
    df = spark.createDataFrame([([x + shift for r in logits for x in r],)], "v array<double>")
    got = ctc.steps_of(df, "v", 5).first().steps
    for s, r in zip(got, logits):
        assert s.cls == r.index(max(r)) and s.prob == pytest.approx(max(math.exp(x) for x in r) / sum(map(math.exp, r)), abs=1e-9)


def plain_boxes(quad, spans, steps, content, tensor, rotation):
    """Parts of a parallelogram: edges halfway to the neighbours, along the reading direction."""
    p = [quad[k : k + 2] for k in range(0, 8, 2)]
    across, down = (max(math.dist(p[a], p[b]), math.dist(p[c], p[d])) for a, b, c, d in ((0, 1, 2, 3), (0, 3, 1, 2)))
    tall = math.floor(down) >= 1.5 * math.floor(across)
    at = lambda u, v: [p[0][i] + u * (p[1][i] - p[0][i]) + v * (p[3][i] - p[0][i]) for i in (0, 1)]
    out = []
    for k, (a, b) in enumerate(spans):
        begin = (spans[k - 1][1] + a) / 2 if k else a
        end = (b + spans[k + 1][0]) / 2 if k + 1 < len(spans) else b
        t0, t1 = (x * tensor / content / steps for x in (begin, end))
        if rotation == 180:
            t0, t1 = 1 - t1, 1 - t0
        t0, t1 = (min(1, max(0, t)) for t in (t0, t1))
        corners = [(0, 1 - t0), (0, 1 - t1), (1, 1 - t1), (1, 1 - t0)] if tall else [(t0, 0), (t1, 0), (t1, 1), (t0, 1)]
        out.append([c for u, v in corners for c in at(u, v)])
    return out


def quads():
    rng = random.Random(33)
    cases = []
    for k in range(40):
        x, y = rng.randint(0, 300), rng.randint(0, 300)
        w, h = (rng.randint(60, 200), rng.randint(12, 30)) if k % 3 else (rng.randint(12, 30), rng.randint(60, 200))
        s, t = rng.randint(-5, 5), rng.randint(-5, 5)
        steps = rng.randint(6, 40)
        cuts = sorted(rng.sample(range(steps + 1), 2 * rng.randint(0, 3)))
        content = rng.randint(20, 320)
        cases.append(([x, y, x + w, y + s, x + w + t, y + s + h, x + t, y + h], list(zip(cuts[::2], cuts[1::2])), steps, content, content + rng.choice([0, 13]), rng.choice([0, 180])))
    return cases


SCHEMA = "line long, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double, x4 double, y4 double, time_steps int, content_width int, tensor_width int, rotation int, spans array<struct<span:int,text:string,score:double,start:int,end:int>>"


def _line(i, quad, spans, t, content, tensor, rotation):
    listed = None if spans is None else [(k, "x", 0.5, a, b) for k, (a, b) in enumerate(spans)]
    return (i, *map(float, quad), t, content, tensor, rotation, listed)


def test_character_boxes(spark):
    cases = quads()
    got = {}
    for r in charboxes.from_lines(spark.createDataFrame([_line(i, *c) for i, c in enumerate(cases)], SCHEMA)).orderBy("line", "span").collect():
        got.setdefault(r.line, []).append([r[f"b{p}"] for p in ("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4")])
    for i, c in enumerate(cases):
        want = plain_boxes(*c)
        assert len(got.get(i, [])) == len(want)
        for a, b in zip(got.get(i, []), want):
            assert a == pytest.approx(b, abs=1e-6)


def test_a_trapezoid_s_whole_line_is_the_trapezoid(spark):
    quad = [3, 2, 123, 10, 101, 55, 14, 47]
    row = charboxes.from_lines(spark.createDataFrame([_line(0, quad, [(0, 6)], 6, 6, 6, 0)], SCHEMA)).first()
    assert [row[f"b{p}"] for p in ("x1", "y1", "x2", "y2", "x3", "y3", "x4", "y4")] == pytest.approx(quad)


@pytest.mark.parametrize("spans", [[(0, 9)], [(0, 3), (2, 4)], None])
def test_character_boxes_refuse(spark, spans):
    line = spark.createDataFrame([_line(0, [0, 0, 40, 0, 40, 10, 0, 10], spans, 4, 4, 4, 0)], SCHEMA)
    with pytest.raises(Exception, match="range|captured"):
        charboxes.from_lines(line).collect()
