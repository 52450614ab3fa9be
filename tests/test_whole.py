"""Queries over whole texts and tables, against plain Python on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.functions import text as fmt
from glyphlake.operators import evaluate, report, scan
from glyphlake.plans import registry


def fnv(data: bytes) -> str:
    h = 14695981039346656037
    for b in data:
        h = (h ^ b) * 1099511628211 % (1 << 64)
    return f"{h:016x}"


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_page_hash_is_of_the_whole_texts(spark, tmp_path):
    same = "the same thirty-two characters, and more: "
    rows = [(1, 0, same + "a"), (1, 1, "x~é"), (2, 0, same + "b"), (2, 1, "x~é"), (3, 1, None), (3, 0, "漢" * 50)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.page: (r.text, r.hash) for r in registry.QUERIES["packed_text_hash"](spark, str(tmp_path)).collect()}
    want = {}
    for page, _, text in sorted(rows, key=lambda r: r[:2]):
        want.setdefault(page, []).append(text or "")
    assert got == {page: ("\n".join(v), fnv("".join(t + "\0" for t in v).encode())) for page, v in want.items()}
    assert got[1][1] != got[2][1]


def test_least_edit_distance_is_over_whole_texts_and_all_partners(spark):
    rng = random.Random(4)
    start = "thirty-two characters in common: "
    rows = [(i, start + "".join(rng.choice("abcé") for _ in range(rng.randint(5, 30)))) for i in range(20)]
    rows += [(3, rows[4][1]), (None, "alone"), (21, ""), (22, None)]
    table = spark.createDataFrame(rows, "item_id long, text string")
    want = [(i, None if t is None else min(distance(t, o) for k, (_, o) in enumerate(rows) if k != n and o is not None)) for n, (i, t) in enumerate(rows)]
    got = [(r.item_id, r.best) for r in evaluate.nearest_texts(table).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    some = [(r.item_id, r.best) for r in evaluate.nearest_texts(table, F.col("item_id") % 5 == 0).collect()]
    assert sorted(some) == sorted(w for w in want if w[0] is not None and w[0] % 5 == 0)


def test_edit_distance_is_between_turns_that_follow(spark, tmp_path):
    rows = [(1, 0, "abcd" * 20), (1, 1, "abce" * 20), (1, 2, None), (2, 5, "x"), (2, 7, "é")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(tuple(r) for r in registry.QUERIES["edit_distance"](spark, str(tmp_path)).collect()) == [(1, 1, 20), (1, 2, 80), (2, 7, 1)]


def test_rows_that_share_a_line_number_are_boxes_of_their_own(spark, tmp_path):
    rows = [(1, 5, 70, 1), (1, 10, 140, 1), (1, 15, 210, 2)]
    columns = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame([(*r, 20.0, 1.0, "R", "O") for r in rows], columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    run = lambda name: sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("reading_order") == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]
    assert [r[:3] for r in run("greedy_assignment")] == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    assert run("rotation_by_box") == [(3, 3)]


def test_hashes_side_by_side_equal_hashes_one_by_one():
    rng = random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 7, 40, 400]))) for _ in range(90)] + [b"x" * 3000]
    assert [f"{h:016x}" for h in fmt.fnv1a(texts).tolist()] == [fnv(t) for t in texts]
    assert fmt.fnv1a([]).tolist() == [] and f"{int(fmt.fnv1a([b'ab'])[0]):016x}" == fnv(b"ab")


def test_lengths_and_distances_count_utf16_units(spark):
    pairs = [("a😀b", "ab"), ("😀", "😁"), ("Ø\x00漢", "Ø漢"), ("", "😀😀"), ("\U0010ffff", "\U0010fffe")]
    units = lambda s: s.encode("utf-16-be")
    split = lambda s: [units(s)[i : i + 2] for i in range(0, len(units(s)), 2)]
    u = lambda c: fmt.utf16_units(F.col(c))
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", F.length(u("a")).alias("n"), F.levenshtein(u("a"), u("b")).alias("d")).collect()
    for r in rows:
        a, b = map(split, pairs[r.i])
        assert (r.n, r.d) == (len(a), distance(a, b))


@pytest.mark.parametrize("keys", [["g"], []])
def test_running_values_cross_ranges(spark, keys):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", None, "b"]), i, rng.randrange(50), rng.random()) for i in range(400)]
    got = scan.running(spark.createDataFrame(rows, "g string, n long, v long, w double"), keys, ["n"], {"s": "v"}, {"p": "w"}, {"before": "v"}, "k").collect()
    state = {}
    want = {}
    for g, n, v, w in rows:
        s, p, last, k = state.get(g if keys else 0, (0, 0.0, None, 0))
        want[n] = (s + v, max(p, w), last, k + 1)
        state[g if keys else 0] = (s + v, max(p, w), v, k + 1)
    assert len(got) == len(rows) and all((r.s, r.p, r.before, r.k) == want[r.n] for r in got)


def test_summary_has_maps_and_memory_of_the_meta(spark):
    rows = [("r", f"f{i}", i, float(10 - i), 2, {"crop": 1.0, **({"x": 2.0} if i == 2 else {})}) for i in range(4)] + [("s", "g", 0, 5.0, 1, {})]
    table = evaluate.warmup(spark.createDataFrame(rows, "run string, file string, seq long, total_ms double, lines int, stage_ms map<string,double>"), ["run"], ["seq"])
    meta = spark.createDataFrame([("r", 3.0, 5.5), ("s", None, 1.0)], "run string, ws_loaded double, ws_last double")
    got = {r.run: r for r in evaluate.build_summary(table, ["run"], meta).collect()}
    assert (got["r"].n, got["r"].warmup, got["r"].warmup_ms, got["r"].slowest_file, got["r"].slowest_ms) == (3, 1, 10.0, "f1", 9.0)
    assert got["r"].stage_ms_mean == {"crop": 1.0, "x": 2.0}
    assert got["r"].working_set_delta == 2.5 and got["s"].working_set_delta is None
    assert (got["s"].n, got["s"].warmup, got["s"].stage_ms_mean) == (1, 0, None)


def test_quotients_are_compared_exactly(spark):
    big = (1 << 31) - 1
    sides = [(big, big - 1), (big - 1, big - 2), (big - 2, big - 3), (1, 3), (2, 6), (5, 0), (7, 2)]
    lines = spark.createDataFrame([(1, i, w, h) for i, (w, h) in enumerate(sides)], "page long, line_no int, width int, height int")
    got = [r.line_no for r in sorted(evaluate.longest_first(lines).collect(), key=lambda r: r.turn)]
    from fractions import Fraction

    assert got == sorted(range(len(sides)), key=lambda i: (-Fraction(sides[i][0], max(1, sides[i][1])), i))


def test_files_that_lack_a_side(spark):
    truth = spark.createDataFrame([("a", 0, "x", 0), ("b", 0, "yy", 0), ("c", 0, "z", 180)], "file string, line int, text string, cls_degrees int")
    predicted = spark.createDataFrame([("A", 0, "x", 0), ("B", 0, None, 0), ("d", 0, "z", 180)], "file string, line int, text string, rotation int")
    got = {r.file: (r.exact, r.chars, r.errors) for r in evaluate.line_errors(truth, predicted).collect()}
    assert got == {"a": (True, 1, 0), "b": (False, 2, 2)}
    assert tuple(evaluate.rotation_score_by_text(truth, predicted).first()) == (1, 1)
    boxes = lambda rows: spark.createDataFrame(rows, "image long, x0 double, y0 double, x1 double, y1 double")
    modes = {r.image: r.mode for r in evaluate.match_modes(boxes([(1, 0.0, 0.0, 2.0, 2.0), (2, 0.0, 0.0, 0.0, 2.0), (3, 0.0, 0.0, 1.0, 1.0)]), boxes([(1, 0.0, 0.0, 1.0, 1.0), (2, 0.0, 0.0, 1.0, 1.0), (4, 0.0, 0.0, 1.0, 1.0)])).collect()}
    assert modes == {1: "boxes", 2: "text", 3: "none", 4: "none"}


def test_compared_runs_that_lack_a_key(spark):
    rows = spark.createDataFrame([("zeta", "r1", 1.0), ("crop", "r2", 2.5), ("crop", "r2", 3.5)], "key string, run string, value double")
    assert [tuple(r) for r in report.compare(rows, ["r1", "r2"]).collect()] == [("crop", 5, "-", "3.00"), ("zeta", 12, "1.00", "-")]
    assert [tuple(r) for r in report.key_union(rows).collect()] == [("crop", 1), ("zeta", 2)]
    assert np.all([r.k > 0 for r in report.with_places(rows, {"k": ["key", "run"]}).collect()])
