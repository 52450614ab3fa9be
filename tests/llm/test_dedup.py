import hashlib
import random

import pytest
from pyspark.sql import functions as F

from glyphlake.llm import exact_dedup, sharding, simhash

DOCS = "doc_id long, text string, keep_id string, fp int"
LONG = " ".join(f"word{i % 97} about{i % 31} some{i}" for i in range(4000))
ROWS = [(1, "same text", "x", 0), (2, "same text", "x", 0), (2, "same text", "x", 0), (3, None, "x", 0), (4, "", "x", 0), (5, "Same text", "x", 0), (None, "same text", "x", 0), (6, LONG, "x", 0), (7, LONG, "x", 0), (8, LONG + "!", "x", 0), (9, "é 漢 😀" * 9, "x", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.xxhash64(c) % 2])
def test_exact_dedup_matches_brute_force_even_where_hashes_collide(docs, hashed):
    got = [tuple(r) for r in exact_dedup.exact_dedup(docs, hashed).collect()]
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(t or "", []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            stays = i == keep and not done
            done |= stays
            want.append((i, keep, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_chunks_join_to_the_text_and_move_with_the_content(spark):
    rng = random.Random(8)
    prose = " ".join("".join(rng.choice("aeiourstlnmd") for _ in range(rng.randint(2, 8))) for _ in range(5000))
    df = spark.createDataFrame([(prose,), ("0123456789 " + prose,), ("x" * 40000,), ("",)], "text string").select("text", exact_dedup.chunks(F.col("text")).alias("c"))
    rows = df.collect()
    assert all("".join(r.c) == r.text for r in rows)
    assert len(set(rows[0].c) & set(rows[1].c)) > 0.7 * len(rows[0].c)
    assert max(map(len, rows[2].c)) <= 16384


def test_keep_first_keeps_one_row_of_each_text(docs):
    kept = exact_dedup.keep_first(docs).collect()
    assert sorted((r.text or "") for r in kept) == sorted({t or "" for _, t, *_ in ROWS})
    assert kept[0].asDict().keys() == {"doc_id", "text", "keep_id", "fp"}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert exact_dedup.exact_dedup(none).count() == exact_dedup.keep_first(none).count() == 0
    assert sharding.shard(none).count() == simhash.simhash_groups(none).count() == 0


def brute_groups(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = {}
    for i, (doc, _) in enumerate(prints):
        out.setdefault(root(i), []).append(doc)
    return {d: min(x for x in ids if x is not None) if any(x is not None for x in ids) else None for ids in out.values() for d in ids}


@pytest.mark.parametrize("long", [64, 3, 1])
def test_links_connect_what_brute_force_connects(spark, long):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = set(base) | {0}
    for b in base[:6]:
        x = b
        for _ in range(25):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            fps.add(x)
            fps.add(b ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    nodes = spark.createDataFrame(signed, "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, long)).collect()}
    want = brute_groups([(s[0], f) for s, f in zip(signed, fps)])
    for (s,) in signed:
        assert roots.get(s, s) == want[s]


def test_fingerprint_is_that_of_the_definition_and_of_the_engine(spark):
    import xxhash

    texts = ["One two THREE four two three four", "a b", "", "   \t", "Ä é ÄB Ä é", "x"]
    for t in texts:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t).split()
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0
        assert simhash.fingerprint(t) == want
    one = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0] % (1 << 64)
    assert simhash.fingerprint("one two three") == one


def test_long_texts_are_tallied_in_blocks(monkeypatch):
    whole = simhash.fingerprint(LONG)
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.fingerprint(LONG) == whole


def test_simhash_groups(docs):
    rows = simhash.simhash_groups(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == by[5].component_id == 1
    assert by[3].component_id == by[4].component_id == 3 and by[3].fingerprint == "0" * 16
    assert by[6].component_id == by[7].component_id == 6
    kept = simhash.keep_one(docs).collect()
    assert {r.doc_id for r in kept} >= {1, 3, 6, 9} and not {2, 5, 4, 7} & {r.doc_id for r in kept}


def test_keep_one_keeps_a_row_of_each_group_where_ids_are_null_or_repeat(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(1, a, 0), (None, a.upper(), 1), (None, b, 2), (5, a.title(), 3), (5, c, 4), (None, d, 5), (None, d.upper(), 6), (7, e, 7), (7, e, 8), (7, e.upper(), 9)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int"))
    assert kept.columns == ["doc_id", "text", "n"]
    n = sorted(r.n for r in kept.collect())
    assert len(n) == 5 and n[:3] == [0, 2, 4] and n[3] in (5, 6) and n[4] in (7, 8, 9)


def brute_capacity(sizes, shards):
    best = sum(sizes)
    low = max(sizes, default=0)
    for c in range(low, best + 1):
        used, room = 1, c
        for s in sizes:
            if s > room:
                used, room = used + 1, c
            room -= s
        if used <= shards:
            return c
    return best


def test_smallest_capacity_is_minimal():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 15))]
        for shards in (1, 2, 3, 8):
            assert sharding.smallest_capacity(sizes, shards, max(sizes)) == brute_capacity(sizes, shards)


@pytest.mark.parametrize("detail", [1, 7, 10**6])
def test_cuts_over_ranges_have_the_capacity_of_all_groups(spark, detail):
    rng = random.Random(3)
    items = sorted((hashlib.sha256(str(i).encode()).digest(), rng.randint(1, 400)) for i in range(700))
    groups = spark.createDataFrame([(bytearray(k), b) for k, b in items], "key binary, bytes long")
    sizes = [b for _, b in items]
    first = sharding.cuts(groups, 8, sum(sizes), max(sizes), len(items), detail)
    capacity = sharding.smallest_capacity(sizes, 8, max(sizes))
    assert first == [items[e][0] for e in sharding.even_cuts(sizes, 8, capacity)[:-1]]


def parts(sizes, ends):
    return [sum(sizes[a:b]) for a, b in zip([0, *ends], ends)]


def test_even_cuts_keep_to_the_capacity_and_fill_all_shards():
    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 40))]
        if sizes and rng.random() < 0.5:
            sizes[rng.randrange(len(sizes))] = sum(sizes) // 2 + 1
        for shards in (1, 2, 5, 8):
            capacity = sharding.smallest_capacity(sizes, shards, max(sizes, default=0))
            ends = sharding.even_cuts(sizes, shards, capacity)
            assert len(ends) == shards and ends == sorted(ends) and ends[-1] == len(sizes)
            assert max(parts(sizes, ends), default=0) <= capacity
            assert not sizes or max(parts(sizes, ends)) == brute_capacity(sizes, shards)
    hot = [5] * 60 + [300] + [5] * 60
    assert min(parts(hot, sharding.even_cuts(hot, 8, sharding.smallest_capacity(hot, 8, 300)))) > 40


def test_shard_law(spark, docs):
    rows = sharding.shard(docs).collect()
    assert len(rows) == len(ROWS)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    of = {}
    for i, t, *_ in ROWS:
        of.setdefault(t or "", set()).update(r.shard for r in rows if r.doc_id == i)
    assert len(of["same text"]) == 1 and len(of[LONG]) == 1
    assert {r.size for r in rows if r.doc_id in (3, 4)} == {1}
