import gzip
import hashlib
import random

import numpy as np
import pytest

from glyphlake.llm import bpe, chat, decontaminate, langid, toxicity, url_filter, warc


def exact():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder().ranks, special_tokens={})


def test_bpe_equals_the_library_and_decodes_exactly():
    ours, theirs = bpe.encoder(), exact()
    rng = random.Random(1)
    texts = ["", "a" * 5000, " " * 3000, "<|endoftext|>", "it's we'll", "\x1c\x85　 x"]
    texts += ["".join(rng.choice("abcdet hin\n\t  é漢😀'sS019!?") for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    for t in texts:
        assert ours.encode(t) == theirs.encode_ordinary(t)
        assert ours.decode(ours.encode(t)) == t.encode()


def test_bpe_takes_linear_time_steps(monkeypatch):
    ours = bpe.encoder()
    calls = 0
    fits = ours.fits

    def counted(a, b):
        nonlocal calls
        calls += 1
        return fits(a, b)

    monkeypatch.setattr(ours, "fits", counted)
    ours.encode_bytes(b"abcab" * 4000)
    assert calls < 20_000 * 20


def test_bpe_digests(spark):
    rows = [(1, "Some text", 5), (2, None, 5), (2, "", 5), (None, "x", 5)]
    got = {(r.doc_id, r.n_tokens): r for r in bpe.digests(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()}
    ids = exact().encode_ordinary("Some text")
    assert got[1, len(ids)].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[2, 0].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().decoded == b""


NASTY = [chat.PROBE, "", "<turn>", "</turn><text>\\", "\\\\<turn>\\", "a\n<text>b", "é😀"]


def test_escape_is_reversible_and_leaves_no_mark():
    for t in NASTY:
        assert chat.unescape(chat.escape(t)) == t
        assert not [m for m in chat.MARKS.findall(chat.escape(t)) if m[0] != "\\"]


def test_chat_round_trip(spark):
    rows = [(1, i, ("user", "assistant", None)[i % 3], t, "x") for i, t in enumerate(NASTY)]
    rows += [(2, 0, "assistant", None, "x"), (2, 0, "assistant", None, "x"), (None, None, "user", "hi", "x"), (3, 1, "assistant", "late", "x"), (3, 0, "assistant", "early ", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss_chars string")
    got = {r.conv_id: r for r in chat.format_conversations(chat.with_probe(table)).collect()}
    want = {}
    for c, _, role, text, *_ in [*rows[:-2], rows[-1], rows[-2], (-7, 0, "user", chat.PROBE), (-7, 1, "assistant", chat.PROBE)]:
        want.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_rendered_conversations_parse_and_offsets_add_up(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(NASTY)]
    parts = chat.assemble(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    text = "".join(p.rendered for p in parts)
    assert chat.parse(text) == [(r, t) for _, _, r, t in rows]
    tokens = chars = 0
    for p in parts:
        assert (p.token_start, p.char_start) == (tokens, chars) and len(p.ids) == len(p.loss)
        tokens, chars = tokens + len(p.ids), chars + len(p.rendered)


def pages(spark):
    html = "<p>" + "long enough to be revisited " * 9
    rows = [(1, "http://B.example.org/x", "short", "c"), (2, "http://b.example.org/x", "short", "c"), (3, "http://a.example.org/y?q=1", html, "c"), (4, "https://c.example.org", html, "c"), (5, None, None, "c"), (6, "no scheme", "", "c"), (7, "http://z.example.org/\n\r x", html + "é", "c")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, length string")


def test_warc_round_trip(spark):
    rows, table = pages(spark)
    got = {r.page_id: r for r in warc.round_trip(table).collect()}
    assert len(got) == len(rows)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        assert got[i].payload_bytes == len(data) and got[i].payload_digest == hashlib.sha256(data).hexdigest()
    assert got[4].record_type == "revisit" and got[4].refers_to == 3
    assert got[2].record_type == "response" and got[2].refers_to is None
    assert warc.round_trip(table.limit(0)).count() == 0


def test_warc_revisit_takes_the_response_of_its_own_payload(spark):
    one, two = "one payload " * 20, "another payload " * 30
    table = spark.createDataFrame([(1, "http://a/x", one), (1, "http://a/y", two), (2, "http://a/z", one), (3, "http://a/w", two)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.payload_bytes, r.payload_digest) for r in warc.round_trip(table).collect() if r.page_id > 1)
    assert got == [(i, "revisit", len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in ((2, one), (3, two))]


def test_warc_lookups_by_url(spark):
    rows, table = pages(spark)
    captures, directory, archives, index = warc.archive(table)
    lookups = warc.Index([tuple(r) for r in directory.select("first_key", "first_page", "last_key", "last_page", "file", "start", "length", "n").collect()], index, archives)
    assert sorted(r.page_id for r in lookups.fetch("http://b.example.org/x")) == [1, 2]
    assert lookups.fetch("http://a.example.org/y?q=1")[0].payload.decode() == rows[2][2]
    assert lookups.fetch("http://nowhere.example.org/") == []


def test_warc_blocks_and_many_rows(spark):
    table = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 5, '.example.org/', id % 700) as url", "repeat(concat('payload ', id % 900, ' '), 12) as html")
    rows = {r.page_id: r for r in warc.round_trip(table).collect()}
    assert len(rows) == 3000 and all((r.record_type == "revisit") == (i >= 900) for i, r in rows.items())
    assert all(r.refers_to == i % 900 for i, r in rows.items() if i >= 900)


def test_warc_record_is_one_gzip_member():
    data = warc.record(4, "http://x/\r\nInjected: y", b"body\r\n\r\nmore", "d" * 64, None, False)
    r = warc.parse(gzip.decompress(data))
    assert (r.kind, r.page_id, r.payload) == ("response", 4, b"body\r\n\r\nmore") and "\n" not in r.uri


def test_url_rules_and_verdicts(spark):
    cases = {
        "http://Sub.Example.org/es/1": ("example.org/es/", "block"), "http://example.org/en/12": ("example.org/en/1", "block"), "http://example.org/en/2": ("org/", "allow"),
        "http://x.com/fr/9": ("com/fr/", "allow"), "https://x.com/de/": ("com/de/", "block"), "http://notexample.org/es/": ("org/", "allow"), "http://example.org": (None, None),
        "http://www.casino-win.example.net/en/7": (None, "block"), "http://www.ththor.example.net/en/7": (None, "allow"), "no scheme": (None, "allow"), "": (None, "allow"), "http://free-bets.example.net/x?a=://b#c": (None, "block"),
    }
    rows = [(i, u, "x") for i, u in enumerate(cases)] + [(99, None, "x")]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string")).collect()}
    for i, (rule, verdict) in enumerate(cases.values()):
        assert got[i].rule == rule and (verdict is None or got[i].verdict == verdict), rows[i]
    assert (got[0].host, got[0].path) == ("sub.example.org", "/es/1") and got[99].host == got[99].path == ""
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_tiles_are_maximal_and_catch_reordered_passages():
    item = list(range(60))
    text = [900, *item[30:60], 901, *item[0:30], 902]
    assert sorted(decontaminate.tile(item, text)) == [(0, 32, 30), (30, 1, 30)]
    rng = random.Random(4)
    for _ in range(150):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 24))] for _ in range(2))
        tiles = decontaminate.tile(a, b, 3)
        used_a, used_b = [], []
        for p, s, n in tiles:
            assert n >= 3 and a[p : p + n] == b[s : s + n]
            used_a += range(p, p + n)
            used_b += range(s, s + n)
        assert len(set(used_a)) == len(used_a) and len(set(used_b)) == len(used_b)
        left_a, left_b = [i not in used_a for i in range(len(a))], [i not in used_b for i in range(len(b))]
        assert not any(all(left_a[i : i + 3]) and all(left_b[j : j + 3]) and a[i : i + 3] == b[j : j + 3] for i in range(len(a) - 2) for j in range(len(b) - 2))
        if tiles:
            longest = max((n for i in range(len(a)) for j in range(len(b)) for n in range(1, 25) if i + n <= len(a) and j + n <= len(b) and a[i : i + n] == b[j : j + n]), default=0)
            assert tiles[0][2] == longest


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_contamination_by_either_way(spark, sent):
    item = " ".join(f"w{i}" for i in range(40))
    words = item.split()
    docs = [(1, f"before {item} after", "x"), (2, " ".join(words[20:] + ["x"] + words[:20]).upper(), "x"), (3, " ".join(words[:12]) + " else", "x"), (4, None, "x"), (5, "", "x"), (1, f"before {item} after", "x"), (6, "z " * 50000 + item, "x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (10, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.coverage) for r in decontaminate.overlaps(table, bench, sent_bytes=sent).collect())
    assert got == [(1, 7, 1.0), (1, 7, 1.0), (2, 7, 1.0), (6, 7, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.keep_clean(table, bench, sent_bytes=sent).collect()) == [3, 4, 5]
    assert decontaminate.overlaps(table.limit(0), bench, sent_bytes=sent).count() == 0
    assert decontaminate.overlaps(table, bench.limit(0), sent_bytes=sent).count() == 0


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_items_whose_id_repeats_or_is_null_are_compared_each(spark, sent):
    passage = lambda c: " ".join(f"{c}{i}" for i in range(30))
    table = spark.createDataFrame([(i, f"before {passage(c)} after") for i, c in enumerate("abcdef")] + [(None, passage("a"))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage("a")), (7, passage("b")), (None, passage("c")), (None, passage("d")), (8, passage("e")), (8, passage("e"))], "item_id long, text string")
    got = [(r.doc_id, r.item_id, r.coverage) for r in decontaminate.overlaps(table, bench, sent_bytes=sent).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(0, 7, 1.0), (None, 7, 1.0), (1, 7, 1.0), (2, None, 1.0), (3, None, 1.0), (4, 8, 1.0), (4, 8, 1.0)]))
    assert [r.doc_id for r in decontaminate.keep_clean(table, bench, sent_bytes=sent).collect()] == [5]


def test_forward_sums_all_segmentations():
    automaton, n = langid.vocabulary()
    rng = np.random.default_rng(3)
    p = (rng.random(n) / n).tolist() + [langid.OTHER]
    for word in ("the", "über", "xq漢z", "internationally"):
        ends = langid.lattice(word, automaton)

        def paths(at, ends=ends):
            return 1.0 if at == 0 else sum(paths(start) * p[piece] for start, piece in ends[at])

        assert np.isclose(np.exp(langid.log_probability(ends, p)), paths(len(word) + 1))
    scorer = langid.Scorer(["a"], np.array([p]), None)
    words = ["the", "über", "xq漢z", "internationally", "a" * 400]
    scorer.learn(words)
    for w in words:
        assert np.isclose(scorer.scores[scorer.known[w], 0], langid.log_probability(langid.lattice(w, automaton), p))
    assert langid.log_probability(langid.lattice("q" * 3000, automaton), p) < -5000


def test_language_of_texts(spark):
    docs = []
    for i in range(160):
        docs.append((i, "the house and the garden with thing number " + str(i), "en"))
        docs.append((1000 + i, "der garten und das haus mit einer nummer " + str(i), "de"))
    odd = [(5001, None, "en"), (5002, "", "en"), (5003, "12 !?", "de"), (5005, "² ½", "de"), (5004, "the garden " * 60000, None), (None, "und das haus", None)]
    rows = spark.createDataFrame([(*d, "x") for d in docs + odd], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(rows).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in docs)
    assert {got[i].lang_pred for i in (5001, 5002, 5003, 5005)} == {"und"}
    assert got[5004].lang_pred == "en" and got[None].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(rows.limit(0)).count() == 0


def test_toxicity_learns_and_shares_subwords(spark):
    rng = random.Random(1)
    plain = ["table", "garden", "river", "window", "cloud", "paper", "music", "yellow", "little", "walking"]
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 4 == 0:
            words[rng.randrange(20)] = rng.choice(["stupid", "idiot"])
        docs.append((i, " ".join(words), "x"))
        labels.append((i, i % 2, int(i % 4 == 0)))
    odd = [(9001, None, "x"), (9002, "", "x"), (9003, "!!!", "x"), (9004, "river stupidd garden idiots window", "x"), (9005, "river " * 50000, "x"), (None, "cloud", "x")]
    table = spark.createDataFrame(docs + odd, "doc_id long, text string, score string")
    truth = spark.createDataFrame([*labels, (5, 0, None), (None, 1, 1), (0, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_texts(table, truth).collect()}
    held = [i for i in range(600) if got[i].held_out]
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i in held]) > 0.95
    assert got[9004].score > got[9005].score and all(0 <= r.score <= 1 for r in got.values())
    assert got[9001].score == got[9002].score == got[9003].score
    kept = {r.doc_id for r in toxicity.keep_clean(table, truth).collect()}
    assert kept == {i for i, r in got.items() if r.score < toxicity.THRESHOLD}
    assert toxicity.score_texts(table.limit(0), truth).count() == 0
    assert {r.predicted for r in toxicity.score_texts(table, truth.limit(0)).collect()} == {0}
