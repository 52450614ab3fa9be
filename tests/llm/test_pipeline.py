import corpus_pipeline
from glyphlake.llm import bpe, decontaminate, simhash, toxicity
from glyphlake.llm.common import load

SMALL = "/root/testdata/sf0.001"


def test_pipeline_equals_the_stages_by_brute_force(spark):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, SMALL).collect()}
    docs = load(spark, SMALL, "documents")
    clean = {r.doc_id for r in toxicity.score_texts(docs, load(spark, SMALL, "labels")).collect() if r.score < toxicity.THRESHOLD}
    rows = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in clean}
    best = {}
    for i, t in rows.items():
        best[t] = max(i, best.get(t, i))
    rows = {i: rows[i] for i in best.values()}
    prints = {i: simhash.fingerprint(t) for i, t in rows.items()}
    root = {i: i for i in rows}
    changed = True
    while changed:
        changed = False
        for i in rows:
            for j in rows:
                if root[j] < root[i] and (prints[i] ^ prints[j]).bit_count() <= 2:
                    root[i], changed = root[j], True
    rows = {i: t for i, t in rows.items() if root[i] == i}
    items = decontaminate.Items([(r.item_id, r.text) for r in load(spark, SMALL, "benchmark").collect()])
    rows = {i: t for i, t in rows.items() if not items.matches([t], decontaminate.COVERED)}
    assert got.keys() == rows.keys()
    assert all(got[i][0] == len(bpe.encoder().encode(t)) for i, t in rows.items())


def test_stages_keep_the_columns(spark):
    docs = load(spark, SMALL, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
