"""The stages of the pipeline on the small tables: what each keeps, by plain Python over what it was given."""

import corpus_pipeline
from barloom.llm.common import table
from barloom.session import cut_lineage

SMALL = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    return {b" ".join(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_stages(spark):
    docs = table(spark, SMALL, "documents")
    given = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, cut_lineage(stage(spark, docs, SMALL))
        given[name] = (before, docs)
        if name != "pack_sequences":
            assert docs.dtypes == before.dtypes
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    before, after = map(texts, given["near_dedup"])
    sets = {d: shingles(t) for d, t in before.items()}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert after == {d: before[d] for d in before if find(d) == d}

    before, after = map(texts, given["decontamination"])
    items = [s for s in (shingles(r.text) for r in table(spark, SMALL, "benchmark").collect()) if s]
    assert after == {d: t for d, t in before.items() if not any(100 * len(s & shingles(t)) >= 75 * len(s) for s in items)}

    before, after = map(texts, given["secret_scan"])
    assert before.keys() == after.keys()
    pieces = given["pack_sequences"][1].collect()
    assert {r.doc_id for r in pieces} == after.keys() and all(r.offset + r.length <= 4096 for r in pieces)
