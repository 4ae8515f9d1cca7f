import re

import corpus_pipeline
from textwarden.llm import decontaminate, jaccard, toxicity
from textwarden.llm.common import table, written

DATA = "/root/testdata/sf0.001"


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs, given = table(spark, DATA, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        docs = written(stage(spark, docs, DATA))
        if name != "pieces":
            assert docs.columns == given["toxicity"].columns
    model = toxicity.train(given["toxicity"], table(spark, DATA, "labels"))
    scores = {k: model.score(model.counts(t))[0] for k, t in rows(given["toxicity"]).items()}
    clean = rows(given["near_duplicates"])
    assert set(clean) == {k for k, p in scores.items() if p < corpus_pipeline.REJECT}
    groups = jaccard.brute_force(clean)
    single = rows(given["decontamination"])
    assert set(single) == {k for k, (_, least) in groups.items() if k == least}
    items = {r["item_id"]: r["text"] for r in table(spark, DATA, "benchmark").collect()}
    hit = decontaminate.brute_force(single, items)
    left = rows(given["pii"])
    assert set(left) == {k for k, (n, h, _) in hit.items() if h <= 0.5 * max(n, 1)}
    assert all(left[k] == single[k] for k in left if not hit[k][1])
    assert all(len(decontaminate.words(left[k])) == hit[k][0] - hit[k][1] for k in left)
    final = {r["doc_id"]: r for r in docs.collect()}
    address = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert set(final) == set(left) and all(r["round_trip"] for r in final.values())
    assert not any(address.search(r["text"]) for r in final.values())
    assert any(address.search(t) for t in left.values())
    assert all(r["n_chars"] == len(r["text"]) for k, r in final.items() if r["text"] != rows(given["toxicity"])[k])


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0
