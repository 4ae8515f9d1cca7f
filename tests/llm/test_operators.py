import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from textwarden.llm import decontaminate, jaccard, licenses, neighbours, pieces, pii, quality, sharding, tokens, toxicity
from textwarden.llm.common import held_out, table, written

DATA = "/root/testdata/sf0.01"
ODD = [(90, None), (91, ""), (92, " \t\n"), (93, "é" * 50_000), (None, "a null id and some words more than ten in all of it")]


def frame(spark, rows, schema="doc_id long, text string"):
    return written(spark.createDataFrame(list(rows), schema))


def test_windows_are_found_as_defined(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(12)]
    items = {i: " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 14, 30]))) for i in range(3, 15)} | {40: "", 41: None}
    texts = {i: " ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for i in range(60)}
    for i in range(60, 75):
        item = (items[rng.randint(3, 14)] or "").split()
        texts[i] = "Start, " + "; ".join(item).upper() + " end"
    for only in (items, {k: v for k, v in items.items() if v and len(v.split()) > 9}):
        want = decontaminate.brute_force(texts, only)
        bench = frame(spark, only.items(), "item_id long, text string")
        docs = frame(spark, [*texts.items(), *ODD])
        for most in (decontaminate.MAX_WORDS, 60):
            rows = decontaminate.match(docs, bench, max_words=most).collect()
            got = {r["doc_id"]: (r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), r["items"]) for r in rows}
            assert {k: got[k] for k in texts} == want and len(rows) == len(texts) + len(ODD)


def test_removal_leaves_clean_texts_alone(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = frame(spark, [(1, f"before, {item.upper()}! after " + "words " * 30, 7), (2, "clean", 5), (3, item, 9), (4, None, 0)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in decontaminate.remove(docs, frame(spark, [(1, item)], "item_id long, text string")).collect()}
    assert got[1]["text"] == "before, ! after " + "words " * 30 and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "clean" and got[2]["n_chars"] == 5 and got[4]["text"] is None and 3 not in got


@pytest.mark.parametrize("most", [decontaminate.MAX_WORDS, 8])
def test_columns_of_any_name_come_back(spark, most):
    items = frame(spark, [(1, "one two three four five six seven eight nine ten"), (2, "red green blue cyan pink grey teal gold lime navy plum")], "item_id long, text string")
    rows = [(i, f"{'w ' * 30}{t} end", i * 3, "h", [i]) for i, t in enumerate(["one two three four five six seven eight nine ten", "plain", "red green blue cyan pink grey teal gold lime navy"])]
    docs = frame(spark, rows, "doc_id long, text string, _row long, hits string, items array<long>")
    got = {r["doc_id"]: r for r in decontaminate.remove(docs, items, max_words=most).collect()}
    assert all(got[i]["_row"] == i * 3 and got[i]["hits"] == "h" and got[i]["items"] == [i] for i in range(3))
    assert [got[i]["text"] for i in range(3)] == ["w " * 30 + " end", rows[1][1], "w " * 30 + " end"]
    assert decontaminate.remove(docs.limit(0), items).count() == 0 and decontaminate.report(docs, items.limit(0)).where("n_hit > 0").count() == 0
    long = frame(spark, [(1, "w " * 5000 + "one two three four five six seven eight nine ten " * 200)])
    assert decontaminate.remove(long, items).first()["text"].split() == ["w"] * 5000


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for i in range(150)}
    for i in range(150, 330):
        words = texts[rng.randint(0, i - 1)].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts[i] = " ".join(words)
    base = rng.choices(vocabulary, k=80)
    for i in range(2000, 2060):
        texts[i] = " ".join([*base[: i % 80], f"x{i}", *base[i % 80 + 1 :]])
    texts |= {k: v for k, v in ODD if k is not None}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, texts.items())).collect()}
    assert got == jaccard.brute_force(texts)


def test_texts_are_shuffled_when_too_many_are_looked_up(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SENT_ROWS", -1)
    base = [f"w{i}" for i in range(90)]
    texts = {i: " ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(80, 90)} | {1: "some other text of a few words", 2: None}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, texts.items())).collect()}
    assert got == jaccard.brute_force(texts)


@pytest.mark.parametrize("hot", [2, 6])
def test_pages_of_a_template_and_their_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(400)]
    template, sections = rng.choices(vocabulary, k=60), [rng.choices(vocabulary, k=9) for _ in range(3)]
    texts = {}
    for i in range(120):
        own = sections[i % 3] + rng.choices(vocabulary, k=rng.choice([3, 20]))
        texts[i] = " ".join([*template, *own])
    for i in range(120, 170):
        words = texts[rng.randint(0, 119)].split()
        words[rng.randrange(60, len(words))] = f"x{i}"
        texts[i] = " ".join(words)
    texts |= {i: " ".join(rng.choices(vocabulary, k=70)) for i in range(170, 180)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, texts.items())).collect()}
    want = jaccard.brute_force(texts)
    assert got == want and 20 < len({c for _, c in want.values()}) < 175


def test_nodes_that_share_too_few_keys_drop_out():
    rng, sketcher = np.random.default_rng(4), jaccard.Sketcher()
    for n in (6, 9, 20, 60, 300, 1500):
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            lost = int(rng.integers(0, max(1, len(a) // 9)))
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 1 << 63, lost, dtype=np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)) or np.array_equal(a, b):
                continue
            common = np.intersect1d(sketcher.keys(a), sketcher.keys(b))
            shared = np.bincount((common & np.uint64(1)).astype(np.int64), minlength=2)
            assert any(shared[p] >= max(sketcher.need(a)[p], sketcher.need(b)[p]) for p in (0, 1))


@pytest.mark.parametrize("hot", [jaccard.HOT, 8])
def test_links_that_share_few_keys_outlast_every_round(spark, monkeypatch, hot):
    # a text and its continuation share as few keys as a link can; each has a nearer text that does not link with the other's,
    # and pages that link with nothing hold the least nodes of the keys
    monkeypatch.setattr(jaccard, "HOT", hot)
    texts = {}
    for seed, v in ((37544, 2), (37575, 0), (40511, 1)):
        rng = random.Random(v)
        x = [f"a{seed}.{i}" for i in range(50)]
        y = x + [f"b{seed}.{i}" for i in range(11)]
        family = [x, ["z", *x[1:]], y, ["w", *y[1:]]]
        for i in range(10):
            h = rng.choice([6, 7])
            family += [[*(f"p{v}.{i}.{j}.{len(base)}" for j in range(h)), *base[h:]] for base in (x, y)]
        texts |= {len(texts) + i: " ".join(t) for i, t in enumerate(family)}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(frame(spark, texts.items())).collect()}
    assert got == jaccard.brute_force(texts)


def test_rows_keep_their_names_when_files_are_split_anew(spark, monkeypatch, tmp_path):
    rng = random.Random(3)
    base = [rng.choices([f"w{i}" for i in range(300)], k=60) for _ in range(40)]
    rows = [(i, " ".join([*base[i % 40][:59], f"z{i}"]), i * 7, f"f{i}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, _row long, file string").repartition(3).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = jaccard.brute_force({r[0]: r[1] for r in rows})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    sets = jaccard._sets

    def split_anew(*given):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(rng.choice([2000, 5000, 90_000])))
        return sets(*given)

    monkeypatch.setattr(jaccard, "_sets", split_anew)
    try:
        got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs).collect()}
        kept = jaccard.representatives(docs).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {k: c for k, (_, c) in want.items()}
    assert sorted(r["doc_id"] for r in kept) == sorted({c for _, c in want.values()})
    assert all(r["_row"] == r["doc_id"] * 7 and r["file"] == f"f{r['doc_id']}" for r in kept)
    assert jaccard.join(docs.limit(0)).count() == 0 == jaccard.representatives(docs.limit(0)).count()


@pytest.mark.parametrize("block", [1 << 19, 64, 7])
def test_shingles_do_not_depend_on_blocks(monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "A b", "one two three four five", "x" * 3000 + " y", *("".join(rng.choices("aAbB é \x1f\x0b\t\n  z ", k=rng.randint(0, 300))) for _ in range(200))]
    words = [(t or "").encode().lower().split() for t in texts]
    want = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    got = jaccard.Shingler().many(texts)
    assert [len(x) for x in got] == [len(x) for x in want]
    for _ in range(2000):
        i, j = rng.randrange(len(texts)), rng.randrange(len(texts))
        assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_shared_keys_do_not_depend_on_batches():
    class Rows:
        def mapInArrow(self, run, schema):
            return run

    run, rng = jaccard._shared(Rows()), random.Random(1)
    for _ in range(500):
        rows = sorted((rng.randint(-3, 4), rng.randint(-6, 6)) for _ in range(rng.randint(0, 40)))
        batches, at = [], 0
        while at < len(rows):
            part, at = rows[at : at + (n := rng.choice([0, 1, 1, 2, 3, 5, 9]))], at + n
            batches.append(pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], pa.int64()) for i in (0, 1)], names=["key", "node"]))
        want = []
        for key in {r[0] for r in rows}:
            nodes = sorted({r[1] for r in rows if r[0] == key})
            want += [(key, x, nodes[0], len(nodes) > 2) for x in (nodes if len(nodes) > 2 else nodes[1:])]
        assert sorted(tuple(r.values()) for b in run(iter(batches)) for r in b.to_pylist()) == sorted(want)


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g"), (3, "A b c d e  f g"), (3, "A b c d e  f g"), (7, ""), (8, ""), (9, None), (None, "z y x")]
    kept = [r["doc_id"] for r in jaccard.representatives(frame(spark, rows)).collect()]
    assert sorted(kept, key=str) == [3, 7, 8, 9, None]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for n, m in ((10, 12), (60, 70), (500, 520), (1000, 1100)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, m - n // 2, dtype=np.uint64)]))
        assert jaccard.distance(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, least, most in (("card", r"[0-9]([\x20-]?[0-9])+", 16, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 8, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_brute_force(spark):
    texts = {1: "a@b.c%d@e.f x", 2: "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", 3: "4111 1111-1111 1111 x 4111111111111111", 4: "😀 +1 (555) 555-0199 é +49.30 1234567-", 5: "..a@b..c a@b.c.d@e.f @x.y a@-.-", 6: "99999999999999999999.1.1.1 1.1.1.1"}
    rng = random.Random(4)
    texts |= {i: "".join(rng.choices("01+@.-ab (é", k=80)) for i in range(10, 80)}
    rows = pii.report(frame(spark, [*texts.items(), *ODD])).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + len(ODD)
    for k, t in {**texts, 90: ""}.items():
        want = base_spans(t)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in want).encode()).hexdigest()
        assert [got[k][f"n_{x}"] for x in pii.KINDS] == [sum(s[0] == x for s in want) for x in pii.KINDS]


def test_contexts_of_seeds_find_unseen_identifiers(spark):
    rows = [(i, f"reach 10.0.0.{i} today, plain words {i}") for i in range(8)] + [(20, "please reach QX-99182-77 today"), (21, "version 12345678 only")]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    assert got[20] == "ip:13:24" and got[21] == ""
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert text[20] == "please reach [ip] today" and text[21] == rows[-1][1]


@pytest.mark.parametrize(("module", "label", "modulus", "remainder", "least"), [(toxicity, "toxic", 3, 1, 0.93), (quality, "quality", 4, 2, 0.9)])
def test_held_out_accuracy(spark, module, label, modulus, remainder, least):
    docs, labels = table(spark, DATA, "documents").select("doc_id", "text"), table(spark, DATA, "labels")
    model = module.train(docs, labels)
    rows = module.score(docs.where(held_out(F.col("doc_id"), modulus, remainder)), model).join(labels, "doc_id").select("score", label).collect()
    assert np.mean([(r["score"] >= 0.7) == (r[label] == 1) for r in rows]) >= least
    odd = module.score(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_labels(spark, module):
    docs = frame(spark, [(1, "some text"), (2, None)])
    model = module.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r["score"] for r in module.score(docs, model).collect()] == [0.5, 0.5]


def test_block_max_search_is_exact():
    rng = np.random.default_rng(3)
    vectors = []
    for _ in range(300):
        t = np.unique(rng.integers(0, 40, rng.integers(1, 9)))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum())))
    dense = np.zeros((300, 40))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    ids = rng.permutation(300)
    index, skipped = toxicity.BlockMaxIndex(vectors, ids, 40, block=8), 0
    for t, w in vectors[:60]:
        rows, cosines, opened = index.search(t, w, 5)
        all_ = dense[:, t] @ w
        order = np.lexsort((ids, -np.round(all_, 9)))[:5]
        assert index.ids[rows].tolist() == ids[order].tolist() and np.allclose(cosines, all_[order])
        skipped += opened < index.blocks
    assert skipped


def test_vocabulary_does_not_shrink_with_the_sample(spark):
    rows = [(i, f"plain words {'rareslur' if i % 2 and i < 64 else 'and'} {'vile' if i % 2 and i % 20 else 'kind'}") for i in range(4200)]
    labels = frame(spark, [(i, i % 2) for i in range(4200)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), labels)
    assert len(model.label) > 2000 and b"rareslur" in model.vocabulary
    assert model.score(model.counts("a rareslur here"))[0] >= 0.7 > model.score(model.counts("a kind text"))[0]


@pytest.mark.parametrize("per_class", [40, 3000])
def test_words_that_part_the_labels_wholly_give_high_scores(spark, per_class):
    rows = [(i, f"plain words and w{i % 7} {('vile' if i % 4 == 1 else 'foul') if i % 2 else ''}") for i in range(400)]
    model = toxicity.train(frame(spark, rows), frame(spark, [(i, i % 2) for i in range(400)], "doc_id long, toxic int"), per_class=per_class)
    got = {t: model.score(model.counts(t)) for t in ("so vile", "foul foul words", "plain words", "", "vile " * 5000)}
    assert got["so vile"][0] >= 0.7 and got["foul foul words"][0] >= 0.7 and got["vile " * 5000][0] >= 0.7
    assert got["plain words"][0] < 0.1 and got[""][0] < 0.1
    assert [y for _, y, _ in got["so vile"][1]] == [1, 1, 1]
    one = toxicity.train(frame(spark, rows), frame(spark, [(i, 1) for i in range(400)], "doc_id long, toxic int"))
    assert one.score(one.counts("so vile"))[0] > 0.9


def test_scores_at_the_cap_of_the_sample(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text"), table(spark, "/root/testdata/sf0.1", "labels")
    model = toxicity.train(docs, labels, per_class=300)
    rows = toxicity.score(docs.where(held_out(F.col("doc_id"), 3, 1)), model).join(labels, "doc_id").select("score", "toxic").collect()
    said = [r["toxic"] for r in rows if r["score"] >= 0.7]
    assert len(said) > 60 and sum(said) / len(said) > 0.95


def test_toxicity_against_dense_vectors(spark):
    docs, labels = table(spark, DATA, "documents").select("doc_id", "text"), table(spark, DATA, "labels")
    model = toxicity.train(docs, labels)
    terms, n = model.vocabulary, len(model.label)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    dense = lambda t: np.array([(1 + np.log(c)) * model.idf[terms[w]] if (c := Counter(decontaminate.words(t))[w]) else 0.0 for w in sorted(terms)])
    unit = lambda x: x / np.sqrt((x * x).sum()) if x.any() else x
    known = np.array([unit(dense(text[int(d)])) for d in model.index.ids])
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    for d in sorted(text)[::9]:
        cosine = known @ unit(dense(text[d]))
        best = [j for j in np.lexsort((model.index.ids, -np.round(cosine, 9))) if cosine[j] > 0][: model.k]
        assert [(e["doc_id"], e["label"]) for e in got[d]["evidence"]] == [(int(model.index.ids[j]), int(model.label[j])) for j in best[:3]]
        weight = cosine[best] ** 2 * model.weight[best]
        unit_vote = 0.05 * model.weight.mean()
        vote = ((weight * model.label[best]).sum() + unit_vote * model.prior) / (weight.sum() + unit_vote)
        assert abs(got[d]["score"] - toxicity.logistic(model.feature(np.array([vote])), model.curve)[0]) < 1e-6
    assert n == len(known)


@pytest.mark.parametrize(("rows", "dense"), [(300, 1), (300, 32), (300, 10**6), (5, 32)])
def test_batches_find_what_single_searches_find(monkeypatch, rows, dense):
    monkeypatch.setattr(toxicity, "DENSE", dense)
    rng = np.random.default_rng(8)
    vectors = []
    for _ in range(rows):
        t = np.unique(rng.integers(0, 40, rng.integers(1, 9)))
        w = rng.choice([1.0, 2.0], len(t))
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(vectors, rng.permutation(rows), 40, block=8)
    for without in (None, rng.integers(0, rows, rows)):
        for i, (got, cosines) in enumerate(index.search_many(vectors, 5, without)):
            want, exact, _ = index.search(*vectors[i], 5, None if without is None else without[i])
            assert got.tolist() == want.tolist() and np.allclose(cosines, exact)


def test_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[50:90] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0]), (None, x[1].tolist()), (5, x[5].tolist())]
    df = written(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {}
    for r in neighbours.search(df, df.where("vec_id % 50 = 0"), shard_rows=120, pass_bytes=3 * 16 * 8).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    v = x.astype(np.float64)
    found = 0
    for q in range(0, 400, 50):
        cosine = (v @ v[q]) / np.sqrt((v * v).sum(1)) / np.sqrt((v[q] ** 2).sum())
        best = [i for i in np.lexsort((np.arange(400), -np.round(cosine, 12))) if i != q][:5]
        assert len(got[q]) == 5 and all(abs(s - cosine[i]) < 1e-9 for i, s in got[q])
        found += len(set(best) & {i for i, _ in got[q]})
    assert found >= 36 and [i for i, _ in got[0]] == [50, 51, 52, 53, 54]
    assert neighbours.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("shards", [1, 2, 8, 32])
def test_recall_does_not_depend_on_shards(shards):
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((40, 32))
    x = centres[rng.integers(0, 40, 8000)] + 1.5 * rng.standard_normal((8000, 32))
    ids, asked = np.arange(8000), np.arange(0, 8000, 100)
    some = rng.choice(8000, 1500, replace=False)
    known = neighbours.bounds(x[asked], asked, x[some], some, 5)
    cosine = (x @ x.T) / np.sqrt((x * x).sum(1))[:, None] / np.sqrt((x * x).sum(1))[None, :]
    near = {int(q): [] for q in asked}
    verified = 0
    for i in range(shards):
        shard = neighbours.Shard(x[i::shards], ids[i::shards])
        for q, b in zip(asked.tolist(), known, strict=True):
            near[q] += shard.search(q, x[q], b)
        verified += shard.verified
    found = 0
    for q, got in near.items():
        best = [i for i in np.argsort(-cosine[q], kind="stable") if i != q][:5]
        assert all(abs(s - cosine[q, v]) < 1e-12 for s, v in got)
        found += len(set(best) & {v for _, v in sorted((-s, v) for s, v in got)[:5]})
    assert found >= 0.95 * 5 * len(asked) and verified < 0.3 * len(x) * len(asked)


def test_every_copy_is_a_neighbour_and_none_is_lost(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal(8)
    rows = [(i, (base if i % 3 == 0 else rng.standard_normal(8)).tolist()) for i in range(300)]
    df = written(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = neighbours.search(df, df.where("vec_id in (0, 150, 3)"), shard_rows=50).collect()
    mine = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got)
    assert mine == [(q, k + 1, v) for q in (0, 3, 150) for k, v in enumerate([x for x in (0, 3, 6, 9, 12, 15) if x != q][:5])]
    few = neighbours.search(df.where("vec_id < 3"), df.where("vec_id = 0")).collect()
    assert sorted(r["vec_id"] for r in few) == [1, 2]


def test_sharding_is_even_and_stable(spark):
    a = sharding.lookup({f"s{i}": 1 for i in range(10)}, 1009)
    b = sharding.lookup({f"s{i}": 1 for i in range(9)}, 1009)
    counts = Counter(a)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(x != y for x, y in zip(a, b, strict=True) if x != "s9")
    assert moved < 0.3 * 1009
    heavy = Counter(sharding.lookup({"a": 3, "b": 1}, 101))
    assert 74 <= heavy["a"] <= 77
    rows = sharding.assign(frame(spark, [(1, "x"), (1, "y"), (None, "z")]), ["doc_id"], {"a": 1, "b": 1}, 101).collect()
    assert len(rows) == 3 and len({r["shard"] for r in rows if r["doc_id"] == 1}) == 1
    for bad in (100, 99991):
        with pytest.raises(ValueError):
            sharding.lookup({"a": 1}, bad)


def test_each_row_goes_where_its_hash_says(spark):
    shards = {f"s{i}": 1 + i % 3 for i in range(7)}
    rows = [(i, "x", i * 2) for i in range(200)] + [(None, "y", 1), (5, "z", 2)]
    got = sharding.assign(frame(spark, rows, "doc_id long, text string, SLOT int"), ["doc_id", "text"], shards, 101).collect()
    table_ = sharding.lookup(shards, 101)

    def place(*keys):
        h = 42
        for k in keys:
            h = xxhash.xxh64_intdigest((0 if k is not None else 1).to_bytes(4, "little"), h)
            h = h if k is None else xxhash.xxh64_intdigest(str(k).encode(), h)
        return (h - (1 << 64) if h >> 63 else h) % 101

    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "slot", "shard"}
    assert all(r["slot"] == place(r["doc_id"], r["text"]) and r["shard"] == table_[r["slot"]] for r in got)
    assert sharding.assign(frame(spark, []), ["doc_id"], shards, 101).count() == 0
    # the rule itself, slot by slot
    order = lambda n: ((sharding._hash(n, "offset") + j * (sharding._hash(n, "skip") % 100 + 1)) % 101 for j in range(101))
    taken, turn = {}, {n: order(n) for n in sorted(shards)}
    while len(taken) < 101:
        for n in sorted(shards):
            for _ in range(shards[n]):
                if len(taken) < 101:
                    taken[next(x for x in turn[n] if x not in taken)] = n
    assert [taken[i] for i in range(101)] == table_


def test_scans_equal_alignment_at_every_place(spark):
    rng = random.Random(21)
    index = licenses.Index(licenses.TEMPLATES)
    plain = {n: [w.decode() for w in decontaminate.words(t)] for n, t in licenses.TEMPLATES.items()}
    texts = {}
    for i in range(80):
        parts = []
        for _ in range(rng.randint(1, 3)):
            ws = list(plain[rng.choice(sorted(plain))])
            for _ in range(rng.choice([0, 0, 1, 2])):
                ws[rng.randrange(len(ws))] = rng.choice(["zz", "license", "the"])
            parts += rng.choices(["aa", "the", "license", "under"], k=rng.randint(9, 15)) + ws
        texts[i] = " ".join(parts)
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(frame(spark, [*texts.items(), (500, None), (501, "")])).collect()}
    for i, text in texts.items():
        ws, found = decontaminate.words(text), set()
        ids = [index.vocabulary.get(w, -1) for w in ws]
        for t, name in enumerate(index.names):
            need = 0.8 * len(index.texts[t])
            left = [(0, len(ids))]
            while left:
                a, b = left.pop()
                matched, x, y = index.align(t, ids[a:b], -len(ids), len(ids), need) if b > a else (0, 0, 0)
                if matched and matched >= need:
                    found.add((name, round(matched / len(index.texts[t]), 9)))
                    left += [(a, a + x), (a + y, b)]
        names = {(x["name"], round(x["coverage"], 9)) for x in got[i]}
        assert names <= found and {n for n, _ in found} - {n for n, _ in names} <= {n for n, c in found if any(c <= d for _, d in names)}
        assert all(" ".join(text[x["start"] : x["end"]].split()) for x in got[i])
    assert got[500] == got[501] == []


def test_quality_scores_equal_sizes_of_compressed_blocks(spark):
    docs, labels = table(spark, DATA, "documents").select("doc_id", "text"), table(spark, DATA, "labels")
    model = quality.train(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(got) == len(text)
    for d in sorted(text)[::11]:
        raw, sizes = (text[d] or "").encode(), []
        for dictionary in (model.good, model.bad):
            z = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=False, write_content_size=False, write_dict_id=False)
            sizes.append(sum(len(z.compress(raw[i : i + quality.BLOCK])) for i in range(0, len(raw), quality.BLOCK)))
        x = 10 * (sizes[1] - sizes[0]) / max(1, sum(sizes))
        want = 1 / (1 + np.exp(-(x * model.curve[0] + model.curve[1]))) if raw else model.share
        assert abs(got[d] - want) < 0.02
    clash = quality.score(frame(spark, [(1, "some text", 3.0)], "doc_id long, text string, SCORE double"), model).collect()
    assert len(clash) == 1 and 0 <= clash[0]["score"] <= 1 and quality.score(docs.limit(0), model).count() == 0


def test_pieces_round_trip_and_best_sums(spark):
    texts = [(1, "Hello  world\n foo"), (2, "ｆｕｌｌ 😀 \t x"), (3, "  lead and trail  "), (4, "▁"), *ODD]
    got = {r["doc_id"]: r for r in pieces.encode(frame(spark, texts)).collect()}
    assert [k for k, r in got.items() if not r["round_trip"]] == [4]
    with open(pieces.MODEL, "rb") as f:
        v = pieces.Vocabulary(f.read())
    encoder = pieces.Encoder(v)
    rng = random.Random(1)
    units = ["▁" + "".join(rng.choices("thenaig▁é\t", k=rng.randint(1, 12))).replace("▁", "") for _ in range(300)]
    encoder([u[1:] for u in units])
    assert all(v.scalar(u) == np.frombuffer(ids, dtype="<i4").tolist() for u, ids in encoder.memo.items())
    assert got[90]["ids"] == [] and v.decode(list(got[1]["ids"])) == texts[0][1]


def test_whole_texts_equal_the_scalar_rule(spark, monkeypatch):
    v = pieces.Vocabulary(open(pieces.MODEL, "rb").read())
    texts = [r["text"] for r in table(spark, DATA, "documents").where("doc_id % 25 = 0").collect()] + [t for _, t in ODD]
    encoder = pieces.Encoder(v)
    ids, at, same = encoder(texts)
    want = [encoder.exact(pieces.marked(t)) for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want and all(same)
    # a long text goes unit by unit, and what is remembered stays bounded
    monkeypatch.setattr(pieces, "CHARS", 1000)
    monkeypatch.setattr(pieces, "STEP", 50)
    small = pieces.Encoder(v, memory=20_000)
    for t, w in zip(texts, want, strict=True):
        got, _, _ = small([t])
        assert got.tolist() == w and small.held < 20_000 + 100 * 50 * (pieces._ENTRY + 100) and small.held <= 20_000 + len(t or "") * 400


def test_wrong_ids_are_replaced_and_compared_again(monkeypatch):
    v = pieces.Vocabulary(open(pieces.MODEL, "rb").read())
    right = pieces.Vocabulary.viterbi
    monkeypatch.setattr(pieces.Vocabulary, "viterbi", lambda self, units: [ids if "x" not in u else b"" for u, ids in zip(units, right(self, units), strict=True)])
    encoder = pieces.Encoder(v)
    texts = ["a fox ran", "", "no such", "▁ x", None]
    ids, at, same = encoder(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [encoder.exact(pieces.marked(t)) for t in texts]
    assert same == [True, True, True, False, True]
    monkeypatch.setattr(pieces.Encoder, "exact", lambda self, t: [])
    assert pieces.Encoder(v)(texts)[2] == [False, True, True, False, True]


def test_token_counts_by_each_rule(spark):
    texts = [(1, "first line\n\n\nsecond  line é\n  x"), (2, "one"), *ODD]
    whole = {}
    with open(tokens.VOCABULARY, "rb") as f:
        counter = tokens.Counter(f.read())
    for rule in tokens.RULES:
        rows = tokens.count(frame(spark, texts), rule=rule).collect()
        for k, t in texts:
            mine = sorted((r for r in rows if r["doc_id"] == k), key=lambda r: r["section"])
            assert round(sum(r["n_tokens"] for r in mine), 6) == len(counter.encoding.encode_ordinary(t or ""))
            assert [(t or "")[r["start_char"] : r["end_char"]] for r in mine] == ((t or "").splitlines(keepends=True) if t and "\t" not in t else [t or ""]) or k == 92
            whole[rule, k] = [r["n_tokens"] for r in mine]
    # by hand: each token's bytes, dealt to lines one by one
    text = texts[0][1]
    line = np.cumsum([0] + [b == 10 for b in text.encode()])[:-1]
    want, at = np.zeros(line[-1] + 1), 0
    for i in counter.encoding.encode_ordinary(text):
        n = int(counter.lengths[i])
        want += np.bincount(line[at : at + n], minlength=len(want)) / n
        at += n
    assert np.allclose(whole["shared", 1], want)
    fields = tokens.count(frame(spark, [(1, "a b", None, "c")], "doc_id long, text string, url string, lang string"), ["url", "text", "lang"]).collect()
    assert [r["section"] for r in fields] == [0, 1, 2]


def test_licenses(spark):
    rows = [(1, "intro. Licensed under the Apache License, Version 2.0 end"), (2, "licensed under the MIT"), (3, "Released, under\nthe MIT licence? Released under the MIT License. x"), (4, "This work was licensed under the GNU General Public License version 3"), *ODD]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(frame(spark, rows)).collect()}
    assert [(x["name"], rows[0][1][x["start"] : x["end"]]) for x in got[1]] == [("Apache-2.0", "Licensed under the Apache License, Version 2.0")]
    assert got[2] == [] and {x["name"] for x in got[3]} == {"MIT"}
    assert [x["name"] for x in got[4]] == ["GPL-3.0"] and 0.8 <= got[4][0]["coverage"] < 1
    assert all(got[k] == [] for k, _ in ODD)


@pytest.mark.parametrize(("text", "between", "copies"), [("Released under the MIT License.", "\n", 1000), ("Released under the MIT License.", " one two three ", 2), ("Licensed under the Apache License, Version 2.0", "\n", 40)])
def test_each_copy_of_a_notice_is_a_span(text, between, copies):
    found = licenses.Index(licenses.TEMPLATES).scan(between.join([text] * copies))
    words, gap = len(decontaminate.words(text)), len(between.split())
    assert [(a, b) for _, _, a, b in found] == [(i * (words + gap), i * (words + gap) + words) for i in range(copies)]
    assert {c for _, c, _, _ in found} == {1.0}


def test_altered_notices_keep_a_fingerprint():
    index = licenses.Index(licenses.TEMPLATES)
    assert [x[:2] for x in index.scan("Released under an MIT License")] == [("MIT", 0.8)]
    for t, (name, ids) in enumerate(zip(index.names, index.texts, strict=True)):
        plain = [w.decode() for w in decontaminate.words(licenses.TEMPLATES[name])]
        lost = len(ids) - next(m for m in range(len(ids) + 1) if m >= 0.8 * len(ids))
        rng = random.Random(t)
        altered = [[*plain[:i], "zz", *plain[i:]] for i in range(1, len(plain))]
        for _ in range(200):
            drop = set(rng.sample(range(len(plain)), rng.randint(0, lost)))
            altered.append([x for i, w in enumerate(plain) for x in ([rng.choice(["zz", ""])] if i in drop else [w])])
        for ws in altered:
            text = " ".join(["before", "it", *ws, "after", "it"])
            got = [index.vocabulary.get(w, -1) for w in decontaminate.words(text)]
            matched, a, b = index.align(t, got, -len(got), len(got), 0.8 * len(ids))
            found = [x for x in index.scan(text) if x[0] == name]
            assert (matched >= 0.8 * len(ids)) == bool(found)
            assert not found or found == [(name, matched / len(ids), a, b)]


def test_a_long_document_shuts_out_no_other(spark):
    ids = [r["id"] for r in spark.range(120).orderBy(F.xxhash64("id", F.lit(29))).collect()]
    first = next(i for i in ids if i % 2)
    rng = random.Random(6)
    good, bad = [f"river{i} stone" for i in range(90)], [f"click{i} buy" for i in range(90)]
    texts = {i: " ".join(rng.choices(good if i % 2 else bad, k=9000 if i == first else 60)) for i in ids}
    labels = frame(spark, [(i, i % 2) for i in ids], "doc_id long, quality int")
    assert len(texts[first]) > 80_000
    model = quality.train(frame(spark, texts.items()), labels, modulus=1000, remainder=999, sample_bytes=70_000)
    assert model.curve is not None
    assert model.score(" ".join(good)) > 0.7 > model.score(" ".join(bad))


def test_long_texts_give_blocks_of_their_whole_length():
    assert quality.longest([5, 100, 9], 34) == 20 and quality.longest([5, 9], 34) == 9 and quality.longest([], 3) == 0
    raw = bytes(i % 251 for i in range(200_000))
    part = quality.excerpt(raw, 20_000, 7)
    assert 18_000 <= len(part) <= 20_000 and quality.excerpt(raw, len(raw), 7) == raw
    at = [raw.find(part[i : i + quality.BLOCK]) for i in range(0, len(part), quality.BLOCK)]
    assert all(x >= 0 for x in at)


def test_words_after_are_contexts(spark):
    rows = [(i, f"w{'abcdefgh'[i]} 10.0.0.{i} unreachable") for i in range(8)] + [(20, "host QX-99182-77 unreachable"), (21, "host QX-99182-78 fine")]
    got = {r["doc_id"]: r["spans"] for r in pii.report(frame(spark, rows)).collect()}
    assert got[20] == "ip:5:16" and got[21] == ""


def test_neighbouring_identifiers_are_each_marked(spark):
    rows = [(1, "id A1B2C3D D4E5F6G H7I8J9K"), (2, "at 10:30 password=9f2c11 8080"), (3, 'é k="A1B2C3" x'), (4, ""), (5, "A1B2C3\nD4E5F6")]
    got = {r["_in"]["doc_id"]: [(m["value"], list(m["contexts"])) for m in r["marks"]] for r in pii.located(frame(spark, rows)).collect()}
    assert got[1] == [("A1B2C3D", ["after id", "before d4e5f6g"]), ("D4E5F6G", ["after a1b2c3d", "before h7i8j9k"]), ("H7I8J9K", ["after d4e5f6g"])]
    assert got[2] == [("9f2c11", ["in password=", "after 10:30", "before 8080"])]
    assert got[3] == [("A1B2C3", [])] and got[4] == [] and got[5] == [("A1B2C3", []), ("D4E5F6", [])]
    for r in pii.located(frame(spark, rows)).collect():
        assert all(rows[r["_in"]["doc_id"] - 1][1][m["start"] : m["end"]] == m["value"] for m in r["marks"])


def bootstrapped(texts):
    """The definition of the added spans, for tests: id -> [(kind, start, end)]."""
    token = re.compile(r"""(?<![^\s"'<>,;|])[^\s"'<>,;|]*[0-9@][^\s"'<>,;|]*""")
    marks = {}
    for d, text in texts.items():
        base = base_spans(text)
        all_, marks[d] = list(token.finditer(text)), []
        for i, m in enumerate(all_):
            if len(m.group()) < pii.MIN_TOKEN:
                continue
            left = text[all_[i - 1].start() if i else 0 : m.start()]
            right = text[m.end() : all_[i + 1].end() if i + 1 < len(all_) else len(text)]
            lead = (re.match(r"([A-Za-z_.-]{2,32}[=:])[^=:]", m.group()) or ["", ""])[1]
            tail = len((re.search(r"[.:!?)\]}]+$", m.group()) or [""])[0])
            value = m.group()[len(lead) :][: max(1, len(m.group()) - len(lead) - tail)]
            name = lead[:-1] if lead else (re.search(r"""([A-Za-z_.-]{2,32})[ ]?[=:][ ]?["']?$""", left[-48:]) or ["", ""])[1]
            before, after = re.search(r"(?<!\S)(\S+)[ ]$", left), re.match(r"[ ](\S+)", right)
            contexts = [f"in {name.lower()}="] * bool(name) + ([f"after {before[1].lower()}"] if before else []) + ([f"before {after[1].lower()}"] if after else [])
            if re.match("[A-Za-z]{4}", value) and len(value) >= 12:
                contexts.append(" ".join(["form", value[:4], str(len(value)), *(c if re.search(f"[{c}]", value) else "" for c in ("a-z", "A-Z", "0-9", "_=+/.-"))]))
            start = m.start() + len(lead)
            seed = next((k for k in pii.KINDS for kind, a, b in base if kind == k and a < start + len(value) and b > start), None)
            if seed is None and (re.match(pii.SECRET_NAMES, name) or re.match(pii.KEY_FORMATS, value)):
                seed = "secret"
            marks[d].append((start, start + len(value), value, contexts, seed))
    kind = {}
    for _, _, value, contexts, seed in (m for ms in marks.values() for m in ms):
        for c in contexts:
            kind[c, value] = max(kind.get((c, value)) or "", seed or "") or None
    held = {}
    for c, v in kind:
        held.setdefault(c, []).append(v)
    belief, confidence = {e: float(k is not None) for e, k in kind.items()}, {}
    for _ in range(pii.ROUNDS):
        new = {c: sum(belief[c, v] for v in vs) / (len(vs) + pii.SMOOTH) for c, vs in held.items() if sum(belief[c, v] > 0.25 for v in vs) >= pii.SUPPORT}
        settled = confidence and all(x - confidence.get(c, 0) <= pii.SETTLED for c, x in new.items())
        confidence = new
        if settled:
            break
        best = {}
        for c, v in kind:
            best[v] = max(best.get(v, 0.0), confidence.get(c, 0.0))
        belief = {(c, v): 1.0 if k else best[v] for (c, v), k in kind.items()}
    kinds = (*pii.KINDS, "secret")
    of = {}
    for c, x in confidence.items():
        if x >= pii.ACCEPT:
            n = [sum(kind[c, v] == k for v in held[c]) for k in kinds]
            of[c] = (x, kinds[n.index(max(n))] if max(n) else "other")
    out = {}
    for d, ms in marks.items():
        got = [(a, b, max(of[c] for c in cs if c in of)[1] if seed is None else seed) for a, b, _, cs, seed in ms if seed == "secret" or seed is None and any(c in of for c in cs)]
        out[d] = [(k, a, b) for a, b, k in sorted(got)]
    return out


def test_added_spans_equal_brute_force(spark):
    rng = random.Random(12)
    words_ = ["call", "host", "from", "the", "id:", "ref", "password=", "token", "=", "to"]
    make = [lambda: f"10.0.{rng.randint(0, 9)}.{rng.randint(0, 99)}", lambda: f"u{rng.randint(0, 30)}@example.org", lambda: f"{rng.choice('QXZ')}{rng.choice('QXZ')}-{rng.randint(1000, 1400)}-{rng.randint(0, 9)}",
            lambda: "AKIA" + "".join(rng.choices("ABC123", k=rng.choice([16, 16, 12]))), lambda: f"{rng.randint(100000, 100400)}.", lambda: "anna@home", lambda: '"' + "".join(rng.choices("abc123", k=10)) + '"']
    texts = {1000 + i: " ".join(rng.choice(make)() if rng.random() < 0.4 else rng.choice(words_) for _ in range(rng.randint(0, 14))).replace("= ", "= " if rng.random() < 0.5 else "=") for i in range(400)}
    want = bootstrapped(texts)
    got = {r["doc_id"]: r for r in pii.report(frame(spark, [*texts.items(), *ODD])).collect()}
    assert sum(map(len, want.values())) > 100 and len({k for ss in want.values() for k, _, _ in ss}) > 2
    for d, text in texts.items():
        order = sorted(base_spans(text) + want[d], key=lambda s: (pii.KINDS.index(s[0]) if s[0] in pii.KINDS else 9, s[1], s[2]))
        assert got[d]["spans"] == ",".join("%s:%d:%d" % s for s in order), text
        assert got[d]["n_found"] == len(want[d]) and got[d]["n_spans"] == len(order)


def test_redaction_of_long_texts_and_clashing_columns(spark):
    long = "".join(f"mail a{i}@x.org or 10.0.0.{i % 200}, é😀\n" for i in range(3000))
    rows = [(1, "to a@b.c.d now", 14, 7, "s"), (2, None, None, 8, "t"), (3, "plain", 5, 9, "u"), (4, long, len(long), 10, "v"), (4, "+1 555 01 99 password=9f2c11zz, token = \"ab12cd34\".", 50, 11, None)]
    docs = frame(spark, rows, "doc_id long, text string, n_chars int, _row int, `_in` string")
    got = {r["_row"]: r for r in pii.redact(docs).collect()}
    assert docs.columns == pii.redact(docs).columns and len(got) == 5
    assert got[7]["text"] == "to [email] now" and got[7]["n_chars"] == len("to [email] now") and got[7]["_in"] == "s"
    assert got[8]["text"] is None and got[9]["text"] == "plain"
    assert got[10]["text"] == re.sub(r"10\.0\.0\.[0-9]+", "[ip]", re.sub(r"a[0-9]+@x\.org", "[email]", long))
    assert got[11]["text"] == '[phone] password=[secret], token = "[secret]".'
    assert pii.redact(docs.limit(0)).count() == 0 and pii.report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["1 " + "é" * 1_000_000, "1.1.1.1 " + "7" * 1_000_000, "x1@y.z " * 60_000, "a" * 1_000_000 + "1"])
def test_long_runs_are_read_in_linear_time(spark, text):
    docs = frame(spark, [(1, text)])
    start = time.perf_counter()
    assert pii.located(docs).select(F.size("base").alias("n")).first()["n"] == (60_000 if "@" in text else int("." in text))
    assert time.perf_counter() - start < 20
