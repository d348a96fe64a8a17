import itertools
import zlib

import numpy as np

from callweave.llm import lang_id, queries
from tests.llm.helpers import SF, documents, empty_docs, odd_docs


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.op9_lang_id(spark, SF).collect()}
    docs = documents()
    assert len(got) == len(docs)
    right = []
    for d in docs:
        r = got[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["held_out"] and d["lang"]:
            right.append(r["lang_pred"] == d["lang"])
    assert len(right) > 150 and np.mean(right) >= 0.97


def test_forward_backward_is_brute_force():
    rng = np.random.default_rng(1)
    k = 3
    m = lang_id.CrfModel(("a", "b", "c"), np.zeros((1, k)), rng.normal(size=(k, k)), rng.normal(size=k), {})
    table = np.exp(rng.normal(size=(6, k))).astype(np.float32)
    sizes = np.array([1, 4, 2])
    ids = rng.integers(0, 6, sizes.sum())
    a, b, holds = lang_id.forward_backward(table, ids, sizes, m)
    at = 0
    for row, n in enumerate(sizes):
        own = ids[at : at + n]
        at += n
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            w = np.exp(m.start[path[0]] + sum(m.transitions[x, y] for x, y in itertools.pairwise(path))) * np.prod([table[i, y] for i, y in zip(own, path, strict=True)])
            for t, y in enumerate(path):
                want[t, y] += w
        want /= want.sum(1, keepdims=True)
        got = lang_id.posteriors(a[:n, row], b[:n, row], table[own])
        assert holds[:, row].sum() == n and np.allclose(got, want, atol=1e-4)


def test_code_switched_text_and_odd_rows(spark):
    texts = [("the cat sat on the mat and then went home with the others", "en"), ("der hund und die katze sind nicht auf dem tisch mit den anderen", "de")] * 40
    m = lang_id.train(texts, rounds=15)
    lab = lang_id.Labeller(m)
    mixed = "the cat and the others der hund und die katze sind nicht auf dem tisch"
    (p,) = lab([mixed])
    assert m.labels[int(p.argmax())] == "de" and 0.5 < p.max() < 0.8
    df = odd_docs(spark)
    got = lang_id.label(df, m).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r["lang_pred"] == "und") == (r["score"] == 0.0)
    by = {r["doc_id"]: r for r in got}
    assert by[0]["lang_pred"] == by[2]["lang_pred"] == "und" and by[7]["lang_pred"] in m.labels
    assert lang_id.label(empty_docs(spark), m).collect() == []
    assert lang_id.train(lang_id.training_texts(empty_docs(spark))) is None
    assert {r["lang_pred"] for r in lang_id.label(df, None).collect()} == {"und"}


def test_the_middle_of_a_long_run_counts():
    en, de = "thecatsatonthematandthenwenthome", "derhundunddiekatzesindnichtdabei"
    texts = [(" ".join([x] * 6), k) for x, k in ((en, "en"), (de, "de"))] * 40
    lab = lang_id.Labeller(lang_id.train(texts, rounds=15))
    (p,) = lab([en + de * 6 + en])
    assert len(en) == len(de) == lang_id.WIDTH and lab.model.labels[int(p.argmax())] == "de"
    assert lang_id.words_of("A" * 70 + "1b") == ["a" * 32, "a" * 32, "a" * 6, "b"]


def test_letters_are_those_of_unicode():
    """Numbers that are no digits are no letters; marks belong to the letters before them, and alone make no word."""
    assert lang_id.words_of("½ ² Ⅷ ① 12 _") == lang_id.words_of("\u0301 \u0301") == []
    assert lang_id.words_of("हिन्दी में e\u0301te\u0301 x²y 𐐀𐐁 ½") == ["हिन्दी", "में", "e\u0301te\u0301", "x", "y", "𐐨𐐩"]


def test_the_model_runs_once_under_a_filter(spark):
    m = lang_id.train([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 4, rounds=3)
    rows = lang_id.label_rows(odd_docs(spark), m)
    kept = rows.where("lang_pred <> 'und' and score > 0.1").select("doc.*", "lang_pred")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "the cat", 1, 2, 3, 4)], ["doc_id", "text", "lang_pred", "judged", "doc", "a.b"])
    m = lang_id.train([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 4, rounds=3)
    (r,) = lang_id.label_rows(df, m).select("doc.*").collect()
    assert r.asDict() == {"doc_id": 1, "text": "the cat", "lang_pred": 1, "judged": 2, "doc": 3, "a.b": 4}
