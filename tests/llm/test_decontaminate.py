import random

import numpy as np
import pyarrow.parquet as pq

from callweave.llm import decontaminate, queries, shingles
from tests.llm.helpers import SF, documents, empty_docs, odd_docs


def words(text):
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]


def grams(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, items, t=0.75):
    own = [(r["item_id"], grams(r["text"])) for r in items]
    out = []
    for d in docs:
        g = grams(d["text"])
        out += [(d["doc_id"], i, len(q & g), len(q)) for i, q in own if q and len(q & g) >= t * len(q)]
    return sorted(out, key=repr)


def test_shingle_hashes_are_the_shingles():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("aA bB é c\t d\n 🙂 ab ba aab".split(" ")) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", None, " \n", "x" * 3_000_000, "a b", "ab", "a  b c d e"]
    seen = {}
    for t, s in zip(texts, shingles.sets(texts), strict=True):
        assert len(s) == len(grams(t))
        for h, g in zip(sorted(s), [None] * len(s), strict=True):
            seen.setdefault(int(h), set())
        assert (np.diff(s.astype(object)) > 0).all() if len(s) > 1 else True
    all_grams = set().union(*map(grams, texts))
    assert len({int(h) for s in shingles.sets(texts) for h in s}) == len(all_grams)
    assert [int(x) for x in next(shingles.sets(["A b C d e f"]))] == [int(x) for x in next(shingles.sets(["a  B c\nD E\tF "]))]


def test_leaks_are_brute_force(spark):
    got = sorted(((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in queries.op8_decontaminate(spark, SF).collect()), key=repr)
    want = brute(documents(), pq.read_table(f"{SF}/benchmark.parquet").to_pylist())
    assert got == want and len(want) > 0


def test_planted_passages_in_long_documents(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(2000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(rng.choice([5, 6, 9, 20, 40, 90, 200])) for _ in range(60)] + ["few words only", "", None]
    docs = []
    for k, item in enumerate(items[:60]):
        w = item.split()
        if k % 3 == 1 and len(w) > 30:
            w[len(w) // 2] = "changed"
        docs.append(f"{text(rng.choice([0, 50, 5000]))} {' '.join(w)} {text(rng.choice([0, 30, 8000]))}")
    docs += ["few words only", "few words only and more", items[30][: len(items[30]) // 2]]
    a = spark.createDataFrame([(i, d, "x") for i, d in enumerate(docs)], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, d, "x") for i, d in enumerate(items)], "item_id long, text string, doc_id string")
    want = brute([{"doc_id": i, "text": d} for i, d in enumerate(docs)], [{"item_id": i, "text": d} for i, d in enumerate(items)])
    for block in (100, 20):
        got = decontaminate.find_leaks(a, b, block=block).collect()
        assert sorted(((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got), key=repr) == want
    assert decontaminate.clean(a, b).count() == len(docs) - len({w[0] for w in want})


def test_scattered_items(spark):
    """Items whose pieces stand far apart, in any order: no window holds enough of them."""
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items, docs = [], []
    for k in range(20):
        item = text(rng.choice([30, 60, 150]))
        starts = list(range(0, len(item) - 4, 3))
        rng.shuffle(starts)
        # pieces of seven words hold all shingles; some of the documents lack a third of the pieces
        docs.append(" ".join(w for at in (starts if k % 2 else starts[: len(starts) * 2 // 3]) for w in item[at : at + 7] + text(rng.randrange(200, 600))))
        items.append(" ".join(item))
    a = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = brute([{"doc_id": i, "text": d} for i, d in enumerate(docs)], [{"item_id": i, "text": d} for i, d in enumerate(items)])
    got = decontaminate.find_leaks(a, b).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got), key=repr) == want
    assert {w[0] for w in want} == set(range(1, 20, 2))


def test_odd_rows(spark):
    df = odd_docs(spark)
    items = spark.createDataFrame([(1, "word " * 9), (1, None), (None, "no id"), (None, "no id")], "item_id long, text string")
    got = decontaminate.find_leaks(df, items).collect()
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=repr) == sorted([(8, 1), (None, None), (None, None)], key=repr)
    assert decontaminate.find_leaks(empty_docs(spark), items).collect() == []
    assert decontaminate.find_leaks(df, items.limit(0)).collect() == []
    assert decontaminate.clean(df, items).count() == df.count() - 2
