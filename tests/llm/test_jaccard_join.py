import random

from callweave.llm import components, jaccard_join, queries
from tests.llm.helpers import SF, documents, empty_docs, odd_docs
from tests.llm.test_decontaminate import grams


def brute(rows, percent=75):
    """doc_id -> (sizes, component), comparing every two sets that share a shingle."""
    sets = [(i, grams(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            for g in s:
                having.setdefault(g, []).append(k)
    tried = set()
    for ks in having.values():
        for n, x in enumerate(ks):
            for y in ks[n + 1 :]:
                if (x, y) not in tried:
                    tried.add((x, y))
                    shared = len(sets[x][1] & sets[y][1])
                    if 100 * shared >= percent * (len(sets[x][1]) + len(sets[y][1]) - shared):
                        a, b = root(sets[x][0]), root(sets[y][0])
                        parent[max(a, b)] = min(a, b)
    return sorted(((i, len(s), root(i) if i is not None else None) for i, s in sets), key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=repr)


def test_documents_are_brute_force(spark):
    assert result(queries.op2_jaccard_join(spark, SF)) == brute([(d["doc_id"], d["text"]) for d in documents()])


def made(seed, groups, passage_docs):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(40)
    docs = []
    for size in groups:
        original = text(rng.choice([5, 12, 40, 90]))
        for _ in range(size):
            copy = list(original)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append(copy[: len(copy) - rng.randrange(4)] if len(copy) > 8 else copy)
    for _ in range(passage_docs):
        own = text(rng.choice([4, 10, 15, 60]))
        docs.append(own[:3] + passage + own[3:])
    docs += [["one"], ["one"], ["one", "two"], [], []]
    rng.shuffle(docs)
    return [(i * 7 % 10_007, " ".join(d)) for i, d in enumerate(docs)]


def test_large_groups_and_shared_passages(spark, monkeypatch):
    for seed, groups, passage in ((1, [60, 30, 2, 2, 3, 9, 10], 120), (2, [2] * 30 + [150], 20), (3, [25] * 8, 0)):
        rows = made(seed, groups, passage)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert result(jaccard_join.near_duplicates(df)) == brute(rows)


def test_without_frequent_tokens_and_with_tiny_batches(spark):
    """The order, the bound of small tokens and the batches decide about speed alone."""
    rows = made(4, [40, 12, 5, 3], 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert result(jaccard_join.near_duplicates(df)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_odd_rows(spark):
    df = odd_docs(spark, ["tie tie tie tie tie tie", "tie tie tie tie tie tie"])
    assert result(jaccard_join.near_duplicates(df)) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert result(jaccard_join.near_duplicates(empty_docs(spark))) == []


def test_components_of_chains_stars_and_cycles(spark):
    n = 300
    links = [(k, k + 1) for k in range(n)] + [(1000, 1000 + k) for k in range(1, n)] + [(2000 + k, 2000 + (k + 1) % 50) for k in range(50)] + [(5, 5), (5000, 5000), (1001, 1000)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {1000 + k: 1000 for k in range(n)} | {2000 + k: 2000 for k in range(50)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
