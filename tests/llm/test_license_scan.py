import random
import re

from pyspark.sql import functions as F

from callweave.llm import license_scan, queries
from tests.llm.helpers import SF, documents, empty_docs, odd_docs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(license_scan.UPPER, license_scan.LOWER)


def brute(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(places)


def found_by_hand(text, coverage=0.75, drift=3):
    """(label, score, start, end) of template spans, from the words alone: no hashes and no joins."""
    words = WORD.findall((text or "").translate(LOWER))
    out = []
    short = {license_scan.template_words(t)[0] for t, _ in license_scan.PHRASES + license_scan.TEMPLATES if len(license_scan.template_words(t)) == 2}
    size = lambda w: 2 if w in short else license_scan.GRAM
    for text_of, label in license_scan.TEMPLATES:
        own = license_scan.template_words(text_of)
        grams = {i: own[i : i + size(w)] for i, w in enumerate(own) if i + size(w) <= len(own)}
        diagonals = {}
        for pos, w in enumerate(words):
            for at, gram in grams.items():
                if w == gram[0] and words[pos : pos + len(gram)] == gram:
                    diagonals.setdefault(pos - at, []).append((pos, at))
        runs, last = [], None
        for d in sorted(diagonals):
            if last is None or d - last > drift:
                runs.append([])
            runs[-1] += diagonals[d]
            last = d
        for run in runs:
            ats, first, end = {at for _, at in run}, min(run)[0], max(run)[0]
            if len(ats) / len(grams) >= coverage and end - first <= len(own) + drift * (len(grams) - len(ats)):
                out.append((label, len(ats) / len(grams), first, end + license_scan.GRAM))
    return sorted(out)


def test_template_spans_are_brute_force(spark):
    docs = {d["doc_id"]: d["text"] for d in documents()}
    rng = random.Random(3)
    for k, (text, _) in enumerate(license_scan.TEMPLATES * 6):  # edited notices, alone, twice and within other words
        words = text.split()
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice([[], ["other"], ["some", "more"]])
        around = ["x"] * rng.randrange(5)
        docs[10**6 + k] = " ".join(around + words + around + words * rng.randrange(2))
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: sorted(tuple(f) for f in r["found"]) for r in license_scan.scan_licenses(df).collect()}
    want = {i: found_by_hand(t) for i, t in docs.items()}
    assert got == want and sum(map(len, want.values())) > 60


def test_equal_hashes_of_other_words_do_not_count(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "gram_hash", lambda a, b, c, short: F.when(a.isNotNull(), F.lit(1).cast("long")))
    df = spark.createDataFrame([(1, "nothing of the kind stands here"), (2, "all rights reserved")], "doc_id long, text string")
    got = {r["doc_id"]: (r["places"], r["found"]) for r in license_scan.scan_licenses(df).collect()}
    assert got[1] == ([], []) and [p["label"] for p in got[2][0]] == ["reserved"]


def test_base_is_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op10_licenses(spark, SF).collect()}
    docs = documents()
    assert len(got) == len(docs)
    for d in docs:
        n, places = brute(d["text"])
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert r["first_word"] == (places[0][0] if places else None)
        assert r["last_word"] == (places[-1][0] if places else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert ("apache-2.0" in r["labels"]) == ("Licensed under the Apache License, Version 2.0" in (d["text"] or ""))
        assert 0 <= r["score"] <= 1


def test_places_spans_and_odd_rows(spark):
    apache = dict((b, a) for a, b in license_scan.TEMPLATES if len(a) > 300)["apache-2.0"]
    edited = apache.replace("may obtain a copy", "can get one copy").replace("express or implied", "implied")
    more = ["CC BY cc-by, ccby", "cc by cc by", "All rights\nreserved. all rights reserved", "über general PUBLIC license", edited, "x " * 3000 + apache + " y" * 3000, "toKen cc Kby"]
    df = odd_docs(spark, more)
    rows = df.collect()
    got = license_scan.scan_licenses(df).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for r in rows:
        n, places = brute(r["text"])
        assert by_id[r["doc_id"]]["n_words"] == n or r["doc_id"] == 1
        if r["doc_id"] != 1:
            assert sorted((p["start"], p["label"]) for p in by_id[r["doc_id"]]["places"]) == places
    start = len(df.collect()) - len(more) - 3
    labels = lambda i: {f["label"] for f in by_id[start + i]["found"]}
    assert "apache-2.0" in labels(4) and "apache-2.0" in labels(5)
    assert any(f["start"] == 3000 for f in by_id[start + 5]["found"])
    assert license_scan.scan_licenses(empty_docs(spark)).collect() == []
