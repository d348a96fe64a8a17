from pathlib import Path

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"

#: Texts that any operator must take.
ODD_TEXTS = [None, "", " ", "\n\n", "a", "é", "​", "x" * 50_000, "word " * 4_000, "two\nlines", "two\nlines", "🙂 emoji\tand tab", "␛ escape"]

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __text string, sha string, hash long, label string, kept boolean"


def odd_docs(spark, more=()):
    """Documents with nulls, ties, repeated rows and columns whose names clash with inner ones."""
    texts = [*ODD_TEXTS, *more]
    rows = [(i, t, None, None, None, "clash", "clash", 1, "clash", None) for i, t in enumerate(texts)]
    rows.append((1, "", "en", None, 0, "clash", None, None, None, True))
    rows.append(rows[10])
    rows.append((None, "no id", None, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, SCHEMA)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(sf=SF):
    import pyarrow.parquet as pq

    assert Path(sf).exists()
    return pq.read_table(f"{sf}/documents.parquet").to_pylist()
