import hashlib
import random
import struct
import tracemalloc

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from callweave.llm import bpe, queries
from tests.llm.helpers import SMALL, documents, empty_docs, odd_docs

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_documents_are_encoded_as_by_the_library(spark, library):
    got = {r["doc_id"]: r for r in queries.op6_bpe(spark, SMALL).collect()}
    docs = documents(SMALL)
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_random_strings(library):
    rng = random.Random(1)
    fixed = ["'s", "'LL", "<|endoftext|>", "<|startoftext|>", "Σ", "ΑΣ ", "İ", "é", "aaa", "\0", "́", "Ᲊ", "Ɤ"]
    char = lambda: rng.choice([chr(rng.randrange(32, 127)), chr(rng.choice([9, 10, 13, 0x1C, 0x1F, 0x85, 0xA0, 0x2003, 0x180E, 0x200B, 0xFEFF])), chr(rng.randrange(0xA0, 0x2FF0)), chr(rng.randrange(0x10000, 0x1FFFF)), *fixed])
    texts = ["".join(char() for _ in range(rng.randrange(1, 25))) for _ in range(4000)]
    texts += ["".join(rng.choice("abrtheino") for _ in range(rng.randrange(1, 40))) for _ in range(8000)]
    texts += ["a" * k for k in range(1, 150)] + ["ha" * k for k in range(1, 80)]
    own = bpe.WordBpe(open(PATH, encoding="utf-8").read(), bpe.unicode_ranges())
    for text, ids in zip(texts, own.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}i", ids)) == want, ascii(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_odd_rows(spark, library):
    df = odd_docs(spark)
    got = bpe.encode(df, PATH).collect()
    assert len(got) == df.count()
    for r, d in zip(sorted(got, key=repr), sorted(df.collect(), key=lambda r: repr(r["doc_id"])), strict=False):
        assert isinstance(r["ids"], list)
    want = sorted(library.encode(r["text"] or "", add_special_tokens=False).ids for r in df.collect())
    assert sorted(r["ids"] for r in got) == want
    assert bpe.encode(empty_docs(spark), PATH).collect() == []


def test_encoding_holds_only_the_path_to_a_word():
    own = bpe.WordBpe(open(PATH, encoding="utf-8").read(), bpe.unicode_ranges())
    rng = random.Random(2)
    words = {"".join(rng.choice("abcdefghij") for _ in range(24)) for _ in range(8000)}
    tracemalloc.start()
    own.encode_words(words)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak - held < 8 << 20  # a trie of dictionaries takes over 30 MB
