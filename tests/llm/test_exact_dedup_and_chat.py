import hashlib
import random

from callweave.llm import chat_format, exact_dedup
from tests.llm.helpers import empty_docs, odd_docs


def test_exact_dedup_odd_rows(spark):
    df = odd_docs(spark, ["tie", "tie", "tie ", "p" * 300 + "a", "p" * 300 + "b", "p" * 300 + "a"])
    rows = df.collect()
    groups = {}
    for r in rows:
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    for limit in (1000, 0):
        got = exact_dedup.exact_dedup(df, broadcast_keys=limit).collect()
        assert len(got) == len(rows)
        by = {r["text_sha256"]: r for r in got}
        for text, ids in groups.items():
            r = by[hashlib.sha256(text.encode()).hexdigest()]
            keep = max((i for i in ids if i is not None), default=None)
            assert (r["keep_id"], r["group_size"]) == (keep, len(ids))
        assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.exact_dedup(empty_docs(spark)).collect() == []


def test_chat_round_trip_of_random_control_strings(spark):
    t = chat_format.Template()
    rng = random.Random(5)
    bits = [*t.control, t.escape, "a", "\n", "<", "[", "/", "INST]", "s>", " ", "é", "$1", "\\"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
    rows = [(c, turn, rng.choice(["user", "assistant", "system", text()]), text(), "clash") for c in range(300) for turn in range(rng.randrange(1, 5))]
    rows += [(None, 0, None, None, None), (901, None, "user", "null turn", None), (901, 1, "assistant", None, None), (902, 1, "user", "x" * 100_000, None), (903, 1, "b", "t", None), (903, 1, "a", "t", None), (903, 1, "a", "t", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    want = {}
    for c, turn, role, x, _ in rows:
        want.setdefault(c, []).append((turn is not None, turn or 0, role or "", x or ""))
    got = chat_format.format_chats(df, t).collect()
    assert len(got) == len(want)
    for r in got:
        turns = [(a[2], a[3]) for a in sorted(want[r["conv_id"]])]
        assert [(x["role"], x["text"]) for x in r["turns"]] == turns
        plain = lambda s: s.replace(t.escape * 2, "\0").replace(t.escape, "").replace("\0", t.escape)
        masked = [plain(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        assert masked == [x for role, x in turns if role == "assistant"]
    assert chat_format.format_chats(spark.createDataFrame([], df.schema)).collect() == []
