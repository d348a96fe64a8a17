"""Language ID of words in code-switched text by a linear-chain conditional random field.

A word's label depends on hashed affixes, character bigrams and trigrams and a learned lexicon, and on the labels beside
it through learned transitions. Training maximises the likelihood of labelled sequences by their forward-backward
gradient; a text's language has the largest mean posterior over all its words.
"""

from __future__ import annotations

import random
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm import memory, scratch

#: Hashed features, and letters of a word; a longer run of letters is several words.
BUCKETS = 1 << 17
WIDTH = 32
#: Distinct words whose scores a task keeps, and texts that it holds as words at once.
CACHE_WORDS, ROWS = 200_000, 512
UNDETERMINED = "und"


@dataclass(frozen=True)
class CrfModel:
    labels: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS + len(lexicon) + 1, labels); the last row is zero
    transitions: np.ndarray  # (labels, labels), log
    start: np.ndarray
    lexicon: dict[str, int]


@cache
def _patterns(last: int) -> tuple[re.Pattern, re.Pattern]:
    """A letter, and a word, of characters up to ``last``: letters and the marks that belong to them, by category."""

    def ranges(kinds: str) -> str:
        chars = (c for c in range(last + 1) if unicodedata.category(chr(c))[0] in kinds)
        runs = [[c for _, c in run] for _, run in groupby(enumerate(chars), lambda x: x[1] - x[0])]
        return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)

    return re.compile(f"[{ranges('L')}]"), re.compile(f"[{ranges('LM')}]{{1,{WIDTH}}}")


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case, those of more than WIDTH in consecutive pieces of WIDTH; none in a text of marks alone."""
    text = text.lower()
    # the longer tables of all planes are slow for what is no letter
    letter, word = _patterns(sys.maxunicode if _ASTRAL.search(text) else 0xFFFF)
    return word.findall(text) if letter.search(text) else []


def features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """(words, features) of rows in the weights: n-grams with edges, affixes of 2 to 4, lexicon entry."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    chars = np.zeros((len(words), WIDTH + 3), np.uint64)
    chars[:, 1 : WIDTH + 1] = np.array(words, dtype=f"U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
    rows = np.arange(len(words))
    chars[:, 0] = 2
    chars[rows, size + 1] = 3
    none = BUCKETS + len(lexicon)
    mix = lambda *parts: sum((p + np.uint64(7 * k + 1)) * np.uint64(0x9E3779B97F4A7C15 >> (11 * k) | 1) for k, p in enumerate(parts))
    slot = lambda h: ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(47)).astype(np.int64)
    out = []
    for n in (2, 3):
        grams = mix(*[chars[:, k : chars.shape[1] - n + 1 + k] for k in range(n)])
        whole = np.arange(grams.shape[1])[None, :] + n <= size[:, None] + 2
        out.append(np.where(whole, slot(grams + np.uint64(n)), none))
    for n in (2, 3, 4):
        ok = size >= n
        front = slot(mix(*[chars[:, 1 + k] for k in range(n)]) + np.uint64(100 + n))
        back = slot(mix(*[chars[rows, np.maximum(size - n, 0) + 1 + k] for k in range(n)]) + np.uint64(200 + n))
        out += [np.where(ok, front, none)[:, None], np.where(ok, back, none)[:, None]]
    known = np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))
    out.append(np.where(known >= 0, BUCKETS + known, none)[:, None])
    return np.concatenate(out, axis=1)


def emissions(words: list[str], m: CrfModel) -> np.ndarray:
    """(words, labels), positive, the largest of a row being 1."""
    out = np.empty((len(words), len(m.labels)), np.float32)
    for at in range(0, len(words), 20_000):
        scores = m.weights[features(words[at : at + 20_000], m.lexicon)].sum(1)
        out[at : at + 20_000] = np.exp(scores - scores.max(1, keepdims=True))
    return out


def chain(e: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Scaled messages of one direction: (steps, rows, labels)."""
    out = np.empty_like(e)
    now = e[0] * first
    out[0] = now / now.sum(1, keepdims=True)
    for t in range(1, len(e)):
        now = (out[t - 1] @ move) * e[t]
        now /= now.sum(1, keepdims=True)
        out[t] = now
    return out


def forward_backward(table: np.ndarray, ids: np.ndarray, sizes: np.ndarray, m: CrfModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward messages (steps, rows, labels) and where they hold, for rows of ``sizes`` ids each.

    The backward message at a step includes the step's own emission.
    """
    steps, rows = int(sizes.max()), len(sizes)
    starts = np.cumsum(sizes) - sizes
    t = np.arange(steps)[:, None]
    holds = t < sizes[None, :]
    there = np.where(holds, starts[None, :] + t, 0)
    back = np.where(holds, starts[None, :] + sizes[None, :] - 1 - t, 0)
    move = np.exp(m.transitions).astype(np.float32)
    a = chain(table[ids[there]], np.exp(m.start).astype(np.float32), move)
    b = chain(table[ids[back]], np.ones(len(m.labels), np.float32), np.ascontiguousarray(move.T))
    mirror = np.where(holds, sizes[None, :] - 1 - t, 0)
    return a, b[mirror, np.arange(rows)[None, :]], holds


def posteriors(a: np.ndarray, b: np.ndarray, e: np.ndarray) -> np.ndarray:
    p = a * b / e
    return p / p.sum(-1, keepdims=True)


def sequences(texts: list[tuple[str, str]], labels: tuple[str, ...], length: int, rng: random.Random) -> list[list[tuple[str, int]]]:
    """Labelled sequences: pieces of each text, and as many that switch between texts of different labels."""
    index = {x: k for k, x in enumerate(labels)}
    pieces = []
    for text, label in texts:
        words = words_of(text)
        pieces += [(words[k : k + length], index[label]) for k in range(0, len(words), length)]
    rng.shuffle(pieces)
    out = [[(w, k) for w in words] for words, k in pieces]
    for _ in range(len(pieces) // 2):
        mixed: list[tuple[str, int]] = []
        for words, k in rng.sample(pieces, min(3, len(pieces))):
            at = rng.randrange(max(1, len(words) - 3))
            mixed += [(w, k) for w in words[at : at + rng.randrange(3, max(4, length // 2))]]
        out.append(mixed[:length])
    return [s for s in out if s]


def train(texts: list[tuple[str, str]], rounds: int = 30, length: int = 48, max_words: int = 400_000, lexicon_size: int = 20_000, penalty: float = 1e-6) -> CrfModel | None:
    """Fit by Adam on the mean log-likelihood of at most ``max_words`` words; None without a label."""
    labels = tuple(sorted({label for _, label in texts}))
    if not labels:
        return None
    rng = random.Random(0)
    data, n = [], 0
    for s in sequences(sorted(texts), labels, length, rng):
        data.append(s)
        n += len(s)
    rng.shuffle(data)
    while n > max_words:
        n -= len(data.pop())
    counts = Counter(w for s in data for w, _ in s)
    lexicon = {w: k for k, (w, c) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:lexicon_size]) if c >= 3}
    kinds = list(counts)
    number = {w: k for k, w in enumerate(kinds)}
    k = len(labels)
    model = CrfModel(labels, np.zeros((BUCKETS + len(lexicon) + 1, k), np.float32), np.zeros((k, k)), np.zeros(k), lexicon)
    if not data:
        return model
    at = features(kinds, lexicon)
    data.sort(key=len)
    sizes = np.array([len(s) for s in data])
    ids = np.array([number[w] for s in data for w, _ in s])
    gold = np.array([y for s in data for _, y in s])
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(ids), bool)
    inner[starts] = False
    seen_move = np.zeros((k, k))
    np.add.at(seen_move, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
    seen_start = np.bincount(gold[starts], minlength=k)
    seen = np.zeros((len(kinds), k))
    np.add.at(seen, (ids, gold), 1)
    flat = at.ravel()
    params = [model.weights, model.transitions, model.start]
    first, second = [np.zeros_like(p, dtype=np.float64) for p in params], [np.zeros_like(p, dtype=np.float64) for p in params]
    for step in range(1, rounds + 1):
        scores = model.weights[at].sum(1)
        table = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-30)
        want, want_move, want_start = np.zeros((len(kinds), k)), np.zeros((k, k)), np.zeros(k)
        move = np.exp(model.transitions)
        for g in range(0, len(sizes), 2048):
            part = sizes[g : g + 2048]
            own = ids[starts[g] : starts[g] + part.sum()]
            a, b, holds = forward_backward(table, own, part, model)
            s0 = np.cumsum(part) - part
            t = np.arange(len(a))[:, None]
            e = table[own[np.where(holds, s0[None, :] + t, 0)]]
            p = posteriors(a, b, e)
            words = own[(s0[None, :] + t)[holds]]
            for y in range(k):
                want[:, y] += np.bincount(words, p[holds][:, y], len(kinds))
            want_start += p[0].sum(0)
            if len(a) > 1:
                pair = a[:-1, :, :, None] * move[None, None] * b[1:, :, None, :]
                pair /= pair.sum((-1, -2), keepdims=True)
                want_move += pair[holds[1:]].sum(0)
        slope = seen - want
        by_feature = np.stack([np.bincount(flat, np.repeat(slope[:, y], at.shape[1]), len(model.weights)) for y in range(k)], 1)
        grads = [by_feature / n - penalty * model.weights, (seen_move - want_move) / n, (seen_start - want_start) / n]
        for p, g, m1, m2 in zip(params, grads, first, second, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p += (0.08 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)).astype(p.dtype)
        model.weights[-1] = 0
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def training_texts(docs: DataFrame, rows_per_label: int = 250) -> list[tuple[str, str]]:
    """(text, lang) of at most ``rows_per_label`` documents of each label, chosen by a hash of doc_id; never held-out ones."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_000))
    limit = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(min(1_000_000, int(1_500_000 * rows_per_label / n) + 1))) for lang, n in sorted(counts.items())])
    chosen = known.where(draw < limit).select("lang", "text", draw.alias("draw")).orderBy("draw", "text").limit(2 * rows_per_label * len(counts)).collect()
    taken: Counter = Counter()
    out = []
    for r in chosen:
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= rows_per_label:
            out.append((r["text"], r["lang"]))
    return out


class Labeller:
    """Scores of distinct words, kept between batches."""

    def __init__(self, model: CrfModel):
        self.model = model
        self.number: dict[str, int] = {}
        self.table = np.empty((0, len(model.labels)), np.float32)

    def __call__(self, texts: list[str | None], cells: int = 400_000) -> list[np.ndarray | None]:
        """The mean posterior of each text's words; None for a text without a word."""
        lists = [words_of(t) if t else [] for t in texts]
        if len(self.number) > CACHE_WORDS:
            self.number, self.table = {}, self.table[:0]
        fresh = list(dict.fromkeys(w for words in lists for w in words if w not in self.number))
        if fresh:
            self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
            self.table = np.concatenate([self.table, np.maximum(emissions(fresh, self.model), np.float32(1e-30))])
        out: list[np.ndarray | None] = [None] * len(lists)
        order = sorted((k for k in range(len(lists)) if lists[k]), key=lambda k: len(lists[k]))
        while order:
            longest = len(lists[order[-1]])
            group = order[-max(1, min(512, cells // longest)) :]
            del order[-len(group) :]
            sizes = np.array([len(lists[k]) for k in group])
            ids = np.fromiter((self.number[w] for k in group for w in lists[k]), np.int64, int(sizes.sum()))
            a, b, holds = forward_backward(self.table, ids, sizes, self.model)
            there = np.where(holds, (np.cumsum(sizes) - sizes)[None, :] + np.arange(len(a))[:, None], 0)
            p = posteriors(a, b, self.table[ids[there]])
            means = np.where(holds[:, :, None], p, 0).sum(0) / sizes[:, None]
            for k, x in zip(group, means, strict=True):
                out[k] = x
        return out


def label(docs: DataFrame, model: CrfModel | None) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score (mean posterior of that label over the text's words).

    ``und`` with score 0 where the text is null or has no letter, or no label was learned. Of labels with equal means
    the first in order is taken. Only the text is looked at, all of it. Repeated rows give repeated results; other
    columns are ignored; an empty table gives an empty result. What is sent around is the model, whose size is fixed.
    """
    return label_rows(docs.select("doc_id", "text"), model).select("doc.doc_id", "lang_pred", "score")


def label_rows(docs: DataFrame, model: CrfModel | None) -> DataFrame:
    """doc (a struct of all columns of ``docs``, whatever their names), and lang_pred and score as ``label`` has them."""
    sent = scratch.broadcast(docs.sparkSession, model)

    @F.pandas_udf("lang string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory.begin("lang_id")
        m = sent.value
        labeller = Labeller(m) if m else None
        for texts in batches:
            out = []
            for at in range(0, len(texts), ROWS):
                part = list(texts.iloc[at : at + ROWS])
                for x in labeller(part) if labeller else [None] * len(part):
                    k = None if x is None else int(x.argmax())
                    out.append((UNDETERMINED, 0.0) if k is None else (m.labels[k], min(1.0, float(x[k]))))
            yield pd.DataFrame(out, columns=["lang", "score"])
        del labeller, m
        memory.give_back()

    # said to be nondeterministic, as else a filter on its result is pushed under it and has it run twice
    judged = docs.select(F.struct("*").alias("doc"), judge.asNondeterministic()(docs["text"].cast("string")).alias("judged"))
    return judged.select("doc", F.col("judged.lang").alias("lang_pred"), F.col("judged.score").alias("score"))
