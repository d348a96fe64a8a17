"""BPE encoding and decoding by depth-first traversal of a trie of distinct words.

A node of the trie is a prefix; its state is the last token of the prefix's encoding. A token t ends the encoding of a
prefix exactly if the last token of what stands before it is compatible with t, which means that merging the two
tokens' symbols gives the two tokens again. So a state follows from the states above it, and words that share a prefix
share its states.
"""

from __future__ import annotations

import json
import math
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from callweave.llm import memory, scratch

#: Distinct words whose encodings a task keeps.
CACHE_WORDS = 120_000
#: Texts of characters under it: nothing composes or moves, and lower case is the same in any Unicode version.
PLAIN = 0x300
#: Entries of each table of results that a task keeps.
MEMO = 200_000
#: Rows that a task holds decoded at once.
ROWS = 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [chr(other.get(b, b)) for b in range(256)]


def unicode_ranges() -> dict[str, list[tuple[int, int]]]:
    """First and last of the library's own letters, numbers and white space; Python has another Unicode version."""
    from tokenizers import Regex, pre_tokenizers

    # in blocks, as what is found of all characters at once takes 60 MB of the driver
    blocks = ["".join(chr(c) for c in range(at, at + 0x800) if not 0xD800 <= c < 0xE000) for at in range(0, 0x110000, 0x800)]
    ranges = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        split = pre_tokenizers.Split(Regex(name), "removed", invert=True)
        found = sorted(ord(x) for chars in blocks if chars for x, _ in split.pre_tokenize_str(chars))
        breaks = [k for k in range(1, len(found)) if found[k] != found[k - 1] + 1]
        ranges[name] = [(found[a], found[b - 1]) for a, b in zip([0, *breaks], [*breaks, len(found)], strict=True)]
    return ranges


def spelled_out(pattern: str, ranges: dict[str, list[tuple[int, int]]], below: int) -> str:
    """The pattern with its classes as ranges, for texts of characters under ``below``."""
    for name, pairs in ranges.items():
        inner = "".join(f"\\U{a:08x}-\\U{min(b, below - 1):08x}" for a, b in pairs if a < below)
        pattern = pattern.replace(f"[{name}]", f"[{inner}]").replace(name, inner)
    return pattern


class WordBpe:
    """A tokenizer file with NFC and lower case, a removing split, byte symbols and a word-end mark."""

    def __init__(self, file: str, ranges: dict[str, list[tuple[int, int]]]):
        from tokenizers import normalizers

        spec = json.loads(file)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = re.compile(spelled_out(pattern, ranges, 0x110000))
        self.split_plain = re.compile(spelled_out(pattern, ranges, PLAIN))
        self.plain = re.compile(f"[\\0-\\u{PLAIN - 1:04x}]*")
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.at_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.to_symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge[left, right] = rank
            if whole in self.parts or max(self.rank(left), self.rank(right)) >= rank:
                raise ValueError("each token comes from one merge, of tokens that come before it")
            self.parts[whole] = (left, right, rank)
        self.spines: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.met: dict[int, int] = {}
        # a token that its own symbols don't merge to never ends an encoding
        self.dead = {t for t, (a, b, _) in self.parts.items() if not self.compatible_until(a, b, self.merge[a, b])}
        self.build_automaton()
        self.ids: dict[str, bytes] = {}

    def build_automaton(self) -> None:
        """States are prefixes of tokens, over bytes (a word's last byte plus 256); each knows the tokens that end there.

        ``ends[state]``: (token, bytes) of its suffixes that are tokens, longest first. Moves are filled in as met.
        """
        byte = {s: b for b, s in enumerate(byte_symbols())}
        self.moves: list[dict[int, int]] = [{}]
        own: list[int | None] = [None]
        self.bytes: dict[int, int] = {}
        for text, token in self.vocab.items():
            if token in self.dead:
                continue
            last = bool(self.end) and text.endswith(self.end)
            codes = [byte[c] for c in (text[: -len(self.end)] if last else text)]
            if last:
                codes[-1] += 256
            self.bytes[token] = len(codes)
            at = 0
            for c in codes:
                nxt = self.moves[at].get(c)
                if nxt is None:
                    nxt = self.moves[at][c] = len(self.moves)
                    self.moves.append({})
                    own.append(None)
                at = nxt
            own[at] = token
        self.fail = [0] * len(self.moves)
        self.ends: list[tuple[tuple[int, int], ...]] = [()] * len(self.moves)
        level = [0]
        while level:
            below = []
            for at in level:
                for c, nxt in list(self.moves[at].items()):
                    f = self.fail[at]
                    while f and c not in self.moves[f]:
                        f = self.fail[f]
                    self.fail[nxt] = self.moves[f].get(c, 0) if at else 0
                    token = own[nxt]
                    self.ends[nxt] = (((token, self.bytes[token]),) if token is not None else ()) + self.ends[self.fail[nxt]]
                    below.append(nxt)
            level = below

    def move(self, at: int, c: int) -> int:
        f = at
        while f and c not in self.moves[f]:
            f = self.fail[f]
        nxt = self.moves[f].get(c, 0)
        self.met[at * 512 + c] = nxt
        return nxt

    def rank(self, token: int) -> int:
        return self.parts[token][2] if token in self.parts else -1

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Pieces that stand at the token's edge while it is merged, each with the rank of the merge that takes it in."""
        found = self.spines[side].get(token)
        if found is None:
            found, until, t = [], math.inf, token
            while True:
                found.append((t, until))
                if t not in self.parts:
                    break
                t, until = self.parts[t][1 - side], self.parts[t][2]
            self.spines[side][token] = found
        return found

    def compatible_until(self, a: int, b: int, limit: float) -> bool:
        """No merge of a rank under ``limit`` joins a piece of a's end to one of b's beginning.

        Of equal ranks the left one is done first: a merge within a wins, one within b loses.
        """
        for x, x_until in self.spine(a, 0):
            for y, y_until in self.spine(b, 1):
                r = self.merge.get((x, y))
                if r is not None and r < limit and r < x_until and r <= y_until:
                    return False
        return True

    def encode_words(self, words: set[str]) -> None:
        """Encodings of new words, by one traversal of their trie; a node's place in the automaton goes along.

        Words in order are the trie's leaves in depth-first order, so that only the path to the word at hand is held.
        """
        met, ends, pairs, size = self.met, self.ends, self.pairs, self.bytes
        states, places, before = [-1], [0], b""
        for raw, word in sorted((w.encode("utf-8"), w) for w in words):
            depth, most = 0, min(len(raw), len(before)) - 1
            while depth < most and raw[depth] == before[depth]:
                depth += 1
            before = raw
            del states[depth + 1 :], places[depth + 1 :]
            at = places[depth]
            for c in raw[depth:-1]:
                nxt = met.get(at * 512 + c)
                at = self.move(at, c) if nxt is None else nxt
                depth += 1
                places.append(at)
                states.append(self.last_token(ends[at], depth, states))
            nxt = met.get(at * 512 + raw[-1] + 256)
            if nxt is None:
                nxt = self.move(at, raw[-1] + 256)
            last = self.last_token(ends[nxt], depth + 1, states)
            out, k = [last], depth + 1 - size[last]
            while k:
                t = states[k]
                out.append(t)
                k -= size[t]
            out.reverse()
            self.ids[word] = struct.pack(f"<{len(out)}i", *out)
        if len(pairs) > MEMO:
            pairs.clear()
        if len(met) > MEMO:
            met.clear()

    def last_token(self, ends: tuple[tuple[int, int], ...], depth: int, states: list[int]) -> int:
        """The token that ends the encoding of a prefix of ``depth`` bytes, given the states of all shorter prefixes."""
        pairs = self.pairs
        for t, n in ends:
            if n == depth:
                return t
            key = states[depth - n] << 32 | t
            ok = pairs.get(key)
            if ok is None:
                ok = pairs[key] = self.compatible_until(states[depth - n], t, math.inf)
            if ok:
                return t
        raise ValueError("the vocabulary lacks a symbol")

    def pieces(self, text: str) -> list[str]:
        """Words of the normalised text; special tokens, found in the text as it is, stand in between as they are."""
        if self.at_special is None or not self.at_special.search(text):
            return self.normal(text)
        out: list[str] = []
        for part in self.at_special.split(text):
            if part:
                out += [f"\0{part}"] if part in self.special else self.normal(part)
        return out

    def normal(self, text: str) -> list[str]:
        if self.plain.fullmatch(text):
            return self.split_plain.findall(text.lower())
        return self.split.findall(self.normalizer.normalize_str(text))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian int32."""
        lists = [self.pieces(t) for t in texts]
        if len(self.ids) > CACHE_WORDS:
            self.ids.clear()
        fresh: set[str] = set()
        for words in lists:
            fresh.update(set(words).difference(self.ids))
        for w in [w for w in fresh if w[0] == "\0" and w[1:] in self.special]:
            fresh.remove(w)
            self.ids[w] = struct.pack("<i", self.special[w[1:]])
        self.encode_words(fresh)
        for words in lists:
            yield b"".join(map(self.ids.__getitem__, words))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[int, WordBpe] = {}


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids array<int>, decoded string.

    A null text counts as empty and gives no ids. Special tokens' strings in a text become their ids. Whole texts are
    encoded, however long. Repeated rows give repeated results; other columns are ignored; an empty table gives an
    empty result. The driver reads the file once; what is sent around has the size of the vocabulary.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        file = scratch.broadcast(docs.sparkSession, (f.read(), unicode_ranges()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory.begin("bpe", _LOADED.clear)
        text, ranges = file.value
        bpe = _LOADED.get(hash(text))
        if bpe is None:
            bpe = _LOADED[hash(text)] = WordBpe(text, ranges)
            memory.give_back()
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                found = [np.frombuffer(x, np.int32) for x in bpe.encode([x or "" for x in part.column(1).to_pylist()])]
                ends = np.cumsum([0] + [len(x) for x in found], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))
                decoded = pa.array([bpe.decode(x.tolist()) for x in found], pa.string())
                yield pa.record_batch([part.column(0), ids, decoded], ["doc_id", "ids", "decoded"])
        memory.give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")
