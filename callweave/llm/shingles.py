"""Hashes of word shingles, for many texts at once.

Words are runs of anything but ASCII white space, after A-Z are lower-cased. A text's set is that of its distinct
shingles of five words; a text of fewer words has its whole sequence as one; one without words has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text hashed at once; a longer text is hashed in pieces that end between words.
CHUNK = 1 << 20
#: Bytes from which a word is hashed by itself.
LONG = 1 << 9

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of lower-cased bytes whose white space is spaces, the last byte being one.

    Words are read eight bytes at a time, all words at once; each step takes in the hash of what stands before.
    """
    space = np.frombuffer(plain, np.uint8) == 32
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    size = ends - starts
    eight = np.ndarray((len(plain),), "<u8", plain + bytes(8), strides=(1,))
    out = mix(size.astype(np.uint64))
    left = np.arange(len(size))
    for k in range(0, LONG, 8):
        if not len(left):
            break
        out[left] = mix(out[left] * np.uint64(0x9E3779B97F4A7C15) + (eight[starts[left] + k] & _MASKS[np.minimum(size[left] - k, 8)]))
        left = left[size[left] > k + 8]
    for k in left:
        out[k] = int.from_bytes(hashlib.blake2b(plain[starts[k] : ends[k]], digest_size=8).digest())
    return out, starts


def _pieces(plain: bytes) -> Iterator[bytes]:
    """A long text in pieces that end with a space."""
    at = 0
    while at < len(plain):
        end = len(plain) if at + CHUNK >= len(plain) else plain.rfind(b" ", at, at + CHUNK) + 1 or plain.find(b" ", at + CHUNK) + 1
        yield plain[at:end]
        at = end


def ordered(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles, in text order, repeats included."""
    group: list[bytes] = []
    size = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if group and size + len(raw) > CHUNK:
            yield from _ordered(group)
            group, size = [], 0
        group.append(raw)
        size += len(raw) + 1
    if group:
        yield from _ordered(group)


def _ordered(group: list[bytes]) -> Iterator[np.ndarray]:
    plain = b" ".join(group).translate(_PLAIN) + b" "
    stops = np.cumsum(np.fromiter(map(len, group), np.int64, len(group)) + 1)
    if len(plain) > 2 * CHUNK:  # a single text
        words = np.concatenate([_word_hashes(x)[0] for x in _pieces(plain)])
        counts = np.array([len(words)])
    else:
        words, starts = _word_hashes(plain)
        counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    factor = [np.uint64(0xD6E8FEB86659FD93 + 2 * k * 0x1F3D5B79) for k in range(WORDS)]
    n = max(0, len(words) - WORDS + 1)
    whole = np.zeros(n, np.uint64)
    for k in range(WORDS):
        whole += words[k : k + n] * factor[k]
        if k < WORDS - 1:
            whole ^= whole >> np.uint64(29)
    whole = mix(whole)
    at = 0
    for c in counts.tolist():
        if c >= WORDS:
            yield whole[at : at + c - WORDS + 1]
        elif c:
            short = np.array([c], np.uint64)
            for k in range(c):
                short = mix(short * factor[k] + words[at + k])
            yield short
        else:
            yield np.empty(0, np.uint64)
        at += c


def sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles."""
    for h in ordered(texts):
        yield np.unique(h)
