"""Words, shingles and min-hash embeddings of whole Arrow string arrays, worked out on their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)

#: Bytes of a word: ASCII digits and letters, and all of any other character; A-Z counts as a-z.
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _a, _b, _by in ((0x30, 0x3A, 0), (0x61, 0x7B, 0), (0x41, 0x5B, 32)):
    _FOLD[_a:_b] = np.arange(_a, _b) + _by


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of all texts, end to end, and each text's number of words (a null text has none)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, offset=texts.offset * 8)
    data = texts.buffers()[2]
    raw = _FOLD[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = raw != 0
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    cut = offsets[1:-1][offsets[1:-1] < len(raw)]
    starts_here[cut] = inside[cut]
    stops_here = inside.copy()
    stops_here[:-1] &= ~inside[1:] | starts_here[1:]
    starts, stops = np.flatnonzero(starts_here), np.flatnonzero(stops_here) + 1
    # a word's bytes as digits in base _P, from prefix sums over powers that start anew in every block
    out = np.empty(len(starts), np.uint64)
    block = 1 << 20
    done = 0
    while done < len(starts):
        low = starts[done]
        upto = max(done + 1, int(np.searchsorted(stops, low + block, side="right")))
        span = raw[low : stops[upto - 1]].astype(np.uint64)
        powers = _powers(len(span) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(span * powers[:-1], dtype=np.uint64)))
        a, b = starts[done:upto] - low, stops[done:upto] - low
        out[done:upto] = (sums[b] - sums[a]) * _inverse_powers(len(span) + 1)[a] + (b - a).astype(np.uint64)
        done = upto
    counts = np.diff(np.searchsorted(starts, offsets))
    return mixed(out), counts.astype(np.int64)


_TABLES: dict[int, np.ndarray] = {}


def _table(base: np.uint64, n: int) -> np.ndarray:
    held = _TABLES.get(int(base))
    if held is None or len(held) < n:
        size = max(n, 1 << 20)
        held = _TABLES[int(base)] = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, base))), dtype=np.uint64)
    return held[:n]


def _powers(n: int) -> np.ndarray:
    return _table(_P, n)


def _inverse_powers(n: int) -> np.ndarray:
    return _table(_INVERSE, n)


def shingle_sets(texts: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles, end to end, and how many each has.

    A text of fewer than ``k`` words, but not none, has one shingle of all its words.
    """
    words, counts = word_hashes(texts)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    width = np.minimum(counts, k)
    owner = np.repeat(np.arange(len(counts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + first[owner]
    padded = np.concatenate((words, np.zeros(k, np.uint64)))
    h = np.zeros(len(owner), np.uint64)
    for j in range(k):
        live = j < width[owner]
        h = np.where(live, h * _P + padded[at + j], h)
    h = mixed(h)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(counts)).astype(np.int64)


def min_hashes(flat: np.ndarray, counts: np.ndarray, coordinates: int, seed: int = 3) -> np.ndarray:
    """Each set's smallest value under ``coordinates`` hash functions (unsigned 32-bit); zero for an empty set."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, coordinates, np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 2**63, coordinates, np.uint64)
    out = np.zeros((len(counts), coordinates), np.uint32)
    some = counts > 0
    first = (np.cumsum(counts) - counts)[some]
    if len(first):
        for c in range(coordinates):
            out[some, c] = np.minimum.reduceat((((flat * factors[c]) + terms[c]) >> np.uint64(32)).astype(np.uint32), first)
    return out
