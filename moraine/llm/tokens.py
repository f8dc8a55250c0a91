"""Token ids of whole Arrow string arrays, by a public tokenizer file and a cache of words."""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .storage import light_bounds

#: Marks that may be cut from a word's ends: no mark of the tokenizer's special strings or contractions is among them.
END_MARKS = r".,;:!?$%&*#()"
_PARTS = rf"^(?P<head>[{END_MARKS}]*)(?P<core>.*?)(?P<tail>[{END_MARKS}]*)$"
_PLAIN_CORE = r"^[\p{L}\p{N}]$|^[\p{L}\p{N}].*[\p{L}\p{N}]$"
_LATIN = "^[\\x00-\\x{FF}]*$"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker, so that its cache serves all tasks of the worker."""
    return WordEncoder(path)


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces flat[starts[i]:starts[i] + lengths[i]], end to end."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class WordEncoder:
    """Ids as ``Tokenizer.encode(text, add_special_tokens=False)`` gives them, for a tokenizer that never joins words.

    Tokens never cross ASCII white space, nor the border between a letter or digit and a run of :data:`END_MARKS` at a
    word's end, so a text's ids are its words' ids end to end.  Each distinct word goes through the library once; at most
    ``cache_words`` are kept.  ``tests/llm`` holds this against whole texts.
    """

    def __init__(self, path: str, cache_words: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library, self.cache_words = Tokenizer.from_file(path), cache_words
        self.vocabulary = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.closes = np.zeros(self.vocabulary, bool)
        self.closes[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token.endswith("</w>")]] = True
        self.joins = bool(self.closes.any())
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.flat = np.empty(1 << 20, self.dtype)
        self.starts, self.lengths, self.filled = np.zeros(1, np.int64), np.zeros(1, np.int64), 0

    def _batch(self, texts: list[str]) -> list[list[int]]:
        call = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [x.ids for x in call(texts, add_special_tokens=False)]

    def _add(self, words: list[str]) -> None:
        """Words of letters alone close with one word-end token each, so they can go through the library as one text."""
        letters = [w for w in words if self.joins and w.isalpha()]
        others = [w for w in words if not (self.joins and w.isalpha())]
        ids = np.fromiter(itertools.chain.from_iterable(self._batch([" ".join(letters[i : i + 1000]) for i in range(0, len(letters), 1000)])), np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(letters):  # a mark that the library and Python class differently
            letters, others, ids, ends = [], words, ids[:0], ends[:0]
        coded = self._batch(others)
        flat = np.concatenate((ids, np.fromiter(itertools.chain.from_iterable(coded), np.int64))).astype(self.dtype)
        lengths = np.concatenate((np.diff(ends, prepend=0), np.fromiter(map(len, coded), np.int64, len(coded))))
        while self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        self.flat[self.filled : self.filled + len(flat)] = flat
        at = len(self.starts)
        self.place.update(zip(itertools.chain(letters, others), range(at, at + len(words)), strict=True))
        self.starts = np.concatenate((self.starts, self.filled + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.filled += len(flat)

    def _places(self, words: pa.Array) -> np.ndarray:
        own = words.dictionary_encode()
        keys = own.dictionary.to_pylist()
        missing = [w for w in keys if w not in self.place]
        if missing:
            if len(self.place) + len(missing) > self.cache_words:
                self._clear()
                missing = [w for w in keys if w]
            self._add(missing)
        return np.fromiter(map(self.place.__getitem__, keys), np.int64, len(keys))[own.indices.to_numpy()]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's number of ids; a null text has none."""
        parts = [self._encode(texts.slice(a, b - a)) for a, b in light_bounds(texts, len(texts))]
        if not parts:
            return np.empty(0, self.dtype), np.empty(0, np.int64)
        flat, counts = zip(*parts, strict=True)
        return np.concatenate(flat), np.concatenate(counts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary
        lower = pc.if_else(pc.match_substring_regex(distinct, _LATIN), pc.utf8_lower(distinct), distinct)
        parts = pc.extract_regex(lower, _PARTS)
        head, core, tail = (pc.struct_field(parts, i) for i in range(3))
        plain = pc.fill_null(pc.match_substring_regex(core, _PLAIN_CORE), False)
        none = pa.scalar("", core.type)
        head, core, tail = pc.if_else(plain, head, none), pc.if_else(plain, core, lower), pc.if_else(plain, tail, none)
        # three pieces a distinct word, in one lookup so that a cleared cache can't part them
        n = len(distinct)
        places = self._places(pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (head, core, tail)])) if n else np.empty(0, np.int64)
        three = places.reshape(3, n).T.reshape(-1)
        starts, lengths = self.starts[three], self.lengths[three]
        flat = ragged(self.flat, starts, lengths)
        per_word = lengths.reshape(n, 3).sum(1)
        word_starts = np.cumsum(per_word) - per_word
        index = words.indices.to_numpy()
        lengths = per_word[index]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        bounds = ends[np.concatenate(([0], np.cumsum(counts)))]
        return ragged(flat, word_starts[index], lengths), np.diff(bounds)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after each text's ids."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1
