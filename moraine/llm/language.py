"""Operator 2: language of code-switched text by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import light_slices

UNKNOWN = "und"
_MARKS = "".join(map(chr, [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])) + "«»“”„‘’¿¡…–—"
#: Odd multipliers of the rolling hashes.
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # hashed feature x language
    transitions: np.ndarray  # log weight from language to language
    start: np.ndarray
    sizes: tuple[int, ...]  # lengths of character n-grams


def normal_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words per text, each word's place among the distinct normal words, and those: lower case, end marks cut."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    counts, flat = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64), split.flatten()
    there = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end leaves an empty word
    counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[there.to_numpy(zero_copy_only=False)], minlength=len(counts))
    coded = flat.filter(there).dictionary_encode()
    normal = pc.utf8_trim(pc.utf8_lower(coded.dictionary), _MARKS).dictionary_encode()
    return counts, normal.indices.to_numpy()[coded.indices.to_numpy()], normal.dictionary


def features(words: pa.Array, sizes: tuple[int, ...], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word, end to end, and the first feature of each word.

    A word stands between two border bytes.  Its features are all byte n-grams of ``sizes`` (those at a border are its
    affixes) and the word as a whole (the lexicon).
    """
    n = len(words)
    bordered = pc.binary_join_element_wise("\x02", words, "\x03", "")
    raw = bordered.cast(pa.binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int32, n + 1, offset=raw.offset * 4).astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1)
    offsets = offsets - offsets[0]
    lengths = np.diff(offsets)
    ends = np.repeat(offsets[1:], lengths)
    at = np.arange(len(data))
    owner = np.repeat(np.arange(n), lengths)
    owners, hashed = [], []
    rolling = np.zeros(len(data), np.uint64)
    for k in range(1, max(sizes) + 1):
        shifted = np.zeros(len(data), np.uint64)
        shifted[: max(len(data) - k + 1, 0)] = data[k - 1 :]
        rolling = rolling * _P + shifted
        if k in sizes:
            inside = at + k <= ends
            owners.append(owner[inside])
            hashed.append(_mixed(rolling[inside] + _salt(k), width))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(int(lengths.max(initial=1)) - 1, 0), _P))), dtype=np.uint64)
        whole = np.add.reduceat(data * power[at - np.repeat(offsets[:-1], lengths)], offsets[:-1]) if n else np.empty(0, np.uint64)
    owners.append(np.arange(n))
    hashed.append(_mixed(whole + _salt(99), width))
    owners, hashed = np.concatenate(owners), np.concatenate(hashed)
    order = np.argsort(owners, kind="stable")
    return hashed[order], np.searchsorted(owners[order], np.arange(n))


def _salt(k: int) -> np.uint64:
    return np.uint64(k * int(_Q) % 2**64)


def _mixed(h: np.ndarray, width: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _Q
    return ((h ^ (h >> np.uint64(29))) % np.uint64(width)).astype(np.int64)


def emissions(model: Model, words: pa.Array) -> np.ndarray:
    """Log weight of each language for each distinct word; zero for a word with no letter."""
    if not len(words):
        return np.zeros((0, len(model.languages)))
    ids, first = features(words, model.sizes, len(model.weights))
    counts = np.diff(np.append(first, len(ids)))
    out = np.add.reduceat(model.weights[ids], first, axis=0) / np.sqrt(counts)[:, None]
    return np.where(_lettered(words)[:, None], out, 0.0)


def _lettered(words: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)


def marginals(emission: np.ndarray, counts: np.ndarray, transitions: np.ndarray, start: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Exact forward-backward over sequences of ``counts`` words: each word's distribution, and each row's forward messages.

    Sequences are cut into rows of ``width`` words that run side by side: first each row's transfer matrix, then the
    messages between the rows of a sequence, then the words of all rows.
    """
    n_states = emission.shape[1]
    rows = -(-counts // width)
    n_rows = int(rows.sum())
    if not n_rows:
        return np.zeros((0, n_states)), np.zeros((0, n_states))
    row_seq = np.repeat(np.arange(len(counts)), rows)
    row_no = np.arange(n_rows) - np.repeat(np.cumsum(rows) - rows, rows)
    filled = np.minimum(counts[row_seq] - row_no * width, width)
    inside = np.arange(width) < filled[:, None]
    e = np.zeros((n_rows, width, n_states))
    e[inside] = np.exp(emission - emission.max(1, keepdims=True))
    t = np.exp(transitions - transitions.max())
    first = row_no == 0

    product = np.broadcast_to(np.eye(n_states), (n_rows, n_states, n_states)).copy()
    for k in range(width):
        live = inside[:, k]
        moved = (product.reshape(-1, n_states) @ t).reshape(product.shape)
        if k == 0:
            moved[first] = product[first]
        moved *= e[:, k, None, :]
        product = np.where(live[:, None, None], moved, product)
        product /= product.sum((1, 2), keepdims=True)
    forward = np.ones((n_rows, n_states))
    forward[first] = np.exp(start - start.max())
    backward = np.ones((n_rows, n_states))
    by_number = np.argsort(row_no, kind="stable")
    bounds = np.searchsorted(row_no[by_number], np.arange(int(row_no.max()) + 2))
    for k in range(1, int(row_no.max()) + 1):
        now = by_number[bounds[k] : bounds[k + 1]]
        v = np.einsum("ri,rij->rj", forward[now - 1], product[now - 1])
        forward[now] = v / v.sum(1, keepdims=True)
    for k in range(int(row_no.max()), 0, -1):
        now = by_number[bounds[k] : bounds[k + 1]]
        v = np.einsum("rij,rj->ri", product[now], backward[now])
        backward[now - 1] = v / v.sum(1, keepdims=True)

    alpha = np.empty((n_rows, width, n_states))
    v = forward
    for k in range(width):
        v = np.where(first[:, None], v, v @ t) if k == 0 else v @ t
        v = v * e[:, k]
        v /= np.maximum(v.sum(1, keepdims=True), 1e-300)
        alpha[:, k] = v
        v = np.where(inside[:, k, None], v, 1.0)
    out = np.empty_like(alpha)
    b = backward
    for k in range(width - 1, -1, -1):
        both = alpha[:, k] * b
        out[:, k] = both / np.maximum(both.sum(1, keepdims=True), 1e-300)
        earlier = (e[:, k] * b) @ t.T
        b = np.where(inside[:, k, None], earlier / np.maximum(earlier.sum(1, keepdims=True), 1e-300), b)
    # forward message before each word, for the pair counts of training
    before = np.concatenate((forward[:, None], alpha[:, :-1]), 1)
    return out[inside], before[inside]


def fit(texts: list[str], labels: list[str], *, width: int = 1 << 17, sizes: tuple[int, ...] = (2, 3, 4), rounds: int = 30, row: int = 64, mean_span: int = 20, max_words: int = 300_000, seed: int = 11) -> Model:
    """Learn weights and transitions by full-batch adaptive gradient steps on the exact conditional likelihood.

    Each word bears its text's label.  Training sequences are code-switched on purpose: spans of texts in several languages,
    of ``mean_span`` words on average, follow one another, so that the learned transitions know changes of language.
    """
    languages = sorted(set(labels))
    n_states = len(languages)
    model = Model(languages, np.zeros((width, max(n_states, 1))), np.zeros((n_states, n_states)), np.zeros(n_states), sizes)
    counts, index, words = normal_words(pa.array(texts, pa.string()))
    if n_states < 2 or not len(index):
        return model
    rng = np.random.default_rng(seed)
    label = np.array([languages.index(x) for x in labels])
    starts = np.cumsum(counts) - counts
    spans = [(s + a, min(a + n, c) - a, y) for s, c, y in zip(starts, counts, label, strict=True) for a, n in _cuts(int(c), mean_span, rng)]
    by_language = [[x for x in spans if x[2] == k] for k in range(n_states)]
    share = max_words // n_states
    chosen = []
    for own in by_language:
        total = 0
        for i in rng.permutation(len(own)):
            if total >= share:
                break
            chosen.append(own[i])
            total += own[i][1]
    chosen = [chosen[i] for i in rng.permutation(len(chosen))]
    word_at = np.concatenate([np.arange(s, s + n) for s, n, _ in chosen])
    gold = np.concatenate([np.full(n, y) for _, n, y in chosen])
    token = index[word_at]
    used, token = np.unique(token, return_inverse=True)
    words = words.take(pa.array(used))
    lettered = _lettered(words)[token]
    full = len(token) // row * row
    rows = np.array([row] * (full // row) + [len(token) - full] * (len(token) > full), np.int64)
    head = np.cumsum(rows) - rows
    is_head = np.zeros(len(token), bool)
    is_head[head] = True
    ids, first = features(words, sizes, width)
    feature_counts = np.diff(np.append(first, len(ids)))
    feature_owner = np.repeat(np.arange(len(words)), feature_counts)
    scale = 1 / np.sqrt(feature_counts)
    target = np.eye(n_states)[gold]
    g_weights, g_transitions, g_start = np.full_like(model.weights, 1e-8), np.full((n_states, n_states), 1e-8), np.full(n_states, 1e-8)
    follows = np.flatnonzero(~is_head)
    observed = np.zeros((n_states, n_states))
    np.add.at(observed, (gold[follows - 1], gold[follows]), 1)
    for _ in range(rounds):
        e = (np.add.reduceat(model.weights[ids], first, axis=0) * scale[:, None])[token] * lettered[:, None]
        p, before = marginals(e, rows, model.transitions, model.start, row)
        # expected pairs: before(i) T(i,j) e(j) beta(j), where beta is p over the forward part of the same word
        t = np.exp(model.transitions - model.transitions.max())
        reach = before[follows] @ t
        weight = p[follows] / np.maximum(reach, 1e-300)
        expected = t * (before[follows].T @ weight)
        error = (target - p) * lettered[:, None]
        by_token = np.stack([np.bincount(token, error[:, k], len(words)) for k in range(n_states)], 1) * scale[:, None]
        grad = np.stack([np.bincount(ids, by_token[feature_owner, k], width) for k in range(n_states)], 1) / len(token) - 1e-6 * model.weights
        for value, g, total, rate in ((model.weights, grad, g_weights, 0.5), (model.transitions, (observed - expected) / len(token), g_transitions, 0.3), (model.start, (target[head] - p[head]).sum(0) / len(token), g_start, 0.1)):
            total += g * g
            value += rate * g / np.sqrt(total)
    model.weights = model.weights.astype(np.float32)
    return model


def _cuts(n: int, mean: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    lengths = 1 + rng.geometric(1 / mean, max(1, 2 * n // mean + 2))
    ends = np.cumsum(lengths)
    if ends[-1] < n:  # what the drawn spans leave is one more
        lengths, ends = np.append(lengths, n - ends[-1]), np.append(ends, n)
    return [(int(e - k), int(k)) for e, k in zip(ends, lengths, strict=True) if e - k < n]


RUNS = pa.struct([("lang", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("probability", pa.float64())])


def predict(model: Model, texts: pa.Array, at_once: int = 400_000) -> tuple[list[str], np.ndarray, pa.Array]:
    """Language and score of each whole text (the most words' worth of probability, and its share), and its runs.

    A run is a stretch of words, counted from 0, whose likeliest label is the same; its probability is the words' mean.
    """
    if not model.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), pa.array([[]] * len(texts), pa.list_(RUNS))
    counts, index, words = normal_words(texts)
    by_word, lettered = emissions(model, words), _lettered(words)
    ends = np.cumsum(counts)
    names, scores, n_runs, columns, i = [], [], [], [], 0
    while i < len(counts):
        low = ends[i] - counts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + at_once, side="right")))
        token = index[low : ends[j - 1]]
        p = marginals(by_word[token], counts[i:j], model.transitions, model.start)[0]
        owner = np.repeat(np.arange(j - i), counts[i:j])
        number, *found = _runs(p, owner, counts[i:j])
        n_runs.append(number)
        columns.append(found)
        p = p * lettered[token][:, None]
        sums = np.stack([np.bincount(owner, p[:, k], j - i) for k in range(p.shape[1])], 1)
        total = sums.sum(1)
        best = sums.argmax(1)
        names += [model.languages[b] if n > 0 else UNKNOWN for b, n in zip(best, total, strict=True)]
        scores.append(np.where(total > 0, sums.max(1) / np.maximum(total, 1e-300), 0.0))
        i = j
    if not scores:
        return names, np.empty(0), pa.array([], pa.list_(RUNS))
    label, first, last, probability = (np.concatenate(x) for x in zip(*columns, strict=True))
    flat = pa.StructArray.from_arrays([pa.array(model.languages, pa.string()).take(pa.array(label)), pa.array(first), pa.array(last), pa.array(probability)], fields=list(RUNS))
    bounds = np.concatenate(([0], np.cumsum(np.concatenate(n_runs)))).astype(np.int32)
    return names, np.clip(np.concatenate(scores), 0, 1), pa.ListArray.from_arrays(pa.array(bounds), flat)


def _runs(p: np.ndarray, owner: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each text's number of runs; each run's label, first and last word and mean probability."""
    if not len(p):
        return np.zeros(len(counts), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    label = p.argmax(1)
    start = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (owner[1:] != owner[:-1]))))
    length = np.diff(np.append(start, len(label)))
    mean = np.add.reduceat(p[np.arange(len(label)), label].astype(np.float64), start) / length
    first = start - (np.cumsum(counts) - counts)[owner[start]]
    return np.bincount(owner[start], minlength=len(counts)), label[start], first, first + length - 1, np.clip(mean, 0, 1)


def learn(docs: DataFrame, allowed: Column, *, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", max_rows: int = 4000, max_languages: int = 256, **options) -> Model:
    """Fit on at most ``max_rows`` allowed rows with a label and a text, an equal share for each language, picked by a hash.

    The bound is on the sample that reaches the driver; labels are counted over all rows first.  Every label is learned;
    more than ``max_languages`` of them are an error, as the model's size is theirs.  Where rows share ids, the sample is cut
    at twice the bound, in the order of the hash.
    """
    rows = docs.where(allowed & F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.lit(17)).alias("h"))
    counts = rows.groupBy("label").count().orderBy("label").limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} labels")
    if not counts:
        return fit([], [], **options)
    share = max(1, max_rows // len(counts))
    cut = {r["label"]: int(-(2**63) + min(1.0, share / r["count"]) * (2**64 - 1)) for r in counts}
    limit = F.create_map(*[F.lit(x) for k, v in cut.items() for x in (k, min(v, 2**63 - 1))])
    sample = rows.where(F.col("h") <= F.try_element_at(limit, F.col("label"))).orderBy("h", "label", "text").limit(2 * max_rows).select("label", "text").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["label"], r["text"]))
    return fit([r["text"] for r in sample], [r["label"] for r in sample], **options)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """``id``, ``keep``, ``lang_pred``, ``score`` and ``runs`` for every row, from the whole text alone.

    ``runs`` tells where a text changes language: ``lang``, ``first`` and ``last`` word (from 0) and mean ``probability``
    of each stretch of words with the same likeliest label; a text without words has none.

    A null text and one with no letter are ``und`` with score 0, as is everything under a model that saw no label.  Null
    and repeated ids keep their rows; other columns are ignored.  A map over rows; the model is a broadcast of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", lang_pred string, score double, runs array<struct<lang: string, first: bigint, last: bigint, probability: double>>"

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in light_slices(batch, "_text", 2000):
                names, scores, runs = predict(shared.value, part.column("_text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(scores), runs], [*batch.schema.names[:-1], "lang_pred", "score", "runs"])

    return rows.mapInArrow(label, schema)
