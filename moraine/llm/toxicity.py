"""Operator 5: toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .language import normal_words
from .storage import give_back, light_slices, small_batches, written

#: Patterns that vote besides the mined lexicons; any text, any language.
PATTERNS = {
    "~shouting": r"(?:\b\p{Lu}{3,}\b\W+){5,}",
    "~exclaiming": r"[!?]{3,}",
    "~masked word": r"\b\p{L}+[*@#$]+\p{L}+\b",
    "~stretched": r"(?:aaaa|eeee|iiii|oooo|uuuu)",
}
_AFFIXES = ((3, "{}*"), (4, "{}*"), (5, "{}*"), (6, "{}*"))


def word_features(word: str) -> list[str]:
    """A word and its beginnings; endings and short words say little."""
    return [word, *(mark.format(word[:n]) for n, mark in _AFFIXES if len(word) > n)] if word else []


@dataclass
class Model:
    bias: float = -6.0
    weights: dict[str, float] = field(default_factory=dict)
    accuracies: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # voter: P(vote | toxic), P(vote | clean), independent share


def pattern_hits(texts: pa.Array) -> np.ndarray:
    filled = pc.fill_null(texts, "")
    return np.stack([pc.match_substring_regex(filled, p).to_numpy(zero_copy_only=False) for p in PATTERNS.values()], 1)


class Present:
    """Which features each text holds, by numbers: texts as distinct words, words as features."""

    def __init__(self, words: np.ndarray, offsets: np.ndarray, vocabulary: list[str], wanted: dict[str, int] | None = None):
        """Of ``wanted`` features, if given, only those count, under their numbers there."""
        self.words, self.offsets = words, offsets
        place: dict[str, int] = {} if wanted is None else wanted
        own = array.array("i")
        lengths = np.empty(len(vocabulary), np.int64)
        for i, w in enumerate(vocabulary):
            found = word_features(w)
            numbers = [place.setdefault(f, len(place)) for f in found] if wanted is None else [place[f] for f in found if f in place]
            lengths[i] = len(numbers)
            own.extend(numbers)
        self.names, self.features = list(place), np.frombuffer(own, np.int32) if len(own) else np.empty(0, np.int32)
        self.starts, self.lengths = np.cumsum(lengths) - lengths, lengths

    def pairs(self, step: int = 500) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, feature), each once, for ``step`` texts at a time."""
        for low in range(0, len(self.offsets) - 1, step):
            high = min(low + step, len(self.offsets) - 1)
            word = self.words[self.offsets[low] : self.offsets[high]]
            text = np.repeat(np.arange(high - low), np.diff(self.offsets[low : high + 1]))
            n = self.lengths[word]
            at = np.repeat(self.starts[word] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            both = np.unique(np.repeat(text, n) * len(self.names) + self.features[at]) if len(at) else np.empty(0, np.int64)
            yield low + both // max(len(self.names), 1), both % max(len(self.names), 1)


def _present(batch: pa.RecordBatch, wanted: dict[str, int] | None = None) -> Present:
    lists = batch.column("words")
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return Present(coded.indices.to_numpy(), offsets - offsets[0], coded.dictionary.to_pylist(), wanted)


def mined(sample: DataFrame, *, most: int, least_docs: int = 2) -> list[str]:
    """Features far more frequent in toxic texts of ``sample``, strongest first: by the lower end of their log odds.

    Each task counts its texts by feature and class; only the sums of a feature are shuffled, the ``most`` best come back.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            here, toxic = _present(batch), batch.column("y").to_numpy() > 0
            pos, neg = np.zeros(len(here.names), np.int64), np.zeros(len(here.names), np.int64)
            for text, feature in here.pairs():
                pos += np.bincount(feature[toxic[text]], minlength=len(pos))
                neg += np.bincount(feature[~toxic[text]], minlength=len(neg))
            yield pa.RecordBatch.from_arrays([pa.array(here.names, pa.string()), pa.array(pos), pa.array(neg)], ["feature", "pos", "neg"])
        give_back()

    sizes = sample.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("n1"), F.count(F.lit(1)).alias("n")).first()
    n1, n0 = int(sizes["n1"]), int(sizes["n"]) - int(sizes["n1"])
    if not n1:
        return []
    sums = sample.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    pos, neg = F.col("pos") + 0.5, F.col("neg") + 0.5
    odds = F.log(pos / (n1 + 1 - pos)) - F.log(neg / (n0 + 1 - neg))
    low = F.round(odds - F.sqrt(1 / pos + 1 / neg), 9)
    good = sums.where(F.col("pos") >= least_docs).withColumn("low", low).where("low > 1.0")
    return [r["feature"] for r in good.orderBy(F.desc("low"), "feature").limit(most).select("feature").collect()]


def label_model(votes: np.ndarray, trusted: np.ndarray, *, rounds: int = 10, least_correlation: float = 0.3) -> tuple[np.ndarray, dict]:
    """Posterior of the positive class from binary votes, by expectation maximisation.

    Each voter has a rate of voting under either class; the given label, an annotator who may err, is one more source, whose
    accuracy is estimated like the others'.  What voters still share once the class is known (their residual correlations) divides their evidence:
    a voter counts by one over the sum of its correlations from ``least_correlation`` up (below that they may be chance), so
    copies of a voter count as one.
    """
    all_votes = np.column_stack((votes, trusted)).astype(np.float32)
    r = np.where(trusted > 0, 0.95, 0.02)
    share = np.ones(all_votes.shape[1])
    prior = float(r.mean()) if len(r) else 0.5
    rate1 = rate0 = np.full(all_votes.shape[1], 0.5)
    for _ in range(rounds):
        rate1 = (r @ all_votes + 0.5) / (r.sum() + 1)
        rate0 = ((1 - r) @ all_votes + 0.5) / ((1 - r).sum() + 1)
        prior = float(np.clip(r.mean(), 1e-3, 1 - 1e-3))
        residual = all_votes - (r[:, None] * rate1 + (1 - r)[:, None] * rate0).astype(np.float32)
        spread = residual.std(0) + 1e-9
        correlation = (residual.T @ residual) / len(residual) / spread[:, None] / spread
        np.fill_diagonal(correlation, 1)
        share = 1 / np.where(correlation >= least_correlation, correlation, 0).sum(1)
        evidence = all_votes @ (share * np.log(rate1 / rate0)) + (1 - all_votes) @ (share * np.log((1 - rate1) / (1 - rate0)))
        r = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
    return r, {"rate1": rate1, "rate0": rate0, "share": share}


def logistic(x: np.ndarray, target: np.ndarray, *, penalty: float = 0.004, rounds: int = 15, block: int = 2000) -> tuple[np.ndarray, float]:
    """L2 logistic regression on soft labels, by Newton steps; sums run over blocks of rows."""
    n, d = x.shape
    w = np.zeros(d + 1)
    ridge = np.full(d + 1, penalty * np.sqrt(n))
    ridge[-1] = 1e-6
    for _ in range(rounds):
        gradient, hessian = -ridge * w, np.diag(ridge)
        for low in range(0, n, block):
            design = np.column_stack((x[low : low + block], np.ones(len(x[low : low + block])))).astype(float)
            p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            gradient += design.T @ (target[low : low + block] - p)
            hessian += (design * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ design
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(names: list[str], x: np.ndarray, patterns: np.ndarray, toxic: np.ndarray, *, voters: int = 200) -> Model:
    """Run the label model over the first ``voters`` lexicon entries, the patterns and the label, train the classifier on its posteriors.

    ``x`` says which of the mined features ``names`` each text holds, ``patterns`` which of the patterns.
    """
    model = Model()
    if not len(toxic) or not toxic.any():
        return model
    none = ~x.any(1)
    posterior, found = label_model(np.column_stack((x[:, :voters], none, patterns)), toxic.astype(float))
    voter_names = [*names[:voters], "~none of the lexicon", *PATTERNS, "~label"]
    model.accuracies = {n: (float(a), float(b), float(c)) for n, a, b, c in zip(voter_names, found["rate1"], found["rate0"], found["share"], strict=True)}
    weights, model.bias = logistic(np.column_stack((x, patterns)), posterior)
    model.weights = {f: float(w) for f, w in zip([*names, *PATTERNS], weights, strict=True)}
    return model


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of each whole text: the classifier over the features that occur anywhere in it."""
    counts, index, words = normal_words(texts)
    names = [f for f in model.weights if f not in PATTERNS]
    place = {f: i for i, f in enumerate(names)}
    weight = np.array([model.weights[f] for f in names])
    total = np.full(len(counts), model.bias)
    total += pattern_hits(texts) @ np.array([model.weights.get(p, 0.0) for p in PATTERNS])
    if names and len(words):
        own = [(i, place[f]) for i, w in enumerate(words.to_pylist()) for f in word_features(w) if f in place]
        if own:
            word, feature = np.array(own).T
            hits = np.bincount(word, minlength=len(words))
            owner = np.repeat(np.arange(len(counts)), counts)
            useful = hits[index] > 0
            pairs_doc, pairs_word = owner[useful], index[useful]
            pairs = np.unique(pairs_doc * len(words) + pairs_word)
            doc, w = pairs // len(words), pairs % len(words)
            first = np.searchsorted(word, w)
            n = hits[w]
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            distinct = np.unique(np.repeat(doc, n) * len(names) + feature[at])
            total += np.bincount(distinct // len(names), weight[distinct % len(names)], len(counts))
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 12_000, features: int = 600, **options) -> Model:
    """Fit on at most ``max_rows`` allowed labelled rows, picked by a hash of the id.

    The rows' distinct words and patterns, of their whole texts, are written to the shared folder; lexicons are mined there
    by an aggregation, and only the numbers of the ``features`` mined ones that each row holds reach the driver.  A document
    with several labels counts as toxic if one of them says so; null labels and ids are left out.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(allowed).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    n = marked.count()
    cut = int(-(2**63) + min(1.0, max_rows / max(n, 1)) * (2**64 - 1))
    sample = marked.where(F.xxhash64("id", F.lit(23)) <= F.lit(min(cut, 2**63 - 1))).limit(max_rows + max_rows // 10)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in light_slices(batch, "text", 1000):
                counts, index, words = normal_words(part.column("text"))
                owner = np.repeat(np.arange(len(counts)), counts)
                pairs = np.unique(owner * max(len(words), 1) + index)
                doc, word = pairs // max(len(words), 1), pairs % max(len(words), 1)
                offsets = np.searchsorted(doc, np.arange(len(counts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), words.take(pa.array(word)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("y"), lists, _flags(pattern_hits(part.column("text")))], ["id", "y", "words", "patterns"])
        give_back()

    gathered = written(rows.mapInArrow(gather, f"id {docs.schema[id_col].dataType.simpleString()}, y int, words array<string>, patterns array<boolean>"), "toxicity-sample")
    with small_batches(docs.sparkSession):
        names = mined(gathered, most=features)
        wanted = gathered.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

        def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(_present(batch, wanted.value).pairs(max(batch.num_rows, 1)))
                text, feature = found[0] if found else (np.empty(0, np.int64), np.empty(0, np.int64))
                offsets = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), held, batch.column("patterns")], ["id", "y", "held", "patterns"])
            give_back()

        own = gathered.mapInArrow(numbers, f"id {docs.schema[id_col].dataType.simpleString()}, y int, held array<int>, patterns array<boolean>").toArrow()
    if not own.num_rows:
        return Model()
    own = own.take(pc.sort_indices(own.column("id"))).combine_chunks()
    held = own.column("held").combine_chunks()
    x = np.zeros((own.num_rows, len(names)), bool)
    x[np.repeat(np.arange(own.num_rows), pc.list_value_length(held).to_numpy(zero_copy_only=False)), held.flatten().to_numpy()] = True
    hits = np.array(own.column("patterns").to_pylist(), bool).reshape(-1, len(PATTERNS))
    return fit(names, x, hits, own.column("y").to_numpy() > 0, **options)


def _flags(hits: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(hits) + 1, dtype=np.int32) * hits.shape[1]), pa.array(hits.reshape(-1)))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, keep: tuple[Column, ...] = ()) -> DataFrame:
    """``id``, ``keep``, ``score`` and ``predicted`` (1 at ``threshold`` or above) of every row, from the whole text alone.

    Null and empty texts have the score of a text with no feature.  Null and repeated ids keep their rows; other columns are
    ignored.  A model learned without a toxic label calls nothing toxic.  A map over rows; the model is a broadcast of
    bounded size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", score double, predicted int"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in light_slices(batch, "_text", 1500):
                s = scores(shared.value, part.column("_text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names[:-1], "score", "predicted"])
        give_back()

    return rows.mapInArrow(judge, schema)
