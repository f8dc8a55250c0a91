"""Slices by bytes hold every value once, in order, within their bounds."""

import pyarrow as pa

from moraine.llm.storage import light_bounds, light_slices
from moraine.llm.tokens import default_tokenizer, word_encoder


def test_bounds():
    texts = ["a" * n for n in (0, 3, 50, 0, 9, 2, 2, 2, 40, 40, 0)] + [None, "é" * 5]
    cuts = list(light_bounds(pa.array(texts), 3, 10))
    assert [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == len(texts)
    for a, b in cuts:
        assert b - a <= 3 and (b - a == 1 or sum(len((t or "").encode()) for t in texts[a:b]) <= 10)
    assert list(light_bounds(pa.array([], pa.string()), 3, 10)) == []
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["n", "text"]).slice(2)
    assert [x for part in light_slices(batch, "text", 3, 10) for x in part.column("n").to_pylist()] == list(range(2, len(texts)))


def test_encoding_does_not_depend_on_slices():
    encoder = word_encoder(default_tokenizer())
    long = " ".join(f"word{i % 7919}" for i in range(1_200_000))
    texts = ["short one", long, None, "", "another short one", long[: len(long) // 3]]
    ids, counts = encoder.encode(pa.array(texts))
    each = [encoder.encode(pa.array([t], pa.string())) for t in texts]
    assert counts.tolist() == [int(c[0]) for _, c in each] and ids.tolist() == [x for i, _ in each for x in i.tolist()]
