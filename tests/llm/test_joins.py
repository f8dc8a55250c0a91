"""Joins and near-duplicate operators against all pairs."""

import random

import numpy as np
import pytest

from moraine.llm import jaccard, lines, vectors
from moraine.llm.components import components
from moraine.llm.shingles import shingle_sets, word_hashes


def roots(n, pairs):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5), (7, None)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (200, 201, 202)} == {200} and 300 not in got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    data = [b.tolist() for b in base] + [(base[i % 20] + rng.normal(size=16) * 0.12).tolist() for i in range(120)]
    data += [base[0].tolist()] * 3 + [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, (base[1] * 7).tolist(), [1.0, 2.0], [2.0, 4.0]]
    n = len(data)
    near = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(n):
            u, v = data[i], data[j]
            if i != j and u and v and len(u) == len(v) and None not in u and None not in v and np.isfinite(u).all() and np.isfinite(v).all() and any(u) and any(v):
                near[i, j] = np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v) >= 0.9
    label = roots(n, zip(*np.nonzero(near), strict=True))
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(data)], "vec_id long, embedding array<double>, key int")
    for tile in (1024, 4):
        got = {r.id: r for r in vectors.near_vectors(df, tile=tile).collect()}
        assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(n)] == [(int(near[i].sum()), label[i], label[i] == i) for i in range(n)]
    assert vectors.near_vectors(df.limit(0)).count() == 0


def pairs_at(rng, n, dim, cosine):
    u = rng.normal(size=(n, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    return u, cosine * u + np.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w, axis=1, keepdims=True)


def test_counted_pairs_are_few_and_hold_the_near_ones():
    rng = np.random.default_rng(4)
    plan = vectors.Plan.of(100_000, 0.9, 0.995)
    u, v = pairs_at(rng, 3000, 64, 0.9)
    own, other = vectors.places(plan, u), vectors.places(plan, v)
    assert ((np.abs(own - other) <= plan.window).sum(1) >= plan.least).mean() > 0.999
    assert (vectors.cells(plan, u) == vectors.cells(plan, v)).any(1).mean() > 0.99
    at = np.concatenate((own[:300], other[:300]))
    i, j = vectors.counted(plan, at)
    brute = (np.abs(at[:, None] - at[None]) <= plan.window).sum(2) >= plan.least
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(brute, 1))), strict=True))
    assert len(i) < 330  # of 179,700 pairs: what is verified is what was counted
    assert {(k, k + 300) for k in range(300)} - set(zip(i.tolist(), j.tolist(), strict=True)) == set()
    assert vectors.verified(np.concatenate((u[:300], v[:300])), i, j, 0.899).sum() >= 300


def test_recall_of_near_vectors(spark):
    rng = np.random.default_rng(9)
    u, v = pairs_at(rng, 1500, 64, 0.9005)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.concatenate((u, v, rng.normal(size=(3000, 64)))))], "vec_id long, embedding array<double>")
    got = {r.id: r for r in vectors.near_vectors(df).collect()}
    assert sum(got[i + 1500].component_id == i for i in range(1500)) >= 0.99 * 1500
    assert all(got[i].n_links == 0 for i in range(3000, 6000))


def test_recall_of_the_chosen_paths():
    rng = np.random.default_rng(1)
    plan = jaccard.Plan.of(0.8, 0.999999)
    order = plan.order(np.arange(plan.runs))
    lost = total = 0
    for _ in range(10):
        agree = rng.random((20_000, plan.coordinates)) < 0.8
        found = np.zeros(len(agree), bool)
        for run in range(plan.runs):
            same = lambda place: agree[:, order[run, place % plan.coordinates]]  # noqa: B023, E731

            def together(place, depth):
                here = same(place)  # noqa: B023
                return here if depth == plan.depth else here & (together(2 * place + 1, depth + 1) | together(2 * place + 2, depth + 1))

            found |= together(0, 1)
        found &= agree.sum(1) >= plan.agreement
        lost, total = lost + int((~found).sum()), total + len(agree)
    assert lost / total < 1e-4


def variants(rng, words, n):
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile", [256, 8])
def test_jaccard_against_all_pairs(spark, tile):
    rng = random.Random(3)
    texts = []
    for g in range(12):
        texts += variants(rng, [f"g{g}w{rng.randrange(60)}" for _ in range(rng.randint(30, 120))], rng.randint(2, 9))
    texts += [texts[0]] * 3 + ["one two", "ONE two", "", None, "...", "one two three four five six"] + variants(rng, [f"hot{i}" for i in range(80)], 90)
    flat, counts = shingle_sets(__import__("pyarrow").array(texts))
    ends = np.cumsum(counts)
    sets = [set(flat[e - n : e].tolist()) for e, n in zip(ends, counts, strict=True)]
    n = len(texts)
    near = np.array([[i != j and bool(sets[i]) and len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) >= 0.8 for j in range(n)] for i in range(n)])
    label = roots(n, zip(*np.nonzero(near), strict=True))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rep string")
    got = {r.id: r for r in jaccard.jaccard_classes(df, tile=tile).collect()}
    assert [(got[i].n_links, got[i].class_id) for i in range(n)] == [(int(near[i].sum()), label[i]) for i in range(n)]


def test_jaccard_odd_rows_and_keep_one(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f"), (6, None), (7, ""), (8, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert jaccard.jaccard_classes(df).count() == 8
    assert sorted((r.doc_id for r in jaccard.keep_one(df).collect())) == [4, 6, 7, 8]
    assert jaccard.jaccard_classes(df.limit(0)).count() == 0 and jaccard.keep_one(df.limit(0)).count() == 0


def test_words_are_told_apart():
    import pyarrow as pa

    hashes, counts = word_hashes(pa.array(["Ab ab,AB", None, "ab", "\u00e9\u00c9 \u00e9\u00c9"]))
    assert counts.tolist() == [3, 0, 1, 2] and len(set(hashes[:4].tolist())) == 1 and hashes[4] == hashes[5] != hashes[0]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n):
    t = list(s)
    for _ in range(n):
        k, i = rng.randrange(3), rng.randrange(len(t) + 1)
        if k == 0:
            t.insert(i, rng.choice("ab\u00e9"))
        elif t and k == 1:
            t.pop(min(i, len(t) - 1))
        elif t:
            t[min(i, len(t) - 1)] = rng.choice("ab\u00e9")
    return "".join(t)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_segment_join_finds_every_pair(edits):
    rng = random.Random(edits)
    found = [edited(rng, s, rng.randrange(4)) for s in ["".join(rng.choice("ab\u00e9") for _ in range(rng.randint(6, 14))) for _ in range(40)] for _ in range(4)]
    found = [s for s in dict.fromkeys(found) if len(s) > edits]
    lengths = np.array([len(s) for s in found])
    codes = np.frombuffer("".join(found).encode("utf-32-le"), np.uint32)
    key, line, role = lines.segment_keys(codes, np.cumsum(lengths) - lengths, lengths, edits)
    buckets = {}
    for k, i, r in zip(key.tolist(), line.tolist(), role.tolist(), strict=True):
        buckets.setdefault(k, []).append((i, r))
    met = {(min(i, j), max(i, j)) for b in buckets.values() for i, r in b for j, q in b if i != j and r | q == 3}
    for i in range(len(found)):
        for j in range(i + 1, len(found)):
            near = distance(found[i], found[j]) <= edits
            assert lines.within(found[i], found[j], edits) == near
            assert not near or (i, j) in met


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(20, 60))).strip() for _ in range(25)]
    rows = [(i, "\n".join(edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 5])) for _ in range(rng.randint(1, 7)))) for i in range(40)] + [(50, None), (51, ""), (3, "short\nshort")]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, source string, n_lines int")
    found = {}
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if len(x.strip()) >= 24:
                found.setdefault(x.strip(), []).append(((i, k)))
    names = list(found)
    label = roots(len(names), [(a, b) for a in range(len(names)) for b in range(a) if distance(names[a], names[b]) <= 2])
    classes = {}
    for x, c in zip(names, label, strict=True):
        classes.setdefault(c, []).extend(found[x])
    gone = {p for places in classes.values() for p in places if p != min(places)}
    got = {(r.id, r.text) for r in lines.dedup_lines(df, keep=("source",)).collect()}
    assert got == {(i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone)) for i, t in rows}
    assert lines.dedup_lines(df.limit(0)).count() == 0
