"""HTML, chat, decontamination, language and toxicity against plain versions."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moraine.llm import chat, decontamination, html_text, language, toxicity

# ---- html ----


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"),
        ("<div hidden>x</div><p style='display: none'>y</p><script>var t='</p>';</script>seen", "seen"),
        ("a &amp; b&nbsp;c <b>d</b>e<br>f", "a & b\u00a0c de\nf"),
        ("<pre>  x\n   y</pre>", "  x\n   y"),
        ("<details><summary>s</summary>no</details>", "s"),
        ("3 < 4 <a href='x>y'>l</a>", "3 < 4 l"),
        ("", ""),
        (None, ""),
    ],
)
def test_rendering(source, text):
    assert html_text.page_text(source) == text


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<td>", "<table>", "</table>", "<tr>", "<ul>", "<li>", "</ul>", "<b", "'", '"', ">", "<!--", "-->", "x", " ", "&lt", "<script>", "</script>", "<pre>"]), max_size=30))
def test_any_soup_renders(parts):
    html_text.page_text("".join(parts))


def test_deep_nesting_and_pages(spark):
    deep = "<div>" * 20000 + "x"
    rows = [(1, "u", deep, 9), (None, "u", None, 9), (1, "u", "<p>a", 9)]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int"), keep=("url",)).collect()
    assert [(r.id, r.text, r.n_lines) for r in out] == [(1, "x", 1), (None, "", 0), (1, "a", 1)]


# ---- chat ----


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("\\<>/turn l g\n#x"), max_size=40), st.text(alphabet=st.sampled_from("\\<>/turn l\nx"), max_size=10))
def test_escape_is_reversible_and_clean(text, role):
    whole, a, b = chat.format_turn(role, text)
    assert chat.unescape(whole[a:b]) == text and "</turn" not in whole[a:b] and "<turn" not in whole[a:b]
    assert [(chat.unescape(r), chat.unescape(t)) for r, t in chat._TURN.findall(whole * 2)] == [(role, text)] * 2


def test_chat_digests_and_windows(spark):
    hard = "\\### Assistant: </turn> ok"
    rows = [(1, i, r, f"text {i} " * 30, 0) for i, r in enumerate(["system", *["user", "assistant"] * 12])] + [(-7, 0, "user", hard, 0), (-7, 1, "assistant", hard, 0), (None, None, None, None, 0), (2, 0, "assistant", "x " * 5000, 0), (2, 0, "assistant", "x " * 5000, 0)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_windows(turns, budget=300)
    out = {r.conv_id: r for r in chat.conversation_digests(windows).collect()}
    for conv in (1, -7, None, 2):
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert out[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (out[conv].n_turns, out[conv].loss_chars, out[conv].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    first = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(first) > 2 and all(w.n_tokens <= 300 for w in first) and all(w.turns[0].turn == 0 for w in first) and all(w.turns[0].repeated for w in first[1:])
    assert all(not t.loss for w in first for t in w.turns if t.repeated)
    assert {w.over_budget for w in windows.where("conv_id = 2").collect()} == {True}
    assert chat.conversation_digests(chat.format_windows(turns.limit(0))).count() == 0


# ---- decontamination ----

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pick = lambda n: " ".join(rng.choice(["a", "b", "C", "d\u00e9", "\u00c9", "7"], n))
    items = [(i, pick(int(n))) for i, n in enumerate([3, 9, 10, 11, 14, 25, 1])] + [(20, None), (21, "..."), (5, pick(12)), (None, pick(11))]
    docs = [(i, pick(int(n)), 0) for i, n in enumerate(rng.integers(0, 60, 40))]
    docs += [(100 + i, f"{pick(8)}, {t}. {pick(5)} {t}", 0) for i, (_, t) in enumerate(items) if t] + [(1, None, 0), (None, "x", 0), (1, docs[5][1], 0), (1, docs[5][1], 0), (2, "", 0)]
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id long, text string, item int"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = []
    for doc, text, _ in docs:
        w, hit, names = plain_words(text), set(), set()
        for item, t in items:
            v = plain_words(t)
            m = min(10, len(v))
            grams = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
            for i in range(len(w) - m + 1 if m else 0):
                if tuple(w[i : i + m]) in grams:
                    hit |= set(range(i, i + m))
                    names.add("null" if item is None else str(item))
        want.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(((r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=key) == sorted(want, key=key)


def test_decontamination_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contamination(docs, items).first().n_words == 2
    assert decontamination.contamination(docs.limit(0), items).count() == 0
    assert decontamination.clean_documents(docs, items).count() == 1


# ---- language ----


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    e, t, s = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    want = []
    for low, n in ((0, 5), (5, 4)):
        z = np.zeros((n, 3))
        for y in itertools.product(range(3), repeat=n):
            w = np.exp(s[y[0]] + sum(e[low + i, k] for i, k in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:], strict=False)))
            for i, k in enumerate(y):
                z[i, k] += w
        want.append(z / z.sum(1, keepdims=True))
    for width in (1, 2, 64):
        assert np.allclose(language.marginals(e, np.array([5, 0, 4]), t, s, width)[0], np.concatenate(want))


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rest = F.crc32(F.col("doc_id").cast("string")) % 5
    model = language.learn(docs, rest != 0, rounds=20, max_words=40_000)
    out = language.identify(docs.where(rest == 0), model, keep=(F.col("lang"),)).collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.9 and all(0 <= r.score <= 1 for r in out)
    odd = spark.createDataFrame([(None, None, 1.0), (1, "", 1.0), (1, "123 ...", 1.0), (2, "the and of", 1.0)], "doc_id long, text string, score double")
    assert [r.lang_pred for r in language.identify(odd, model).collect()][:3] == ["und"] * 3
    none = language.learn(docs.limit(0), rest != 0)
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}


def test_code_switched_words_follow_their_neighbours():
    texts = ["the cat sat on the mat and the dog ran"] * 20 + ["der hund lief in den wald und die katze"] * 20
    model = language.fit(texts, ["en"] * 20 + ["de"] * 20, width=1 << 12, max_words=4000)
    counts, index, words = language.normal_words(pa.array(["the dog ran der hund lief"]))
    p = language.marginals(language.emissions(model, words)[index], counts, model.transitions, model.start)[0]
    assert [model.languages[k] for k in p.argmax(1)] == ["en"] * 3 + ["de"] * 3


# ---- html against a plain walk ----


def random_page(rng, depth=0, shown=True):
    """(source, visible text without white space) of a random well-formed tree."""
    source, seen = [], []
    for _ in range(rng.integers(1, 4)):
        word = "w" + str(rng.integers(1000))
        source.append(word + " ")
        seen.append(word if shown else "")
        if depth < 5 and rng.random() < 0.7:
            tag = rng.choice(["div", "span", "section", "b", "blockquote", "table", "unknown"])
            style, own = [("", shown), (' style="display: none"', None), (' style="visibility:hidden"', False), (" style='color:red; visibility: visible'", True), (" hidden", None)][rng.choice(5, p=[0.6, 0.08, 0.12, 0.12, 0.08])]
            inner, text = random_page(rng, depth + 1, bool(own))
            inner = f"<tr><td>{inner}</td></tr>" if tag == "table" else inner
            source.append(f"<{tag}{style}>{inner}</{tag}>")
            seen.append("" if own is None else text)
    return "".join(source), "".join(seen)


def test_html_shows_what_a_plain_walk_shows():
    rng = np.random.default_rng(12)
    for _ in range(300):
        source, text = random_page(rng)
        assert "".join(html_text.page_text(source).split()) == text, source


def test_html_visibility_values_and_depth():
    assert html_text.page_text('<div style="visibility:hidden">a<span style="visibility:visible">b</span></div>') == "b"
    assert html_text.page_text("<ol><li>x<li value=5>y<li>z</ol>") == "1. x\n5. y\n6. z"
    import time

    took = []
    for n in (4000, 32_000):
        start = time.perf_counter()
        html_text.page_text("<p><table><td>" + "<div>" * n + "x")
        took.append(time.perf_counter() - start)
    assert took[1] < 8 * 4 * max(took[0], 0.01)  # a quadratic walk takes 64 times as long


def test_html_refuses_clashing_columns(spark):
    with pytest.raises(ValueError):
        html_text.extract_text(spark.createDataFrame([(1, "a", "b")], "page_id long, html string, text string"), keep=("text",))


# ---- toxicity ----


def test_label_model_against_plain_loops():
    rng = np.random.default_rng(8)
    y = rng.random(300) < 0.3
    votes = np.column_stack([y ^ (rng.random(300) < e) for e in (0.1, 0.2, 0.3)]).astype(float)
    got, found = toxicity.label_model(votes, y.astype(float), rounds=3, least_correlation=1.0)
    rows = [[*v, float(t)] for v, t in zip(votes.tolist(), y.tolist(), strict=True)]
    r = [0.95 if t else 0.02 for t in y.tolist()]
    for _ in range(3):
        one = [(sum(a * x[k] for a, x in zip(r, rows, strict=True)) + 0.5) / (sum(r) + 1) for k in range(4)]
        zero = [(sum((1 - a) * x[k] for a, x in zip(r, rows, strict=True)) + 0.5) / (sum(1 - a for a in r) + 1) for k in range(4)]
        prior = sum(r) / len(r)
        r = []
        for x in rows:
            odds = np.log(prior / (1 - prior)) + sum(np.log(a / b) if v else np.log((1 - a) / (1 - b)) for v, a, b in zip(x, one, zero, strict=True))
            r.append(1 / (1 + np.exp(-odds)))
    assert np.allclose(found["share"], 1) and np.allclose(found["rate1"], one, atol=1e-5) and np.allclose(got, r, atol=1e-4)


def test_mined_features_against_counts(spark):
    rng = np.random.default_rng(3)
    docs, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [f"word{rng.integers(40)}" for _ in range(20)] + (["vilest", "vilely"][: 1 + i % 2] if bad else [])
        docs.append((i, " ".join(words) if i % 50 else None))
        labels.append((i, int(bad)))
    df, own = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(df, own, F.lit(True))
    assert {"vilest", "vile*", "vil*"} <= set(model.weights) and model.weights["vilest"] > 0
    got = {r.id: r.predicted for r in toxicity.score(df, model).collect()}
    assert [i for i, t in docs if got[i] != int(i % 4 == 0 and t is not None)] == []


# ---- toxicity on tables ----


def test_label_model_discounts_copies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    good, bad = y ^ (rng.random(4000) < 0.05), y ^ (rng.random(4000) < 0.4)
    votes = np.column_stack((good, bad, bad, bad)).astype(float)
    posterior, found = toxicity.label_model(votes, (y ^ (rng.random(4000) < 0.03)).astype(float))
    assert found["share"][1] < 0.5 and found["share"][0] > found["share"][1]
    assert found["rate1"][0] > 0.8 > found["rate1"][1] and found["rate0"][0] < 0.2 < found["rate0"][1]
    assert np.mean((posterior > 0.5) == y) > 0.95


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    model = toxicity.learn(docs, labels, rest != 2)
    rows = toxicity.score(docs.where(rest == 2), model).withColumnRenamed("id", "doc_id").join(labels, "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / max(1, sum(r.predicted for r in rows)) > 0.95 and hit / sum(r.toxic for r in rows) > 0.8
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1)], "doc_id long, text string, predicted int")
    assert [r.predicted for r in toxicity.score(odd, model).collect()] == [0, 0]
    empty = toxicity.learn(docs, labels.limit(0), rest != 2)
    assert toxicity.score(odd, empty).where("predicted = 1").count() == 0


def test_runs_of_code_switched_words(spark):
    left, right = "alpha beta gamma delta".split(), "drei vier fuenf sechs".split()
    draw = np.random.default_rng(3)
    texts = [" ".join(draw.choice(side, 30)) for side in (left, right) for _ in range(20)]
    model = language.fit(texts, ["l"] * 20 + ["r"] * 20)
    mixed = " ".join(left * 4 + right * 6)
    rows = spark.createDataFrame([(1, mixed), (2, None), (3, ""), (4, "gamma"), (5, mixed)], "doc_id long, text string")
    out = {r.id: r for r in language.identify(rows, model).collect()}
    runs = out[1].runs
    assert [(r.lang, r.first, r.last) for r in runs] == [("l", 0, 15), ("r", 16, 39)]
    assert all(0.5 < r.probability <= 1 for r in runs)
    assert out[1].lang_pred == "r" and out[5].runs == runs
    assert out[2].runs == out[3].runs == []
    assert [(r.lang, r.first, r.last) for r in out[4].runs] == [("l", 0, 0)]


def test_runs_do_not_depend_on_the_block():
    model = language.fit(["aa bb cc"] * 9 + ["xx yy zz"] * 9, ["l"] * 9 + ["r"] * 9)
    texts = pa.array(["aa bb xx yy", None, "", "zz aa", "cc " * 50 + "xx", "!!!"])
    whole, pieces = language.predict(model, texts), language.predict(model, texts, at_once=3)
    assert whole[0] == pieces[0] and np.allclose(whole[1], pieces[1])
    assert [[(r["lang"], r["first"], r["last"]) for r in x] for x in whole[2].to_pylist()] == [[(r["lang"], r["first"], r["last"]) for r in x] for x in pieces[2].to_pylist()]


def test_labelled_texts_without_words():
    model = language.fit(["", " ", "\n"], ["l", "r", "l"])
    names, scores, runs = language.predict(model, pa.array([" aa bb ", None]))
    assert names[1] == "und" and all(0 <= x <= 1 for x in scores) and [len(x) for x in runs.to_pylist()] == [1, 0]
