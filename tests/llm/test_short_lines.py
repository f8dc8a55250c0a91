"""Repeats of lines too short for the edit join go as well."""

import random

import corpus_pipeline as pipeline
from moraine.llm import lines, queries


def test_query_and_stage_drop_short_repeats(spark, tmp_path):
    rows = [(1, "Own words of the first document.\nAll rights reserved."), (2, "The second one holds quite other words.\n  All rights reserved.\n\nok\nok"), (3, "全部权利。\nAll rights deserved."), (4, "全部权利。\n\nok")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = {1: rows[0][1], 2: "The second one holds quite other words.\n\nok", 3: rows[2][1], 4: ""}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: (r.text, r.n_removed) for r in queries.line_dedup(spark, str(tmp_path)).collect()} == {1: (want[1], 0), 2: (want[2], 2), 3: (want[3], 0), 4: (want[4], 2)}
    out = {r.doc_id: (r.text, r.n_chars) for r in pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()}
    assert out == {i: (want[i], len(want[i])) for i in (1, 2, 3)}


def test_short_repeats_against_a_walk(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abcé ") for _ in range(rng.randint(0, 23))) for _ in range(60)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    seen, want = set(), {}
    for i, t in rows:
        left = []
        for x in t.split("\n"):
            if not x.strip() or x.strip() not in seen:
                left.append(x)
            seen.add(x.strip())
        want[i] = "\n".join(left)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.text for r in lines.dedup_lines(df, exact=1).collect()} == want
