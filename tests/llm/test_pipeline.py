"""The pipeline's stages keep the documents' columns and clean rows, and their decisions take effect."""

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    counts = [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        from moraine.llm.storage import written

        docs = written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == list(pipeline.COLUMNS)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    packed = pipeline.pack_sequences(spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]


def test_planted_rows(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    clean = " ".join(f"word{i}" for i in range(200))
    rows = [(1, clean), (2, clean.replace("word77", "other")), (3, f"before {bench} after"), (4, " ".join(f"fine{i}" for i in range(60)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in pipeline.keep_one_of_near_copies(spark, docs, SF).collect()) == [1, 3, 4]
    assert sorted(r.doc_id for r in pipeline.drop_contaminated(spark, docs, SF).collect()) == [1, 2, 4]
    passage = " ".join(f"same{i}" for i in range(55))
    twice = spark.createDataFrame([(1, f"{passage}\nown line of the first document", "en", "s", 1), (2, f"{passage}\nanother line of the second one", "en", "s", 1), (3, passage, "en", "s", 1)], docs.schema)
    out = {r.doc_id: r.text for r in pipeline.drop_repeated_lines(spark, twice, SF).collect()}
    assert passage in out[1] and passage not in out[2] and 3 not in out
