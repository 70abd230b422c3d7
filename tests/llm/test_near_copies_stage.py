"""The near-copy stage of the pipeline: five words and 0.8."""

import corpus_pipeline


def test_two_percent_of_words_changed(spark):
    words = [f"w{i}" for i in range(200)]
    some = [f"n{i}" if i in (30, 70, 110, 150) else w for i, w in enumerate(words)]  # 3 words: 0.886, 5 words: 0.815
    more = [f"m{i}" if i in (20, 60, 100, 140, 180) else w for i, w in enumerate(words)]  # 5 words: 0.774
    rows = [(1, " ".join(words)), (2, " ".join(some)), (3, " ".join(more))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {1, 3}
