"""One very long text among short ones, for operators that other tests give short texts only."""

import pytest

import corpus_pipeline
from millrace.llm import decontaminate, html_text, line_dedup, ngram_join, pii, quality_rules, warc

N = 30_000


@pytest.fixture(scope="module")
def docs(spark):
    long = "\n".join(f"l{i} a{7 * i} w{i % 977} b{3 * i} x{i % 31}" for i in range(N))
    rows = [(1, long, "en", "a", len(long)), (2, long, "en", "a", len(long)), (3, "short", "en", "a", 5), (4, "mail a@b.example " + long, "en", "b", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


def test_line_dedup(docs):
    got = {r.doc_id: r for r in line_dedup.without_repeats(docs.select("doc_id", "text")).collect()}
    assert [got[i].n_lines_removed for i in (1, 2, 3, 4)] == [0, N, 0, N - 1]


def test_ngram_join(docs):
    got = {r.doc_id: r for r in ngram_join.joined(docs).collect()}
    assert [got[i].component_id for i in (1, 2, 3, 4)] == [1, 1, 3, 1]


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(7, "L6 a42, w6 b18 x6 l7")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert [got[i].contaminated for i in (1, 2, 3, 4)] == [True, True, False, True]


def test_quality_rules(docs):
    got = {r.doc_id: r for r in quality_rules.verdicts(docs).collect()}
    assert got[1].n_words == N * 5 and got[3].base_failed


def test_personal_data(docs):
    got = {r.doc_id: r for r in pii.entities(docs).collect()}
    assert [got[i].n_email for i in (1, 3, 4)] == [0, 0, 1]


def test_html_and_warc(spark):
    story = "The old harbour was for a long time the place where all the ships of the north came in."
    page = f"<article>{f'<p>{story}</p>' * 20_000}</article>"
    df = spark.createDataFrame([(1, "u", page, 1), (2, "v", page, 2)], "page_id long, url string, html string, PAYLOAD_BYTES int")
    got = html_text.extracted(df).collect()
    assert {r.n_chars for r in got} == {20_000 * (len(story) + 1) - 1}
    back = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert back[2].refers_to == 1 and back[1].payload_bytes == len(page)


def test_pipeline_stages(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {1, 4} and got[1] > 5 * N > got[4]  # all lines of 4 but its first are in 1
