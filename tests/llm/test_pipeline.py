"""Each stage on its own input against a brute-force version, and the whole run."""

import corpus_pipeline
from shelfmark.llm import near_dedup
from shelfmark.session import write_through
from tests.llm import test_decontaminate, test_line_dedup, test_mixing, test_near_dedup
from tests.llm.helpers import plain

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "mixing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = rows_of(docs)
        docs = write_through(stage(spark, docs, SF), "stage")
        after = rows_of(docs)
        assert docs.columns == COLUMNS
        if name == "language_id":
            assert {r[0] for r in after} == {r[0] for r in before if any(c.isalpha() for c in r[1] or "")}
        elif name == "line_dedup":
            want = {(i, t) for i, t, n in test_line_dedup.brute(before, 10) if not n or t.strip()}
            assert {r[:2] for r in after} == want
        elif name == "near_dedup":
            assert {r[0] for r in after} == {i for i, _, _, kept in test_near_dedup.brute(before, near_dedup.STAGE_PERCENT) if kept}
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            hit = {i for i, _, n, _ in test_decontaminate.brute(before, items) if n}
            assert hit and {r[0] for r in after} == {r[0] for r in before} - hit
    drawn = write_through(corpus_pipeline.STAGES[-1][1](spark, docs, SF), "stage")
    tokens = drawn.agg({"n_tokens": "sum"}).first()[0]
    everything = sum(test_mixing.n_tokens(r[1]) for r in rows_of(docs))
    assert 0.3 * everything < tokens <= 0.5 * everything
    assert plain(corpus_pipeline.run(spark, SF).select("doc_id", "epoch").collect()) == plain(drawn.select("doc_id", "epoch").collect())
