"""What must hold of the plans and of the written tables."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx, queries as checked
from shelfmark import session
from shelfmark.functions import text
from shelfmark.operators import features, lemma, prepare

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def cleaned(spark):
    docs = fx.table(spark, SF, "documents").select(F.col("doc_id").alias("row_id"), text.clean_text(F.col("text")).alias("t"))
    return session.write_through(docs, "cleaned")


def lemmatised(cleaned, **options):
    forms = fx.lemma_table(cleaned.select(F.explode(F.split("t", " ", -1))))
    return lemma.lemmatise(cleaned, ["t"], session.write_through(forms, "forms"), **options)


def test_lemma_paths_agree(cleaned):
    small, large = lemmatised(cleaned), lemmatised(cleaned, limit=0)
    rows = lambda df: sorted(map(tuple, df.select("row_id", "t").collect()))
    want = sorted(
        (r["row_id"], " ".join(w[:-2] if len(w) >= 5 else w for w in r["t"].split(" "))) for r in cleaned.collect()
    )
    assert rows(small) == rows(large) == want


def test_words_stay_where_they_are_when_the_forms_fit(cleaned):
    exchanges = [x for x in plan_of(lemmatised(cleaned)).splitlines() if "Exchange hashpartitioning" in x]
    assert exchanges and not any("word" in x for x in exchanges)


def test_de_duplication_groups_only_ids(spark):
    offers = fx.offers_docs(spark, SF)
    plan = plan_of(prepare.drop_duplicates(offers))
    assert "SortAggregate" not in plan and "min_by" not in plan


def test_vocabulary_takes_ties_by_term(spark):
    counts = spark.createDataFrame(
        [("b", f"t{i:03}", 3 + i % 2, 10 if i < 5 else 4) for i in range(300)] + [("c", "x", 1, 1), ("c", "y", 2, 2)],
        "block string, term string, df long, ctf long",
    )
    blocks = [features.Block("b", "b", 1, 1, 40), features.Block("c", "c", 1, 1, 40, min_df=2)]
    top = features.top_terms(counts, blocks)
    got = sorted(r["term"] for r in top.where("block = 'b'").collect())
    assert got == [f"t{i:03}" for i in range(40)]
    assert [r["term"] for r in top.where("block = 'c'").collect()] == ["y"]
    assert "Window" not in plan_of(top)


def test_written_tables_lie_in_the_configured_folder_and_can_go(spark):
    path = session.new_table_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/"))
    for file in Path(session.__file__).parent.rglob("*.py"):
        assert "tempfile" not in file.read_text()


def test_remove_tables(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    assert session.write_through(spark.range(5), "x").count() == 5
    assert list(tmp_path.iterdir())
    session.remove_tables(spark)
    assert not list(tmp_path.iterdir())


def test_broadcast_goes_by_content(spark):
    """Arrays, structs, maps and binaries count by what they hold."""
    rows = spark.range(200).select(F.array_repeat("id", 5000).alias("many"))
    assert not session.is_small(rows, 10_000_000) and session.is_small(rows, 30_000_000)
    texts = spark.range(100).select(F.array(F.struct(F.repeat(F.lit("x"), 1000).alias("t"))).alias("s"), F.lit(None).cast("array<string>").alias("none"))
    assert not session.is_small(texts, 100_000) and session.is_small(texts, 200_000)
    maps = spark.range(100).select(F.create_map("id", F.repeat(F.lit("y"), 500)).alias("m"), F.repeat(F.lit("z"), 100).cast("binary").alias("b"))
    assert not session.is_small(maps, 60_000) and session.is_small(maps, 100_000)
    assert session.is_small(rows.where("false"), 0) and "BroadcastHashJoin" in plan_of(spark.range(3).join(session.broadcast_if_small(spark.range(3)), "id"))


def test_texts_of_one_language_are_not_one_task(spark):
    """The ranks go to the rows; the texts are dealt by id only, and none of the tasks gets a language."""
    plan = plan_of(fx.offers_docs(spark, SF))
    texts = [x for x in plan.splitlines() if "Exchange hashpartitioning(lang" in x or "SortMergeJoin" in x]
    assert "BroadcastHashJoin" in plan and not [x for x in texts if "SortMergeJoin" in x]


@pytest.fixture
def one_language(spark, tmp_path):
    """Documents of which 95 % are in one language; no table is small enough to be broadcast by itself."""
    rows = [(i, f"text {i} of a few words", "en" if i % 20 else "de", f"source {i % 5}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    # Small partitions aren't put together, as those of a large table wouldn't be.
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield str(tmp_path)
    for k, v in before.items():
        spark.conf.set(k, v)


def most_rows_of_a_task(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_dedup_first_gives_no_task_a_language(spark, one_language, monkeypatch):
    seen, drop = [], prepare.drop_duplicates
    monkeypatch.setattr(prepare, "drop_duplicates", lambda offers: seen.append(offers) or drop(offers))
    assert checked.dedup_first(spark, one_language).count() == 800
    assert most_rows_of_a_task(seen[0]) < 200


def test_char_wb_ngrams_gives_no_task_a_language(spark, one_language, monkeypatch):
    seen, count = [], features.corpus_counts
    monkeypatch.setattr(features, "corpus_counts", lambda docs, blocks: seen.append(docs) or count(docs, blocks))
    assert checked.char_wb_ngrams(spark, one_language).where("term = ' te'").first()["df"] == 800
    assert most_rows_of_a_task(seen[0]) < 200


def test_parts_follow_the_size_of_the_files(spark):
    rows = fx.table(spark, SF, "documents")
    size = sum(p.stat().st_size for p in [Path(SF, "documents.parquet")])
    cores = spark.sparkContext.defaultParallelism
    assert fx.n_parts(rows) == max(cores, -(-size // fx.PART_BYTES))
    assert fx.n_parts(rows, 1000) == -(-size // 1000) > cores
    assert fx.dealt(spark, SF, "documents", "doc_id").rdd.getNumPartitions() == fx.n_parts(rows)


def test_only_distinct_words_meet_the_dictionary(spark, cleaned, monkeypatch):
    """No written table of the lemma join is made from all words: each explodes the texts at most to count them."""
    plans = {}
    write = lemma.write_through
    monkeypatch.setattr(lemma, "write_through", lambda df, name: plans.update({name: plan_of(df)}) or write(df, name))
    forms = session.write_through(fx.lemma_table(cleaned.select(F.explode(F.split("t", " ", -1)))), "forms")
    lemma.lemmatise(cleaned, ["t"], forms)
    assert "Generate" in plans["lemma-occurring"]
    assert "Generate" not in plans["lemma-forms"] and "Generate" not in plans["lemma-unknown"]
