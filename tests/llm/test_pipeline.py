"""The stages of the pipeline, each on the output of the one before."""

import corpus_pipeline
from sapwood.llm import jaccard_join, mixing, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, sizes = [docs], [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
        sizes.append(seen[-1].count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == docs.columns
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    assert sizes[1] == quality.score(docs.select("doc_id", "text"), model).where("score >= 0.3").count() < sizes[0]
    assert jaccard_join.near_duplicates(spark, seen[2]).where("n_links > 0").count() == 0
    assert sizes[2] == jaccard_join.near_duplicates(spark, seen[1]).select("component_id").distinct().count()
    assert sizes[3] == sizes[2]
    assert secrets.scan(seen[3]).where("secrets.spans <> ''").count() == 0
    assert seen[3].where("n_chars <> length(text)").count() == 0
    copies = mixing.mix_sources(spark, seen[3]).agg({"copies": "sum"}).first()[0]
    assert sizes[4] == copies
    assert seen[5].agg({"length": "sum"}).first()[0] >= sizes[4]
    assert [c for c, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources", "packing"]


def test_run_and_empty_documents(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_mix_keeps_rows_without_an_id(spark):
    rows = [(None, f"some words of row {i}", "a") for i in range(5)] + [(1, "one text", "a"), (1, "another text of it", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    copies = mixing.mix_sources(spark, docs).agg({"copies": "sum"}).first()[0]
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert mixed.columns == docs.columns
    assert sorted(map(str, mixed.collect())) == sorted(map(str, docs.collect())) and copies == 7
