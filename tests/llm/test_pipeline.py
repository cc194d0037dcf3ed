"""The stages in order, each on what the one before kept."""

from helpers import DATA

import __spark_entry__ as entry
import corpus_pipeline


def test_stages_and_run(spark, tmp_path):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_classifier", "near_dedup", "benchmark_decontamination", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns and docs.count() <= count
            count = docs.count()
    by_hand = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in docs.collect())
    whole = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in entry.queries()["pipeline"](spark, DATA).collect())
    assert whole == by_hand


def test_empty_table(spark, tmp_path):
    for table in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{DATA}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in entry.queries()) == 1
