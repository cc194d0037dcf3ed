"""What teaches the dictionaries doesn't calibrate, at any size."""

from helpers import docs
from pyspark.sql import functions as F

from storyweave.llm import toxicity


def test_small_tables_calibrate_on_other_documents(spark, monkeypatch):
    taught, judged = [], []
    train, fit = toxicity.train_dictionaries, toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "train_dictionaries", lambda read: taught.append(len(read)) or train(read))
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y: judged.append(len(y)) or fit(x, y))
    rows = [(i, f"some words of prose and number{i} " * 5 + "awful " * (i % 2)) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs(spark, rows), labels, F.lit(True)) is not None
    assert taught[0] and judged[0] and taught[0] + judged[0] == 80
