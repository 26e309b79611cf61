"""The quality model's tables reach the driver as Arrow columns: as rows they took some 300 MB of it, and more with every n-gram known."""

import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from quantspark.llm import kneser_ney, spelling


@pytest.fixture
def rows_taken(monkeypatch):
    taken = []
    collect = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: taken.append(len(found := collect(self))) or found)
    return taken


def test_no_rows_of_the_model(spark, sf, rows_taken):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    judged = kneser_ney.classify(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert judged.sparkSession.conf.get("spark.sql.execution.arrow.pyspark.enabled") == "false"
    assert max(rows_taken, default=0) < 1000


def test_orders_are_sorted_and_whole(spark):
    texts = spark.createDataFrame([("the cat saw the dog",), ("a dog",), (None,)], "text string").repartition(3)
    want = next(spelling._counts(iter([pa.record_batch([pa.array(["the cat saw the dog", "a dog", None])], ["text"])])))
    model = spelling.train(texts)
    assert [len(set(code.tolist())) for code, _, _ in model] == [len(code) for code, _, _ in model]
    assert model[-1][0].tolist() == sorted(want.column(0).to_pylist())
    for code, part, back in model:
        assert (code[1:] > code[:-1]).all() and ((0 < part + back) & (part < 1) & (back <= 1)).all()
        assert code.dtype == "int32" and part.dtype == back.dtype == "float64"
