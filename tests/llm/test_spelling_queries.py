"""The model of spellings counts texts in one query."""

import numpy as np

from quantspark.llm import kneser_ney

TEXTS = ["the cat sat on the mat and the dog sat on the cat", "The dog saw the cat on the mat", "а кот сидел on the mat", "the the end"]


def test_spellings_take_one_query(spark):
    """As joins of its counts the model of spellings was a dozen queries, whose plans filled the driver's memory."""
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string").repartition(3)
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    model = kneser_ney.train(texts)
    assert jobs() - before <= 4
    chances = 10.0 ** (kneser_ney.log_table(model).astype(float).reshape(-1, kneser_ney.CLASSES) / -kneser_ney.SCALE)
    assert np.allclose(chances.sum(axis=1), 1, atol=0.02)
