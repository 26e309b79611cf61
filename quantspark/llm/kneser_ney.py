"""Quality classifier: interpolated modified Kneser-Ney model of trusted text, perplexities, quantiles by language.

The model is one of words (``word_model``), whose last back-off is their spelling (``spelling``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_model
from .common import checkpoint, own_prefix, removed, shuffles_dropped, stored, table, text_col
from .spelling import CLASSES, SCALE, codes, log_table, symbols, train  # noqa: F401

#: A document is rejected above its language's quantile of trusted perplexities, times the margin.
QUANTILE, MARGIN = 0.995, 1.08


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """All columns of ``docs(doc_id, text, lang)`` and ``quality``: a struct of n_tokens, log10_prob, perplexity, threshold, kept.

    Trusted text: documents that ``labels`` calls quality 1 and not toxic; all of it trains the word model. A document is
    kept unless its perplexity passes its language's threshold: the quantile of that language's trusted documents times
    the margin. A trusted document is judged without the n-grams that it alone of all trusted ones holds, as others are.
    Languages without trusted documents, null included, take the threshold over all of them. A null or empty text has its
    end only. Without any trusted document nothing is judged: null perplexity, kept. Rows are never dropped here.
    """
    spark, own = docs.sparkSession, own_prefix(docs)
    c = lambda name: F.col(own + name)
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").alias(own + "good")).distinct()
    with shuffles_dropped(spark):
        # The one shuffle of texts, the same at every size: whether labels would fit a broadcast is not relied on.
        trusted = stored(docs.select("doc_id", "text").join(good.hint("merge"), F.col("doc_id") == c("good"), "left_semi").select(text_col().alias("text")), "trusted")
        letters = train(trusted)
    if letters is None:
        nothing = F.struct(F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("double").alias("log10_prob"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
        return docs.withColumn("quality", nothing)
    held = spark.sparkContext.broadcast(letters)
    words, unseen = word_model.train(trusted, held)
    key = F.xxhash64(text_col())
    scores = word_model.score(docs.select(key.alias("key"), text_col().alias("text")), words, unseen, held)
    held.destroy()
    # Rows of a few numbers: which documents there are, by id, language and text.
    rows = docs.select(F.col("doc_id").alias(own + "id"), F.col("lang").alias(own + "lang"), key.alias(own + "key")).distinct()
    rows = rows.join(scores, c("key") == scores["key"]).join(good, c("id") == c("good"), "left")
    log10 = (F.col("v") - F.when(c("good").isNotNull(), F.col("alone")).otherwise(0)) / SCALE
    rows = checkpoint(rows.select(own + "id", own + "lang", own + "key", c("good").isNotNull().alias(own + "trusted"), F.col("n").alias(own + "n"), log10.alias(own + "log10"), F.pow(F.lit(10.0), -log10 / F.col("n")).alias(own + "p")))
    measured = rows.where(c("trusted"))
    limit = F.percentile_approx(c("p"), F.lit(quantile), F.lit(10000)) * margin
    by = measured.groupBy(own + "lang").agg(limit.alias(own + "limit")).where(c("lang").isNotNull()).withColumnRenamed(own + "lang", own + "of")
    other = measured.agg(limit.alias(own + "other"))
    x = rows.join(F.broadcast(by), c("lang") == c("of"), "left") if by.count() <= 10_000 else rows.join(by, c("lang") == c("of"), "left")
    x = x.join(F.broadcast(other), F.lit(True))  # one row
    threshold = F.coalesce(c("limit"), c("other"))
    verdict = F.struct(c("n").alias("n_tokens"), c("log10").alias("log10_prob"), c("p").alias("perplexity"), threshold.alias("threshold"), (c("p") <= threshold).alias("kept"))
    x = x.select(own + "id", own + "lang", own + "key", verdict.alias(own + "quality"))
    found = docs.withColumn(own + "of", key).join(x, (c("of") == c("key")) & F.col("doc_id").eqNullSafe(c("id")) & F.col("lang").eqNullSafe(c("lang")))
    return found.withColumn("quality", c("quality")).drop(*[own + k for k in ("id", "lang", "key", "quality", "of")])


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "lang", "quality.*")
