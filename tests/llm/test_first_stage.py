"""The pipeline's first stage judges words by their counts, not letters alone."""

import random

import corpus_pipeline


def test_word_order_counts(spark, tmp_path):
    rng = random.Random(4)
    subjects, verbs, things = ("cat", "dog", "bird", "horse", "goat"), ("saw", "met", "left", "found"), ("the red barn", "an old house", "the long road", "a small boat")

    def sentence():
        return f"the {rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(things)} and went home again"

    rows = [(i, " ".join(sentence() for _ in range(12)), "en") for i in range(80)]
    mixed = [w for _ in range(12) for w in sentence().split()]
    order = sorted(range(len(mixed)), key=lambda i: (mixed[i][::-1], i % 7))
    rows += [(100, " ".join(mixed[i] for i in order), "en"), (101, " ".join(sentence() for _ in range(12)), "en")]
    spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert 101 in kept and 100 not in kept and len(kept) >= 80
