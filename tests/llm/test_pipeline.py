"""Stages of the corpus pipeline on driver documents with odd rows and columns of any name."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quantspark.llm import jaccard, kneser_ney, mixing, pii

CLASHING = ("quality", "pii", "size", "taken", "row", "r", "new", "part", "parts", "key", "fp", "component_id", "label", "kept", "target", "k", "s", "slice", "__s", "__id", "node", "g")


def test_stages(spark, docs, sf):
    held = docs.withColumns({c: F.lit(c) for c in CLASHING})
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, out = held, stage(spark, held, sf).cache()
        if i < 4:
            assert out.columns == held.columns and out.where("quality <> 'quality' or fp <> 'fp'").isEmpty()
        if i == 0:
            want = kneser_ney.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("quality.kept").count()
            assert out.count() == want and out.exceptAll(before).isEmpty()
        if i == 1:
            sets = [jaccard.shingles((r.text or "").encode()) for r in before.select("text").collect()]
            groups = {jaccard.set_key(h): h for h in sets}
            names = list(groups)
            root = {n: n for n in names}

            def top(n, root=root):
                while root[n] != n:
                    n = root[n]
                return n

            for x, a in enumerate(names):
                for b in names[:x]:
                    m, n = len(groups[a]), len(groups[b])
                    if min(m, n) >= 0.8 * max(m, n) and jaccard.similarity(groups[a], groups[b]) >= 0.8:
                        root[top(a)] = top(b)
            assert out.count() == len({top(n) for n in names}) and out.exceptAll(before).isEmpty()
            assert Counter(r.doc_id is None for r in out.select("doc_id").collect())[True] <= 2
        if i == 2:
            assert out.count() == before.count() and pii.find_pii(out.select("text")).where(F.length(pii.listed(pii.KINDS)) > 0).isEmpty()
        if i == 3:
            size = lambda df: df.agg(F.sum(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")))).first()[0]
            assert size(out) == mixing.mix_sources(before.select("doc_id", "text", "source")).agg(F.sum("taken")).first()[0]
        if i == 4:
            assert out.columns[:3] == ["doc_id", "piece", "start"] and out.count() >= before.count()
        held = out


def test_each_stage_on_raw_rows(spark, odd, sf):
    """Every stage by itself on nulls, repeated rows and an empty table."""
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf).count() > 0
        assert stage(spark, odd.limit(0), sf).count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
