import pytest

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega "
#: Nulls, empty and very long texts, ties, repeated rows, near copies, odd characters.
TEXTS = [
    (1, LONG * 3, "en", "a"), (2, LONG * 3, "en", "a"), (2, LONG * 3, "en", "a"), (3, LONG * 3 + "one more word", "en", "b"), (4, None, "en", None), (5, "", None, "b"), (6, " \n\t ", "fr", "b"),
    (7, "x" * 120_000, "en", "a"), (8, "aaaa " * 2000, "en", "a"), (9, "Ünï  cöde 　 tèxt \x1c mail bob@x.org, 10.0.0.1", "de", "c"), (10, "some line\n" * 30, "en", "c"),
    (None, LONG, "en", "a"), (None, None, None, None), (11, "Call +1 (555) 555-1234 or 4111 1111 1111 1111 password=cd5c291ad0fad3e545 now", "en", "c"),
    (12, "v1.2.3.4.5.6.7.8 a@b.c_d@e.f 300.1.1.1 1.2.3 +123 12345678901234567890", "en", "c"), (13, "prefix words " + LONG, "en", "b"), (14, "<|endoftext|> tail", "en", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, len(r[1] or ""), "x", 1) for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket string, fp int").repartition(3)


@pytest.fixture(scope="session")
def docs(spark, sf, odd):
    """Driver documents and the odd rows, under doc_ids of their own."""
    from pyspark.sql import functions as F

    return spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd.select((F.col("doc_id") + 100_000).alias("doc_id"), "text", "lang", "source", "n_chars")).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
