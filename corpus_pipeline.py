"""From raw documents to packed training sequences: five stages, each of one operator of ``quantspark.llm``.

A stage takes any columns beside doc_id, text, lang and source along: they travel in a struct, so that no name clashes
with an operator's own. Null texts count as empty, rows without doc_id are treated like others, repeated rows are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.llm import kneser_ney, mixing, packing, pii, simhash
from quantspark.llm.common import SPACE, checkpoint, sent_if_small, shared_path, stored, table

#: No SQL says what the quality model, the fingerprints or the tokenizer do; tests hold the stages against plain versions.
ORACLE_SQL = None


PIECE_CACHE = 32 << 20


def _row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def _with_text(docs: DataFrame, text: Column, changed: Column) -> list[Column]:
    """The columns of ``docs`` out of the struct ``row`` with another text; n_chars follows where the text has changed."""

    def one(c: str) -> Column:
        if c == "text":
            return text.alias(c)
        own = F.col("row").getField(c)
        if c == "n_chars":
            return F.when(changed, F.length(text).cast(docs.schema[c].dataType)).otherwise(own).alias(c)
        return own.alias(c)

    return [one(c) for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps, as they are."""
    judged = kneser_ney.classify(docs.select(_row(docs), "doc_id", "text", "lang"), table(spark, sf_dir, "labels"))
    return judged.where("quality.kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, of equal ones an arbitrary one.

    Near copies are texts whose five-word shingles have a Jaccard similarity of 0.8 or more, and what such pairs join:
    SimHash fingerprints name the pairs, and an exact check follows. Decisions are made on row numbers; texts meet those of
    the rows that go.
    """
    rows = stored(docs.select(_row(docs), F.monotonically_increasing_id().alias("r")), "rows")
    found = simhash.near_copies(rows.select(F.col("r").alias("doc_id"), "row.text"))
    names = rows.select("r", "row.doc_id").join(found.select(F.col("doc_id").alias("r"), "component_id"), "r")
    kept = names.groupBy("component_id").agg(F.min_by("r", F.struct(F.col("doc_id").isNull(), "doc_id", "r")).alias("stays"))
    gone = checkpoint(names.join(kept, "component_id").where("r <> stays").select("r"))
    return rows.join(sent_if_small(gone), "r", "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its personal data replaced by the kind in brackets; n_chars follows the text."""
    found = pii.find_pii(docs.select(_row(docs), "text"))
    new = F.when(F.col("text").isNotNull(), pii.redact(F.col("text"), F.col("pii")))
    return found.select("row", "text", new.alias("new")).select(*_with_text(docs, F.col("new"), ~F.col("new").eqNullSafe(F.col("text"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row a complete epoch, and one for a part.

    A document taken in part gives its first words, joined by single spaces.
    """
    rows = stored(docs.select(_row(docs), F.monotonically_increasing_id().alias("r")), "rows")
    plan = mixing.mix_sources(rows.select("r", "row.doc_id", "row.text", "row.source"), keep=("r",)).where("taken > 0")
    rest = F.col("taken") % F.col("size")
    copies = F.floor(F.col("taken") / F.col("size")).cast("int")
    parts = F.concat(F.array_repeat(F.lit(0).cast("long"), copies), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    x = rows.join(plan.select("r", parts.alias("parts")), "r").select("row", F.explode("parts").alias("part"))
    words = F.filter(F.split("row.text", SPACE), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")
    x = x.withColumn("new", F.when(F.col("part") > 0, cut).otherwise(F.col("row.text")))
    return x.select(*_with_text(docs, F.col("new"), F.col("part") > 0))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences. Workers still hold what earlier stages left: they remember fewer pieces."""
    return packing.pack_pieces(packing.token_pieces(docs.select("doc_id", "text"), cache=PIECE_CACHE))


STAGES = [("quality classifier", quality), ("SimHash near-dedup", near_dedup), ("PII", personal_data), ("mixing sources to target weights", mix), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's rows are written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_path(spark, 'pipeline')}-{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
