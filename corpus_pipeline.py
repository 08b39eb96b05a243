"""The corpus pipeline: stages that are each written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import minhash, mixing, packing, quality, rules
from tilewright.llm.common import cut, n_words, remove, shared_dir, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be bad go.

    Rows are judged one by one: repeated rows share their fate, a null id has no label to learn from, null
    and empty texts are scored by the features of no words, a text is looked at whole however long. A score
    that equals the cutoff stays. Without labels of both kinds all scores are 0.5 and every row
    stays. An empty table gives an empty one.
    """
    ranker = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score_column(F.col("text"), ranker) >= quality.CUT)


def check_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts fail the base rules and go. Repeated rows share their fate; a null id has no label;
    a null language is a stratum of its own. A share that equals its cutoff stays. A text is
    counted as a whole, however long. An empty table gives an empty one. Columns of any name are kept.
    """
    return rules.passing(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: five-word shingles, similarity 0.8.

    Rows are told apart by their number in a written copy, not by doc_id: repeated rows are copies, and a
    repeated id with another text is another document. The row with the least id stays, a null id last; of
    rows with one id, any one. Null and empty texts have no copies and stay. A very long text's shingles are
    held whole in a task. An empty table gives one; columns of any name are kept.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = cut(docs.select(whole, F.monotonically_increasing_id().alias("_row")))
    texts = rows.select("_row", F.col("_doc.text").alias("text"))
    groups = minhash.near_duplicates(texts, id_col="_row", k=5, percent=80).select("_row", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_row")
    ids = rows.select("_row", F.col("_doc.doc_id").alias("doc_id"))
    first = groups.join(ids, "_row").groupBy("component_id").agg(F.min(order).alias("first"))
    return rows.join(first.select(F.col("first._row").alias("_row")), "_row", "left_semi").select("_doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Rows of one id are taken or left together, null and empty texts are left out, a null source is one more
    source. A very long text counts with all its words; equal sampling keys are taken in the order of ids. An empty
    table gives an empty one. Columns of any name are kept.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 words; no two documents of one source share one, nor do the copies that the mix made of a document.

    A longer text is cut into pieces of full sequences and a rest; a text without words has a piece of length
    0 and no sequence. Null ids and sources conflict with nothing. Repeated rows are items of their own that share no
    sequence, as they share an id; of equally long texts the one of the lower id is packed first. An empty table gives
    no rows. Other columns are not looked at.
    """
    items = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return packing.best_fit(items, "doc_id", "size", "source", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("quality_rules", check_rules),
    ("near_dedup", dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", pack),
]

#: Trained models, near duplicates and packing are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are written and read again, and the rows before them removed."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/stage"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
