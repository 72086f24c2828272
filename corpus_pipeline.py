"""Documents to training tokens: each stage calls one operator and hands its table on.

run() applies the stages to documents. Each stage takes (spark, docs, sf_dir); all but the last return the columns of
documents, the last the token ids of each copy that the mix keeps.

Defined results, in all stages: an empty table gives an empty table; texts are read whole, however long; a null text
counts as empty and stays null; columns beside doc_id, text, source and n_chars are carried along under their own names,
also where an operator would add one of that name. What each stage does with nulls, ties and repeated rows stands there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.bpe import bpe_encode
from corpusloom.llm.common import Scratch, table
from corpusloom.llm.jaccard_join import keep_one_of_each
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.quality import fit, score_quality
from corpusloom.llm.secrets import redact, scan_secrets


NEEDED = ("doc_id", "text", "source", "lang", "n_chars")


def _apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator's rows with the columns of docs: those it does not need go through it under names that none of its own has."""
    inner = {c: c if c in NEEDED else f"carried_{i}" for i, c in enumerate(docs.columns)}
    out = operator(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]))
    return out.select(*[F.col(f"`{n}`").alias(c) for c, n in inner.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go: those that score below its threshold, on their whole text.

    Empty and null texts score alike and stay or go together; repeated rows too; a row without id is scored, not learned from."""
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return _apart(docs, lambda d: score_quality(d, model).filter("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one of least id, of equal ids the one of least text hash.

    Rows without id, without words or without text stay; rows that repeat both id and text stay or go together."""
    return keep_one_of_each(docs).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; every document stays, and n_chars follows where a text changed."""

    def clean(d: DataFrame) -> DataFrame:
        found = redact(scan_secrets(d))
        if "n_chars" in d.columns:
            size = F.length("text").cast(d.schema["n_chars"].dataType)
            found = found.withColumn("n_chars", F.when(F.size("all_spans") > 0, size).otherwise(F.col("n_chars")))
        return found

    return _apart(docs, clean)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by source towards the target weights, in random order.

    A null source is a source of its own; rows of equal id get equal numbers of copies, and so do equal rows without id."""
    return _apart(docs, mix_sources)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, with the digests of ids and of the decoded text; a row for each row, repeated ones too.

    A null or empty text has no ids."""
    return bpe_encode(docs.select("doc_id", "source", "lang", "text")).select("doc_id", "source", "lang", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: SQL cannot express the classifier, the shingle join or the merges; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what a stage keeps is written to the shared folder, and read by the next."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs)
    return docs
