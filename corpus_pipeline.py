"""A corpus pipeline: quality rules, near-duplicates, benchmark leaks, secrets, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerscope.functions.staging import staged
from ledgerscope.llm.common import own_rows, table
from ledgerscope.llm.decontam import benchmark_leaks
from ledgerscope.llm.near_dup import near_duplicate_rows
from ledgerscope.llm.packing import pack, token_pieces
from ledgerscope.llm.quality import quality_verdict
from ledgerscope.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; a null text has no words and goes, repeated rows are judged alike, an empty table gives no rows.

    The verdicts are written first: a filter on them would be pushed below the rules'
    expressions and repeat these many times over.
    """
    judged = quality_verdict(docs.select(F.struct(*docs.columns).alias("__row"), "text"), whole=False).select("__row", "kept")
    return staged(judged, "verdicts").where("kept").select("__row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates one row, the first with the least doc_id; null and repeated doc_ids are compared by text. Other columns pass through; an empty table gives no rows."""
    own = own_rows(docs, F.struct(*docs.columns).alias("doc"))
    kept = near_duplicate_rows(own.select("row", "doc.doc_id", "doc.text")).where("row = first_row").select("row")
    return own.join(kept, "row", "left_semi").select("doc.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item leaks; told by row, so null and repeated doc_ids and null texts stay as they are, and an empty table or benchmark takes nothing."""
    own = own_rows(docs, F.struct(*docs.columns).alias("doc"))
    leaks = benchmark_leaks(own.select(F.col("row").alias("doc_id"), "doc.text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("row")).distinct()
    return own.join(staged(leaks, "leaks"), "row", "left_anti").select("doc.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; a null text stays null, repeated rows and other columns stay."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences and offsets; every row has one at least, a null text that of its end, also under null or repeated doc_ids."""
    return pack(token_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scan", secrets),
    ("best-fit packing", packing),
]

#: Packing and near-duplicates have no SQL form; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
