"""A training-corpus pipeline: quality rules, exact and near deduplication, source mixing, piece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import mixing, pieces
from tidelog.llm.common import Scratch, ascii_lower, table
from tidelog.llm.exact_dedup import exact_dedup
from tidelog.llm.near_dedup import near_dedup
from tidelog.llm.quality import keep_good
from tidelog.llm.queries import tokenizer_path


def _row(docs: DataFrame):
    """All columns of a row as one, so that no name of theirs meets those of a stage."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, row by row."""
    return keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays (one without doc_id only where no other has one), once if the row is repeated."""
    key = lambda sha: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), sha).alias("key")
    stays = exact_dedup(docs, keep="max").where("kept").select(key(F.col("text_sha256"))).distinct()
    rows = docs.select(_row(docs), key(F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)))
    return rows.join(stays, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest doc_id; five words a shingle, similarity 0.8. Rows without doc_id are compared with none, and stay."""
    stays = near_dedup(docs).where("kept").select("doc_id").distinct()
    return docs.join(stays, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document has as many rows as the mixture shows it; every document has one at least."""
    shown = mixing.mix_sources(docs, split=True).groupBy("doc_id").agg(F.max("epoch").alias("epochs"))
    more = shown.where("epochs > 1")  # with nothing to repeat, rows stay as they are
    rows = docs.select("doc_id", _row(docs)).join(more, "doc_id", "left")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.coalesce("epochs", F.lit(1)))).alias("copy")).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every row."""
    return pieces.encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("source_mixture", source_mixture),
    ("piece_encoding", encoded),
]

#: Robust estimates, MinHash components and merges by rank are nothing that SQL can express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written to the shared folder and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
