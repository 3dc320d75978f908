"""The corpus pipeline: documents through five of the training-data operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; what it returns is
written as Parquet and read again for the next one. Where an operator carries rows along, their columns
travel as fields of one struct, so added columns cannot clash with the rows' own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import fm_index, jaccard_join, ordinal, pii, piece_bpe
from tracemill.llm.common import dropped, stored, table
from tracemill.llm.registry import KEEP_PROBABILITY

ORACLE_SQL = None


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id and text, and row: all other columns, and one of no use, as a struct must have a field."""
    filler = F.lit(0).alias("_" * (1 + max(map(len, docs.columns))))
    return docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")], filler).alias("row"))


def _with_text(rows: DataFrame, text, columns: list[str]) -> DataFrame:
    """The rows with another text, and its length."""
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.char_length(text).cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col(f"row.{c}").alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier does not reject."""
    labels = table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", ordinal.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    named = docs.select(*[F.col(c).alias(f"row_{c}") for c in docs.columns])
    scored = ordinal.score(named, ordinal.train(docs, ratings), named.columns, text_col="row_text")
    return scored.filter(F.col("tail_probability") >= KEEP_PROBABILITY).select(*[F.col(f"row_{c}").alias(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies.

    Rows are told apart by id and a hash of all columns: of several rows that share an id, each stays that is the
    first of its own group; of those with equal shingle sets the one with the smallest hash; wordless ones all. Fully
    equal rows count as one. Rows without an id stay.
    """
    whole = "_" * (1 + max(map(len, docs.columns)))
    marked = docs.withColumn(whole, F.xxhash64(*docs.columns))
    groups = jaccard_join.near_duplicates(marked, mark=whole).filter(F.col("doc_id") == F.col("component_id"))
    firsts = groups.groupBy("doc_id", F.coalesce("class_key", whole).alias("class")).agg(F.min(whole).alias(whole)).select("doc_id", whole)
    kept = marked.join(firsts, ["doc_id", whole], "left_semi").dropDuplicates(["doc_id", whole])
    return kept.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; documents that are mostly passages go."""
    # stored, so that no task holds the Python processes of both steps
    found = stored(fm_index.find_contamination(_rows(docs), table(spark, sf_dir, "benchmark"), carry="row"), "found")
    return _with_text(fm_index.without_passages(found, ["doc_id", "row"]), F.col("clean_text"), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    found = stored(pii.candidates(_rows(docs), carry="row"), "candidates")
    marked = pii.spans(found, pii.train(found))
    return _with_text(marked, pii.redacted(F.col("text"), F.col("spans")), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document, as little-endian unsigned 32-bit integers."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    keep = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    coded = piece_bpe.encode_decode(docs, path, public_tokenizers.PATTERN, keep=keep)
    return coded.select(*keep, "n_tokens", "ids", F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        dropped(*before)
        before = [docs]
    return docs
