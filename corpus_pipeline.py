"""From documents to training tokens in five stages; each works on all that the one before kept.

Defined cases, in every stage: null or empty texts, null or repeated ids, repeated rows, extra columns of any name and empty tables are allowed. All stages
but the last return the columns of their input with their values; only line dedup changes texts, and n_chars with them. A null or empty text stays through
line dedup (nothing was taken from it); of near copies without words one stays; rows of one doc_id stay together; a document is mixed
by its source's rate, also without a text or an id. Without usable labels the classifier keeps all.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import bpe, common, lines, mixing, quality, simhash

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def accepted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.stage(spark, docs, sf_dir)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each line that at least three documents hold stays in one; a document left without text goes."""
    return lines.stage(spark, docs, sf_dir)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id."""
    return simhash.stage(spark, docs, sf_dir)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    row = common.free("row", docs)
    own = ["doc_id", "text", "source"]
    rest = [c for c in docs.columns if c not in own]
    packed = docs.select(*own, F.struct(F.lit(0).alias(common.free("none", docs)), *rest).alias(row))
    return mixing.emit(mixing.mix(packed)).select(*[F.col(c) if c in own else F.col(row)[c].alias(c) for c in docs.columns])


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document and the digests of both directions."""
    return bpe.tokenized(docs, public_tokenizers.path(bpe.RANKS))


STAGES: list[tuple[str, Stage]] = [
    ("quality", accepted),
    ("lines", without_repeated_lines),
    ("near_copies", without_near_copies),
    ("mixing", mixed),
    ("tokens", tokenized),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's result is written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
