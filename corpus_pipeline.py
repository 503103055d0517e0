"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents. Tables in between are
Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoarfrost.llm import quality_model
from hoarfrost.llm.common import fresh, named, ship, table, taken, written
from hoarfrost.llm.registry import GOOD, packed
from hoarfrost.llm.secret_scan import redact_secrets
from hoarfrost.llm.simhash import one_of_each
from hoarfrost.llm.suffix_dedup import remove_repeats


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier scores under GOOD. It learns from the labels of the stage's own documents.

    Null and empty texts are scored as one empty passage; repeated rows are
    judged alike; an empty table stays empty.
    """
    ship(spark)
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    (score,) = fresh(docs.columns, "quality_score")
    return taken(quality_model.score(docs, model, column=score).where(named(score) >= GOOD), docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: the one of the smallest id.

    Null texts and texts without words are copies of each other; a null id is
    kept only where a group has no other; of repeated rows one stays.
    """
    ship(spark)
    return one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out of each text the 50-byte strings that documents of smaller ids have.

    Bytes of characters that were cut through go as well; a text may end up
    empty, and a null one is empty afterwards. Null ids count as the largest;
    rows of one id don't take from each other. All rows stay.
    """
    ship(spark)
    own = ["n_bytes", "n_removed", "n_spans", "kept"]
    aside = dict(zip(own, fresh(docs.columns, *(f"own_{c}" for c in own))))
    apart = docs.select(*[named(c).alias(aside.get(c.lower(), c)) for c in docs.columns])
    cut = remove_repeats(apart, decode=True)
    return counted(cut.select(*[named("kept" if c == "text" else aside.get(c.lower(), c)).alias(c) for c in docs.columns]), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in place of each secret. Null and empty texts stay as they are, and so do all rows."""
    ship(spark)
    return counted(redact_secrets(docs), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences: a row a piece. Null and empty texts are the end token alone; repeated rows are packed each."""
    ship(spark)
    return packed(docs)


def counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with n_chars as it is now."""
    return taken(docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs, columns)


STAGES = [
    ("quality classifier", drop_poor),
    ("near duplicates", drop_near_copies),
    ("repeated substrings", cut_repeats),
    ("secret scan", mask_secrets),
    ("best-fit packing", pack_sequences),
]

#: The classifier and the tokenizer can't be said in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
