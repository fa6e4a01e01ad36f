"""From raw documents to packed training sequences.

STAGES name the steps; each works on what the one before it kept, and all but the
last return the columns of documents. run() writes every stage's result to the
shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import langid, neardup, packing, quality
from tidemark.llm.common import table, written

#: Least sureness of the languages of a text's spans.
LANGUAGE_SCORE = 0.4
#: Least quality score.
QUALITY_SCORE = 0.5


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs under names that no operator uses, and the names to restore."""
    names = docs.columns
    return docs.toDF(*[f"_c{i}" for i in range(len(names))]), names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null, empty, no letter) or whose spans are in no
    clear one; a text in several clear languages stays. Repeated rows and rows with
    null ids are judged each by their text; an empty table stays empty."""
    model = langid.trained(docs)
    plain, names = _plain(docs)
    text = plain.columns[names.index("text")]
    return langid.labelled(plain, model, tuple(plain.columns), text, least=LANGUAGE_SCORE).toDF(*names)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that the quality classifier scores below one half. Null and empty
    texts are scored by the intercept alone; repeated rows and rows with null ids
    are judged each; an empty table stays empty."""
    weights = quality.trained(quality.labelled(docs, table(spark, sf_dir, "labels"), "quality", 3, 1))
    plain, names = _plain(docs)
    text = plain.columns[names.index("text")]
    return quality.scored(plain, weights, tuple(plain.columns), text, least=QUALITY_SCORE).toDF(*names)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group (of
    rows that repeat an id, one; rows without id stay)."""
    plain, names = _plain(docs)
    key = plain.columns[names.index("doc_id")]
    kept = neardup.grouped(docs).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    with_id = plain.filter(F.col(key).isNotNull())
    out = with_id.join(kept, F.col(key) == F.col("_kept")).drop("_kept").dropDuplicates([key])
    return out.unionByName(plain.filter(F.col(key).isNull())).toDF(*names)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences; null and empty texts are their end mark alone,
    repeated rows and rows with null ids are packed each, an empty table has no piece."""
    return packing.packed(docs)


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("packing", sequences)]

#: No stage can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of what all stages keep of documents (an empty table: none)."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
