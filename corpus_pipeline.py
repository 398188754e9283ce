"""Training-data pipeline over the documents table: classify, identify, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

Edge cases, by stage: null and empty texts get the classifier's score of a text without features, and have no
language, so they go at the second stage at the latest.  Rows without doc_id are never learnt from; they are
classified and identified like others, stay apart in the join and are mixed and packed.  Rows that repeat a
doc_id come through together; after mixing, a document that is taken twice is two equal rows, each packed in a
place of its own.  Ties go to the smallest doc_id.  Very long texts are read whole.  Further columns pass through
all stages but the last, whatever their names; an empty table gives empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barsmith.llm import op3_packing, op4_mixing, op5_jaccard, op8_quality, op10_langid
from barsmith.llm.common import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    return op8_quality.keep_good(docs, op8_quality.learn(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that is told with even odds at least go."""
    return op10_langid.keep_identified(docs, op10_langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 5-word shingles at 0.8 or more the one with the smallest doc_id stays."""
    return op5_jaccard.keep_one(docs, k=5, num=80, den=100)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times, laid out shard after shard in shuffled order."""
    return op4_mixing.mixed(docs, op4_mixing.mix(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their place in training sequences."""
    return op3_packing.pack(stage(op3_packing.pieces(docs), "pieces"))


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]
#: The classifier and the language models are learnt, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
