"""A corpus in four stages; each stage's result is written and read again as the next one's documents.

Quality rules drop the documents that the current policy rejects. The n-gram join keeps one document of each group of near
duplicates (five words, Jaccard 0.8 or more): the one with the smallest id, and all documents without words or without an id.
It decides by id, so rows that share one are one document: they stay or go together.
The mix takes documents towards the sources' target weights, some of them up to three times. The last stage encodes and
decodes what is left: its rows hold the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellmesa.llm import bpe, jaccard, mixing, quality
from cellmesa.llm.common import stored
from cellmesa.llm.queries import vocabulary

#: SQL cannot express the encoding; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passing(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = jaccard.jaccard_components(docs.select("doc_id", "text"), words=5, num=80, den=100)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(docs.columns)  # one plan at every size


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"), ids=True, decoded=False)


STAGES = [("quality rules", quality_stage), ("n-gram Jaccard join", dedup_stage), ("mix to target weights", mix_stage), ("BPE codec", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
