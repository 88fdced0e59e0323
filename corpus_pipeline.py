"""Corpus pipeline: quality filter, toxicity filter, near-duplicate removal, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again for the next.
All but the last return the columns of documents; further columns of docs are not read. Null texts count as empty, rows
that repeat or share a doc_id are documents each, an empty table gives an empty result: see each operator for the details.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hydrolith.llm import mixing, packing, quality, simhash, toxicity
from hydrolith.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more."""
    model = quality.fit_quality(docs, _labels(spark, sf_dir))
    return quality.score_quality(docs, model).where("predicted = 1").select(COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the FTRL model scores below 0.5."""
    model = toxicity.fit_toxicity(docs, _labels(spark, sf_dir))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: candidates by SimHash, linked at a similarity of five-word shingles of 0.8 or more."""
    return simhash.drop_near_duplicates(docs, width=5, similarity=0.8).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice. Documents without words are no part of a mix."""
    return mixing.apply_mix(docs).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and place."""
    import public_tokenizers

    return packing.pack_documents(docs, str(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: The stages fit models, hash shingles and pack bins: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
