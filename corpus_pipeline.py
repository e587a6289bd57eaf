"""A training corpus from documents: quality rules, language, near-duplicates, mixing, token ids."""

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm.common import stored_stage, table
from quadrille.llm.language_id import stage_language
from quadrille.llm.mixing import stage_mix
from quadrille.llm.near_dup import stage_near_dup
from quadrille.llm.quality import stage_quality
from quadrille.llm.sentencepiece_codec import stage_encode

STAGES = [
    ("quality rules", stage_quality),
    ("language ID", stage_language),
    ("MinHash near-dedup", stage_near_dup),
    ("mixing", stage_mix),
    ("SentencePiece", stage_encode),
]

#: Forests, random fields and sketches have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored_stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
