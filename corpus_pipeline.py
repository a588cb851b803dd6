"""A training corpus from raw documents, stage by stage.

Every stage reads what the stage before it has written and keeps the columns of ``documents``; the
last one returns the shard of every row.
"""

from undertone.llm import decontamination, language_id, mixing, sharding, signature_tree
from undertone.session import durable


def language_stage(spark, docs, sf_dir):
    """Documents whose language is known stay."""
    return language_id.keep_identified(docs)


def near_duplicate_stage(spark, docs, sf_dir):
    """Of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles, one stays."""
    return signature_tree.keep_one_each(docs, size=5, percent=80)


def decontamination_stage(spark, docs, sf_dir):
    """Documents that hold no benchmark item stay."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark, docs, sf_dir):
    """Every document as often as its source's target asks for."""
    return mixing.mix_documents(docs)


def sharding_stage(spark, docs, sf_dir):
    """The shard and slot of every row of the mix."""
    return sharding.shard_documents(docs)


STAGES = [
    ("language_id", language_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

# Models, hashes and iterations: plain SQL cannot say what the stages do.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs, f"stage-{name}")
    return docs
