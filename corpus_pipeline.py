"""From raw documents to training shards: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from tilewright.llm import decontaminate, mixing, setsketch, sharding, toxicity
from tilewright.llm.common import keep

STAGES = [
    ("toxicity", toxicity.toxicity_stage),
    ("near duplicates", setsketch.near_stage),
    ("decontamination", decontaminate.decontamination_stage),
    ("mixing", mixing.mix_stage),
    ("sharding", sharding.shard_stage),
]

#: The trained classifier and the latent search can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Apply all stages to the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
