"""A training-data pipeline: each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagepress.llm.core import fresh, scratch, ship
from pagepress.llm.decontamination import drop_contaminated
from pagepress.llm.jaccard_join import keep_one_of_each
from pagepress.llm.mixing import draw_mix
from pagepress.llm.quality_rules import keep_good
from pagepress.llm.token_blocks import encode_stage

STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", draw_mix),
    ("token-ID output", encode_stage),
]
# SQL can't express the stages that hash (components, mixing) or the tokenizer; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh(spark, f"stage{i}")
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
