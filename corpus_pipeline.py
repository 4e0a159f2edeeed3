"""A corpus pipeline of the training-data operators: quality rules, both deduplications, the mix and BPE coding."""

from colloquy.llm import common, pipeline_stages

#: (name, function of (spark, docs, sf_dir)); each one's output is written and read again as the next one's docs.
STAGES = pipeline_stages.STAGES

#: Neither the mix's shuffle nor BPE can be told in SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.materialise(stage(spark, docs, sf_dir))
    return docs
