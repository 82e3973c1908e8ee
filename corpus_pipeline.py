"""A corpus from raw documents to packed training sequences, in five stages.

toxicity drops what the classifier rejects; near_duplicates keeps one document of each group;
decontamination drops documents that hold a benchmark window; secrets replaces secrets in the
texts that stay; packing returns the pieces of what is left with their token ids and places.  All stages but the
last return the columns of documents; each works on all its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadweave.llm import decontaminate, neardup, packing, secret_scan, toxicity
from loadweave.llm.common import own_tables, row_key, sweep, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


#: Jaccard similarity of five-word shingles from which the stage links two documents.
NEAR = (80, 100)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays, that of its smallest doc_id; rows without words stay."""
    return neardup.deduplicated(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark")).where("size(hit) > 0")
    gone = found.select(F.col("row_key").alias("__row_key")).distinct()
    return docs.withColumn("__row_key", row_key()).join(gone, "__row_key", "left_anti").select(*docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hidden = secret_scan.redacted(docs)
    return hidden.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else hidden


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", hide_secrets),
    ("packing", pack),
]

#: SQL can't express the learned stages; tests hold each stage against its operator and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with own_tables():
        for name, stage in STAGES[:-1]:
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            sweep(spark, {docs._written_to})  # the stage's result stands, so nothing reads what it was made of
        return STAGES[-1][1](spark, docs, sf_dir)
