"""Five stages over documents: language ID, n-gram Jaccard join, decontamination, mixing, token ids.

Every stage takes rows of documents as they stand and returns rows with the same columns; rows are judged one by one, so
null and repeated doc_ids don't matter to the others. Null and empty texts are letterless, so the first stage drops them;
given to a later stage alone, they stay. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import decontam, langid, mixing, ngram, tokens
from ferrule.llm.common import Scratch


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in whose text no language is found go."""
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.identified(docs, model, spans=False)
    return found.where(F.col("lang_pred") != langid.UND).select("row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id stays of each group of near copies; rows that repeat an id and a text are one."""
    return ngram.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of any benchmark item go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are repeated or left out by the rates that bring the domains to their weights."""
    labels = mixing.labelled_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mixing.mixed(docs, mixing.mixing_rates(docs, labels, mixing.TARGETS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written token files hold of each row."""
    return tokens.write_tokens(docs).documents()


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix),
    ("token-ID / binary output", token_ids),
]

#: A learned model, connected components and fitted rates have no SQL form; tests hold each stage to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch, before = Scratch(spark, "pipeline"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, f"stage{k}")
            if before is not None:
                scratch.drop(before)
            before = docs
    scratch.at_exit()
    return docs
