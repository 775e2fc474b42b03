"""The corpus pipeline: quality rules, near duplicates, decontamination, mixing, token output.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs.  All but
the last return the columns of documents, whatever other columns docs may have too.

Cases: null texts are rejected by the quality rules; null ids pass the joins by id
untouched; repeated rows are judged alike; an empty table stays empty, and its last
stage gives no shards.  Stages read labels and benchmark from sf_dir, the corpus only
from docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docgrove.llm import decontamination, jaccard, mixing, quality, training_order
from docgrove.llm.shared import scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio keep."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each component of Jaccard links."""
    return jaccard.one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix: documents past the budget go, and those taken again are repeated."""
    return mixing.mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training-order shards of the mix's token ids, with their payloads."""
    return training_order.training_shards(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_output),
]

#: Token ids, the likelihood ratio's hashes and the keyed permutation have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents.

    What a stage keeps is written to the shared folder and read again.  Tables that a
    stage made on its way go with the stage; of the stages' own tables, the one that the
    last stage reads stays, and the others go.
    """
    docs = table(spark, sf_dir, "documents")
    *early, (_, last) = STAGES
    with scratch(spark) as keep_last:
        for i, (name, stage) in enumerate(early):
            with scratch(spark) as keep:
                kept = keep_last if i == len(early) - 1 else keep
                docs = kept(stage(spark, docs, sf_dir), "stage-" + name.split()[0])
    return last(spark, docs, sf_dir)
