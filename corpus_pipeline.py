"""The corpus pipeline: five stages over documents, each of which works on all that the stage before it kept.

Counted as part of the subpackage `llm`. Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import decontaminate, jaccard, mixing, pii, toxicity
from weftgraph.llm._common import Scratch, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. The model is learned from the labelled documents outside the held-out third."""
    return toxicity.clean(docs, toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of least id stays."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets pseudonyms of the same format, so n_chars stays true."""
    return pii.pseudonymise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the number of its turn."""
    return mixing.mix_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("PII", pseudonymise),
    ("mixing sources to target weights", mix),
]

#: A learned classifier and keyed permutations aren't SQL. Tests hold each stage against planted cases, and the operators
#: it calls against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each written to the shared folder before the next reads it."""
    scratch = Scratch(spark)
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, f"stage{i + 1}")
            if before is not None:
                scratch.drop(before)
            before = docs
    return docs
