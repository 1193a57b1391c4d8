"""A training-data pipeline over the documents table: five stages, each on all that the one before kept.

1. toxicity: documents that the classifier scores 0.5 or more go.
2. near-duplicates: one document of each class stays, that of the smallest id.
3. decontamination: documents of which a twentieth or more lies in benchmark windows go.
4. personal data: numbers, dates and addresses are replaced by pseudonyms; n_chars follows the text.
5. mixing: documents are repeated to the sources' target weights.

Nulls, empty and very long texts, repeated rows and ids, empty tables and other columns,
whatever their names, are treated as each operator's docstring says: texts without words
stay unless the classifier rejects them, rows without an id are never copies, a null
source is a source, and all columns of documents come back.  Each stage's table is
deleted once the next one is written; the last one's input stays for its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from websilo.llm import decontaminate, mixing, neardup, pii, toxicity
from websilo.llm.lineage import cut_table, discard
from websilo.llm.queries import PII_KEY, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.pseudonymise(docs, PII_KEY)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-duplicates", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("personal data", replace_personal_data),
    ("mixing", mix_sources),
]

#: The classifier, the signatures and the pseudonyms aren't SQL; tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed documents: the columns of the documents table, a row for each copy."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        given, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_table(docs)
            discard(given)  # does nothing for documents itself
    return docs
