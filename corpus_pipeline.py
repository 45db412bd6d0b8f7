"""A corpus from raw documents to a training mix, in five stages.

Each stage takes the documents that the one before it kept, as a table read from Parquet; the table before that and
what a stage kept for itself are deleted when it is written.

Defined cases, for every stage: a null, empty or letterless text is rejected by the first stage; a null id is kept like any other; repeated
rows are one class of near duplicates, of which one row stays (ties by a hash of the row); very long texts go through whole; extra columns
stay, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausemill.llm import common, decontaminate, langid, mixing, pii, simhash

#: A text is like no known language from this out-of-place distance (0 to 1) on.
FOREIGN = 0.95


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that no language profile comes near to."""
    profiles = langid.fit(docs.where(~common.held_out("doc_id", langid.FOLDS)))
    packed = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    scored = langid.identify(packed, profiles, carry=("_row",))
    return scored.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("distance") < FOREIGN)).select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return simhash.dedupe(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean(docs, common.read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, are generalised in the texts."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target says."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of a data folder; what a stage keeps is a table in the shared folder."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with common.scratch():
            after = common.lasting(common.keep(stage(spark, docs, sf_dir), name))
        common.drop(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: The fingerprints and profiles have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
