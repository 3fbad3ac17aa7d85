"""The document pipeline: five stages, each a DataFrame of documents in and out.

Each stage judges every row its predecessor kept.  ``lang`` labels of the documents themselves teach the language
stage; the benchmark table feeds the decontamination stage.  Columns that a stage needs get names that the documents
don't have, so extra columns pass through whatever their names.

Defined cases, for every stage: an empty table gives an empty table; rows are judged one by one, so repeated rows and
ids, and null ids, are documents like any others; texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import decontam, langid, neardup, packing, pii
from memloom.llm.common import bounded_batches, discard, fresh, row_keyed, scratch, table, written
from memloom.llm.queries import tokenizer_path

#: Bytes of rows that go to a Python worker at once: executors keep the memory of all stages they have run.
BATCH_BYTES = 4_000_000
#: Words that packing remembers, half of what it does alone, for the same reason.
CACHE_WORDS = 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without text or without any letter go; ``lang`` becomes the language found.

    Where no document is labelled there is nothing to learn: every document with a letter stays, its ``lang`` null.
    """
    bounded_batches(spark, BATCH_BYTES)
    found = fresh(docs, "language")
    judged = langid.fit_and_identify(docs, into=found).where((F.col(found)["lang"] != "und") | F.col("text").rlike(langid.LETTER))
    lang = F.when(F.col(found)["lang"] != "und", F.col(found)["lang"]).otherwise(F.col("lang"))
    return judged.withColumn("lang", lang.cast(docs.schema["lang"].dataType)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the least id; five-word shingles, similarity 0.8.

    Groups are groups of rows: copies under one id, or under none, are copies, and a row that merely shares its id with
    one that goes stays.  Null ids come last, and of rows of one id in one file the first is taken.  Rows without words
    link with nothing and stay.  Keys of rows are written, never the rows again.
    """
    bounded_batches(spark, BATCH_BYTES)
    row = fresh(docs, "row")
    rows = row_keyed(docs, row)
    with scratch() as keep:
        judged = neardup.near_duplicates(rows, k=5, threshold=0.8, key=row)
        group = written(judged.select(F.col(row).alias("r"), "component_id").join(rows.select(F.col(row).alias("r"), F.col("doc_id").alias("id")), "r"))
        stays = group.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "r")).alias("least")).select(F.col("least.r").alias("r"))
        goes = keep(written(group.select("r").join(stays, "r", "left_anti").withColumnRenamed("r", "goes")))
    return rows.join(goes, F.col(row) == F.col("goes"), "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least 5 % of their words inside benchmark windows go; those without words stay."""
    bounded_batches(spark, BATCH_BYTES)
    found = fresh(docs, "overlap")
    judged = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), into=found)
    return judged.where(~F.col(found)["contaminated"]).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind; ``n_chars`` follows the text; a null text stays null."""
    found = fresh(docs, "pii")
    clean = pii.redact(pii.find(docs, into=found), spans=found)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the token windows, with the ids' checksum; one set of pieces a row."""
    bounded_batches(spark, BATCH_BYTES)
    return packing.pack_digest(docs, tokenizer_path(), cache_words=CACHE_WORDS)


STAGES = [
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("personal data", personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents table; what a stage read is deleted once the next copy is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(written(stage(spark, docs, sf_dir)))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


#: Cross-parsing and tokenisation have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None
