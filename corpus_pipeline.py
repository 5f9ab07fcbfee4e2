"""The corpus pipeline: language ID, near-dedup, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; between stages the documents are written as Parquet and read again.  All
stages but the last return the columns of ``documents``.

Defined cases of every stage: empty tables give empty tables with the same
columns; texts of any length are judged whole; further columns, whatever their
names, stay as they are (the last stage does not read them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from measurelake.llm import decontaminate, langid, packing, pii, simhash
from measurelake.llm.common import stage_table, with_rows
from measurelake.llm.queries import tokenizer_path


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, list[Column]]:
    """``docs`` with a key for each row, the key's name (no column of ``docs`` has it) and the columns of ``docs``."""
    name = "row_key"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return with_rows(docs, name), name, [F.col(f"`{c}`") for c in docs.columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised with some confidence.

    Null texts and texts without a letter go, whatever their other columns hold; repeated rows are judged alike.
    """
    names = []
    for wanted in ("lang_found", "lang_score"):
        while wanted.lower() in {c.lower() for c in docs.columns}:
            wanted += "_"
        names.append(wanted)
    judged = langid.identify(docs, langid.train(docs), out=tuple(names))
    kept = (F.col(names[0]) != langid.UNKNOWN) & (F.col(names[1]) >= langid.REJECT)
    return judged.filter(kept).drop(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group at 5-word-shingle similarity 0.8 or more: the first in order of id.

    Null ids come last; of repeated rows one stays; texts without words are equal.
    """
    rows, key, columns = _numbered(docs)
    best = simhash.similar_representatives(rows, "doc_id", key)
    return rows.join(best, key, "left_semi").select(columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item; null texts hold none, repeated rows go or stay together."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, key, columns = _numbered(docs)
    found = decontaminate.contamination(rows, benchmark, id_col=key).filter("contaminated")
    return rows.join(found.select(F.col("doc_id").alias(key)), key, "left_anti").select(columns)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and the terms that disclose it by their kinds; texts without any stay as they are.

    A column n_chars follows the text; it may be missing.  Null texts stay null; repeated rows are changed alike.
    """
    rows, key, _ = _numbered(docs)
    found = pii.find_spans(rows, id_col=key).filter("size(spans) > 0")
    found = found.select(F.col("doc_id").alias("found_row"), F.col("spans").alias("found_spans"))
    told = rows.select(F.col(key).alias("found_row"), F.col("text").alias("found_text")).join(found, "found_row")
    told = told.select("found_row", pii.generalise(F.col("found_text"), F.col("found_spans")).alias("found_text"))
    told = told.select(F.struct("found_row", "found_text").alias(f"{key}_told"))
    joined = rows.join(told, F.col(key) == F.col(f"{key}_told.found_row"), "left")
    changed = F.col(f"{key}_told.found_text")
    new = {"text": F.coalesce(changed, F.col("text"))}
    if "n_chars" in docs.columns:
        length = F.length(changed).cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(changed.isNotNull(), length).otherwise(F.col("n_chars"))
    return joined.select([new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into training sequences; null texts are empty ones, repeated rows are packed once each."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("PII", sanitise),
    ("packing", pack),
]

#: SQL cannot express the stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stage_table(docs, f"pipeline-{number}")
    return docs
