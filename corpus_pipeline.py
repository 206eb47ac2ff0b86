"""The corpus pipeline: language ID, near duplicates, secrets, mixture, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixtide.llm._common import Tables, documents, materialize
from mixtide.llm.language import UNKNOWN, held_out_column, identify
from mixtide.llm.mixing import mix
from mixtide.llm.ngram_join import keep_one_of_each
from mixtide.llm.packing import pack
from mixtide.llm.secrets import redact


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay, with the predicted one as lang; those with a null text or without letters go.

    Rows with a null doc_id or lang, repeated rows and extra columns of any name pass through; ties go to the first
    language by code point; an empty table, or one without any lang, stays or becomes empty.
    """
    carried = docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))).withColumn("text", F.col(f"c{docs.columns.index('text')}"))
    found = identify(carried, docs.filter(~held_out_column()), [c for c in carried.columns if c != "text"])
    kept = found.filter(F.col("lang_pred") != UNKNOWN)
    return kept.select(*((F.col("lang_pred") if c == "lang" else F.col(f"c{k}")).alias(c) for k, c in enumerate(docs.columns)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that link on five-word shingles at 0.8 or more, that of the smallest doc_id stays.

    Null or wordless texts and null doc_ids link with nothing and stay; of equal rows with words one stays; rows that share
    a doc_id but not a text are judged apart; an empty table stays empty; extra columns pass through.
    """
    return keep_one_of_each(docs, n=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets' values are replaced, but not those of widely copied examples; all documents stay.

    Null texts stay null, repeated rows are treated alike, a null source is one owner; an empty table stays empty; extra
    columns pass through.
    """
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mixture takes it.

    Null and wordless texts are never taken, a null source is a source, ties in position go by doc_id, equal rows are taken
    one after the other; an empty table stays empty; extra columns pass through.
    """
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boundary records of the packed sequences, in the order of the mixture.

    Null and empty texts are an end id alone, a null doc_id stays null, repeated rows are packed each on their own; an
    empty table has no records; extra columns are ignored.
    """
    return pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: Language inference and tokenisation have no SQL form; tests/llm/test_pipeline.py holds the stages and run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written before the next one reads it, and removed when that one is written."""
    docs, last = documents(spark, sf_dir), len(STAGES) - 1
    tables: list[Tables] = []
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == last:
            docs = materialize(out, f"stage-{name}")
        else:
            tables.append(Tables(spark))
            docs = tables[-1].write(out, f"stage-{name}")
        if k:
            tables[k - 1].remove()
    return docs
