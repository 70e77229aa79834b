"""Corpus pipeline: from raw documents to packed training sequences.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``.  All but the last return the columns of ``documents``.

1. quality: documents that the positive-unlabelled classifier rejects go,
2. near duplicates: of each SimHash group the document with the smallest id stays,
3. substrings: words of passages that stood in a document with a smaller id go;
   ``text`` and ``n_chars`` are brought up to date, and a document goes if
   nothing is left of it,
4. decontamination: documents of which benchmark windows cover a twentieth or
   more go; in all others these passages are cut out of ``text``, and ``n_chars``
   is brought up to date,
5. packing: what is left becomes sequences of at most 1024 tokens.

Defined cases: rows with a null id pass the stages that need ids to compare;
null and empty texts are handled as the operators say (they are near duplicates
of each other, so one of them stays); empty tables pass all stages; other columns
of ``documents`` may have any names and stay as they are, but ``n_chars``, where
there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontam, packing, quality, simhash, substring
from gridloom.llm._common import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learn=~quality.held_out())
    return quality.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest id."""
    groups = simhash.near_duplicates(docs)
    gone = groups.where("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stood in an earlier document."""
    return substring.remove(docs, size_col="n_chars")


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark windows: cut out where they cover less than a twentieth of a document, else the document goes."""
    return decontam.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_text),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
