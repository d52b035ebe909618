"""Documents -> quality rules -> quality classifier -> line dedup -> n-gram Jaccard join -> packing.

Every stage takes all rows that the one before kept, whole texts of any length, and keeps the table's own columns, whatever their names; an empty table gives an empty one. Repeated
rows are judged alike. What each does with nulls, empty texts and ties stands at it; details are in the operators' docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import line_crf, line_templates, ngram_join, packing, quality_rules
from millrace.llm.common import documents, importable, stored
from millrace.llm.queries import VOCABULARY


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the learned decision list keep. Null, empty and wordless texts go, as they have fewer than 50 words; a null doc_id is a row like others."""
    learned = quality_rules.learn(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.kept(docs, learned)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-level random field scores at least as GOOD; it learns from labelled documents of the whole corpus. Null and empty texts score 0 and go; a null doc_id is a row like others."""
    model = line_crf.learn(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return line_crf.kept(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines whose template recurs; the first line of a template, by (doc_id, line), stays. Documents of which no word is left go; those without words before, and those with
    a null doc_id, stay as they are."""
    return line_templates.dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: that with the least doc_id. Documents without words or with a null doc_id are compared with nothing and stay; rows of one doc_id are one document."""
    return ngram_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens along the curve. A null text is empty and gives its end id alone; rows that tie on the curve are ordered by a hash, then by text."""
    return packing.pack(docs, VOCABULARY, 1024)


STAGES = [("quality rules", importable(rules)), ("quality classifier", importable(classifier)), ("line dedup", importable(line_dedup)), ("n-gram Jaccard join", importable(near_duplicates)), ("packing", importable(pack))]

#: SQL cannot express learned scores, Hilbert keys or byte-level BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
