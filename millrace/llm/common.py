"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import functools
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.scratch import remove_stored, scratch_path, stored  # noqa: F401  for the operators of this folder

#: ASCII white space: the characters that part words, as everywhere in this folder.
WHITE = " \t\n\x0b\x0c\r"

ROWS, BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


def free_name(docs: DataFrame, name: str) -> str:
    """A name for a new column that the table does not have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def importable(query):
    """query(spark, ...), with this package's folder on the path of Python workers on machines that have it (elsewhere, submit with --py-files), and with
    Arrow batches of at most BATCH rows unless the session sets fewer: whole texts are long, and a batch stands in memory on both sides."""

    @functools.wraps(query)
    def run(spark: SparkSession, *rest):
        root, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
        if root not in held.split(":"):
            spark.sparkContext.environment["PYTHONPATH"] = ":".join(filter(None, [root, held]))
        if not 0 < int(spark.conf.get(ROWS)) <= BATCH:
            spark.conf.set(ROWS, str(BATCH))
        return query(spark, *rest)

    return run


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def nested(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the whole row as _row, so that new columns clash with none of the table's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def native_words(text: Column) -> Column:
    """The words of a text (null: none), parted by ASCII white space."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), WHITE[1:], " " * 5), " "), "")
