"""Cleaning a corpus: language ID, line dedup, near-duplicates, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and returns documents; its result is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents; the last adds ``copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from antecede.llm import language, line_runs, mixing, templates
from antecede.llm.simhash import one_of_each
from antecede.llm.store import stored, table

#: A document stays if its language is known with at least this probability.
LEAST_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts that no learned language explains better than the others together."""
    answer = language.predictor(spark, language.fit(docs))(F.col("text"))
    rows = docs.select(F.struct("*").alias("row"), answer.alias("answer"))
    return rows.where((F.col("answer.lang_pred") != language.UNKNOWN) & (F.col("answer.score") >= LEAST_SCORE)).select("row.*")


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines out that at least ten documents have; n_chars is that of what is left."""
    kept = line_runs.drop_common_lines(docs, min_docs=10, min_chars=1)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates one row stays, that with the smallest id; rows without an id stay. Each row is
    decided by its own text: rows that share an id but are no copies of each other stay both."""
    return one_of_each(docs, width=3, bound=3)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names or units, go."""
    found = templates.leaks(docs, table(spark, sf_dir, "benchmark"), width=5, similarity=0.8)
    gone = stored(found.select(F.col("id").alias("doc_id")).distinct(), "leaking-ids")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies; sources weigh 3, 1, 2 in turn. A column of the documents that is
    named ``copies`` already gives way to it."""
    taken = mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0, carry=True)
    return taken.where("copies > 0").select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "copies"], "copies")


STAGES = [
    ("language", known_language),
    ("line_dedup", without_common_lines),
    ("near_dedup", without_near_copies),
    ("decontaminate", without_leaks),
    ("mix", mixed),
]
#: Language, fingerprints and templates are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
