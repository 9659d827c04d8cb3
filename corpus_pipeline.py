"""The corpus pipeline: stages over ``documents``, each applying one operator
of ``sluice.llm`` to everything its predecessor kept.

1. language ID: documents without a determined language, or whose determined
   languages explain less than half of the text together, go;
2. quality rules: documents that the rules or the line labelling reject go;
3. SimHash near-duplicates: one document of each group stays;
4. mixing: documents appear as often as the source mix takes them;
5. byte-level BPE: token counts and round-trip digests of what is left.

Models are fitted on the stage's own input (the language and line models on
bounded samples of labelled rows, see their modules). Empty tables give empty
results. Without labels the line model takes every line for content; repeated
rows are judged alike, and of a near-duplicate group with several rows of the
smallest id one row stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, crf, langmix, mixing, queries, simhash
from sluice.llm.common import fresh, held_out
from sluice.session import scratch_path

#: Smallest share of a text that its determined languages must explain together.
LANGUAGE_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one or several known languages. Null and letterless texts go,
    and those that are mostly in none of the languages the labels know (another
    language, strings of random letters, encoded data). Without a labelled row no
    language is known, and nothing is rejected."""
    model = langmix.fit(docs.where(~held_out(F.col("doc_id"))))
    if not model.languages:
        return docs
    found = fresh(docs, "_language")
    kept = docs.withColumn(found, langmix.predict_column(model, F.col("text")))
    return kept.where((F.col(f"{found}.lang_pred") != langmix.UNDETERMINED) & (F.col(f"{found}.known") >= LANGUAGE_SHARE)).drop(found)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content."""
    field = crf.fit(docs, queries.table(spark, sf_dir, "labels"))
    found = fresh(docs, "_quality")
    return docs.withColumn(found, crf.judge_column(field, F.col("text"))).where(f"{found}.kept").drop(found)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return simhash.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, as the source weights ask."""
    return mixing.sample(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count of every document that is left, with the digests of a round trip."""
    return bpe.digests(docs, *queries.rank_file())


STAGES = [("language ID", language_stage), ("quality rules", quality_stage), ("SimHash near-dedup", simhash_stage),
          ("mixing sources", mixing_stage), ("byte-level BPE", bpe_stage)]

#: SQL cannot express the trained stages and the token merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``. Every stage's result is written to
    the shared folder and read back, so a lost executor repeats one stage's
    tasks at most."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
