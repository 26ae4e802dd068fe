"""A corpus pipeline: language ID, near duplicates, benchmark decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; every stage but the last
returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.llm import decontamination, jaccard, language_id, mixing, pii
from keyspan.llm.common import if_small, scratch, scratch_folder, stored

ROW = "__row"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: texts that are null or have no letter, even if nothing was labelled."""
    field = language_id.train(docs, F.col("doc_id").isNotNull())
    if field is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language_id.identify(docs, field).where(F.col("lang_pred") != language_id.UND).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that of the least id; ids are null last, and need not differ.

    A row is named by 64 bits of its id and text. Rows of one name are copies, of which one goes on. Texts without a word
    are like no other and stay."""
    named = docs.withColumn(ROW, F.xxhash64("doc_id", "text"))
    has_word = F.coalesce(F.col("text").cast("string").rlike(r"\S"), F.lit(False))
    worded = named.where(has_word)
    rows = stored(worded.groupBy(ROW).agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "rows")
    copied = rows.where("copies > 1").select(ROW)
    if not copied.isEmpty():
        one = stored(worded.join(if_small(copied), ROW, "left_semi").dropDuplicates([ROW]), "copied")
        worded = worded.join(if_small(copied), ROW, "left_anti").unionByName(one)
    groups = jaccard.join(worded, doc_id=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", ROW))
    kept = stored(groups.join(rows, ROW).groupBy("component_id").agg(first.alias("first")).select(f"first.{ROW}"), "kept")
    return worded.join(kept, ROW, "left_semi").unionByName(named.where(~has_word)).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the text; n_chars becomes the length of the new text."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources have equal weights, and shuffles them."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("personal data", masked),
    ("mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again; what a stage made on the way is deleted then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        path = scratch(spark, f"stage-{i}")
        with scratch_folder(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{i}", path=path, codec="zstd")


#: Language ID, SimHash windows and masking can't be said in SQL.
ORACLE_SQL = None
