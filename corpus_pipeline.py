"""From raw documents to packed training sequences, in five stages.

Every stage reads what its predecessor wrote. All but the last return the columns of ``documents``;
the last returns the placed token pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm import decontaminate, line_dedup, near_dedup, packing, quality_model
from eventlens.llm.common import read
from eventlens.llm.queries import PREDICT_AT, VOCABULARIES
from eventlens.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_DOCS = 10


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the calibrated classifier does not reject."""
    model = quality_model.fit(docs, read(spark, sf_dir, "labels"))
    return quality_model.scored(docs.select(*COLUMNS), model).where(F.col("score") >= PREDICT_AT).select(*COLUMNS)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more documents stay in the first one only; a document that was nothing but
    such lines of earlier documents goes."""
    kept = line_dedup.without_lines(docs.select(*COLUMNS), min_docs=MIN_DOCS, keep_first=True)
    emptied = (F.col("n_dropped") > 0) & (F.btrim("kept_text", F.lit(line_dedup.BLANKS)) == "")
    changed = F.col("n_dropped") > 0
    return kept.where(~emptied).select(
        "doc_id", F.when(changed, F.col("kept_text")).otherwise(F.col("text")).alias("text"), "lang", "source",
        F.when(changed, F.char_length("kept_text").cast("bigint")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def _numbered(docs: DataFrame) -> DataFrame:
    """One row per id and text, with ``row``: a number that grows with the id."""
    prints = [F.xxhash64("text").alias("p1"), F.xxhash64(F.lit(7), "text").alias("p2")]
    single = docs.select(*COLUMNS, *prints).groupBy("doc_id", "p1", "p2").agg(
        F.first("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("rest")
    )
    ordered = single.repartitionByRange("doc_id", "p1", "p2").sortWithinPartitions("doc_id", "p1", "p2")
    rows = ordered.select("doc_id", "text", "rest.*", F.monotonically_increasing_id().alias("row"))
    return materialize(rows, "numbered-rows")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near duplicates (five-word shingles, 0.8), one row per id
    and text. Rows count by themselves, also if they share an id or have none."""
    rows = _numbered(docs)
    gone = near_dedup.near_duplicates(rows, id_col="row").where(~F.col("kept")).select("row")
    return rows.join(gone, "row", "left_anti").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, verbatim or with other numbers, units and names. Rows
    count by themselves, also if they share an id or have none."""
    named = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    keyed = docs.select(*COLUMNS, F.sha2(F.concat(named, F.lit("\n"), F.coalesce("text", F.lit(""))), 256).alias("row"))
    found = decontaminate.contaminated(keyed, read(spark, sf_dir, "benchmark"), id_col="row").select(F.col("doc_id").alias("row")).distinct()
    return keyed.join(found, "row", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and places in sequences."""
    return packing.pack(docs, f"{VOCABULARIES}/word_bpe_49k.json", with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_quality),
    ("line_dedup", fresh_lines),
    ("near_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
# Learned scores and token ids are not SQL: each stage is tested against a plain version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
