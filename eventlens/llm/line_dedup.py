"""Repeated lines across documents, as compressed bitmaps per document. Spark functions only.

Lines are reduced to 128-bit hashes of their keys, range-partitioned and sorted by (hash, split,
document, position) and read as a stream, in which the first row of a document and the first
occurrence of a key are seen from the row before. A key that stands in very many documents is
spread over ``SPLITS`` runs by document, and the runs' small summaries are put together
afterwards, so no key is one task. Only hashes, positions and bitmaps are shuffled; the text meets
the bitmaps in one last join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import ascii_lower
from eventlens.session import materialize

SPLITS = 1024
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    """Lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per non-empty line: document (id, fingerprint of the text), position, key hash."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(
        F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text).alias("__fp"), lines_of(text).alias("__lines")
    )
    # a repeated row is the same document: it must count once
    exploded = slim.select("__id", "__fp", F.posexplode(F.transform("__lines", line_key)).alias("__pos", "__key"))
    return exploded.where(F.col("__key") != "").select(
        "__id", "__fp", "__pos",
        F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(7), "__key").alias("__h2"),
        F.pmod(F.xxhash64("__id", "__fp"), F.lit(SPLITS)).cast("int").alias("__split"),
    )


def drop_bitmaps(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, keep_first: bool = True
) -> DataFrame:
    """Bitmaps of the lines to drop: ``__id, __fp, words`` with ``words`` an array of
    (word, bits), 64 lines to a word, words without a dropped line left out.

    A key found in at least ``min_docs`` documents loses its lines: all of them, or all but the
    first occurrence (smallest id, then position) with ``keep_first``.
    """
    key = ["__h1", "__h2"]
    rows = materialize(line_rows(docs, id_col, text_col), "line-hashes")
    run = Window.partitionBy(*key, "__split").orderBy("__id", "__fp", "__pos")
    doc = F.struct("__id", "__fp")
    streamed = (
        rows.repartitionByRange(*key, "__split").sortWithinPartitions(*key, "__split", "__id", "__fp", "__pos")
        .withColumn("__before", F.lag(doc).over(run))
    )
    new_doc = ~F.col("__before").eqNullSafe(doc)
    spread = F.struct("__id", "__fp", "__pos")
    runs = (
        streamed.where(new_doc).groupBy(*key, "__split")
        .agg(F.count(F.lit(1)).alias("__docs"), F.min(spread).alias("__first"))
    )
    whole = Window.partitionBy(*key)
    found = runs.select(
        *key, "__split", F.sum("__docs").over(whole).alias("__n"), F.min("__first").over(whole).alias("__first")
    ).where(F.col("__n") >= min_docs)
    hit = rows.join(found, [*key, "__split"])
    if keep_first:
        hit = hit.where(~F.col("__first").eqNullSafe(spread))
    bit = F.expr("shiftleft(1L, cast(__pos % 64 as int))")
    return (
        hit.groupBy("__id", "__fp", F.expr("cast(__pos div 64 as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
        .groupBy("__id", "__fp").agg(F.collect_list(F.struct("word", "bits")).alias("words"))
    )


def without_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 2, keep_first: bool = True
) -> DataFrame:
    """Every document with ``kept_text``, ``n_lines`` and ``n_dropped``.

    The input's columns are kept; those with the three new names are replaced. A null or empty text
    is one empty line and keeps an empty text. Repeated rows are one document and each get its
    result; equal ids with different texts are different documents. A null id is an id like any other.
    """
    taken = [c for c in docs.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    text = F.col(f"`{text_col}`").cast("string")
    bitmaps = drop_bitmaps(docs, id_col=id_col, text_col=text_col, min_docs=min_docs, keep_first=keep_first)
    bitmaps = bitmaps.select(F.col("__id").alias("__bid"), F.col("__fp").alias("__bfp"), F.col("words").alias("__words"))
    base = docs.select(*[F.col(f"`{c}`") for c in taken], F.xxhash64(text).alias("__fp"))
    joined = base.join(
        bitmaps, F.col(f"`{id_col}`").eqNullSafe(F.col("__bid")) & (F.col("__fp") == F.col("__bfp")), "left"
    )
    n_words = F.expr("cast((size(__lines) - 1) div 64 as int)")
    dense = F.transform(
        F.sequence(F.lit(0), n_words), lambda w: F.coalesce(F.try_element_at(F.map_from_entries("__words"), w), F.lit(0).cast("bigint"))
    )
    kept = F.filter(
        "__lines",
        lambda line, i: F.col("__dense").isNull()
        | (F.getbit(F.get("__dense", F.floor(i / 64).cast("int")), i % 64) == 0),
    )
    return (
        joined.withColumn("__lines", lines_of(text))
        .withColumn("__dense", F.when(F.col("__words").isNotNull(), dense))
        .withColumn("__kept", F.when(F.col("__words").isNull(), F.col("__lines")).otherwise(kept))
        .select(
            *[F.col(f"`{c}`") for c in taken],
            F.array_join("__kept", "\n").alias("kept_text"),
            F.size("__lines").cast("bigint").alias("n_lines"),
            (F.size("__lines") - F.size("__kept")).cast("bigint").alias("n_dropped"),
        )
    )
