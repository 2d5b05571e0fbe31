"""Page layout over an OCR-lines table: sections, tables, document texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landq import dims
from landq.functions.labels import first_holding
from landq.functions.script import detect_languages


def section(keywords: dict[str, list[str]] = dims.SECTION_KEYWORDS, heights=dims.SECTION_HEIGHTS, page_height: str | int = 1400) -> Column:
    """Section of a line: by keyword, else by the height of its middle on the page."""
    height = F.col(page_height) if isinstance(page_height, str) else F.lit(page_height)
    middle = (F.col("y1") + F.col("y2")) / 2.0 / F.greatest(height.cast("double"), F.lit(1.0))
    by_height = F.lit(heights[-1][1])
    for limit, name in reversed(heights[:-1]):
        by_height = F.when(middle < limit, name).otherwise(by_height)
    return first_holding(F.lower("text"), list(keywords.items()), by_height)


def segment_regions(lines: DataFrame, **options) -> DataFrame:
    """Line count and text of every section of a document."""
    return (lines.withColumn("section", section(**options)).groupBy("doc_id", "section").agg(
        F.count("*").alias("line_count"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("text")))


def detect_tables(lines: DataFrame, max_rows: int | None = None, row_height: int = 20) -> DataFrame:
    """Table rows of each document: lines on one height with at least 3 items, where there are at least 2 such rows.

    Gives the rows, or the first `max_rows` of them, with their cells from left to right, and the number of all rows.
    """
    y = (F.floor(F.col("y1") / row_height) * row_height).cast("int")
    cells = F.sort_array(F.collect_list(F.struct("x1", "line_no", "text")))
    rows = (lines.withColumn("y", y).groupBy("doc_id", "y").agg(cells.alias("items")).where(F.size("items") >= 3)
            .select("doc_id", "y", F.transform("items", lambda i: i["text"]).alias("cells")))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("row_count")).where("row_count >= 2")
    first = rows.withColumn("row_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("y")))
    first = first if max_rows is None else first.where(F.col("row_no") <= max_rows)
    return first.join(counts, "doc_id")


def ocr_rollup(lines: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Text, average confidence and language per document; documents without lines get 35 and a review flag."""
    percent = F.round(F.when(F.col("confidence") <= 1.0, F.col("confidence") * 100).otherwise(F.col("confidence")), 1)
    texts = lines.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), "\n").alias("text"),
        F.round(F.sum(percent.cast("decimal(18,4)")).cast("double") / F.count("*"), 1).alias("confidence"),
        F.count("*").alias("line_count"))
    if documents is not None:
        texts = documents.select("doc_id").join(texts, "doc_id", "left")
    read = F.col("line_count").isNotNull()
    language = detect_languages("text")
    return texts.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(35.0)).alias("confidence"),
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.when(read, language["summary"]).otherwise("Unknown").alias("language"), (~read).alias("requires_manual_review"))
