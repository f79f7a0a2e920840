"""Pages cut into boxes: reading order, sections, pictures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Labels of boxes.
HEADERS, TEXTS, PICTURES = ["SectionHeader"], ["Text", "Title", "Caption"], ["Picture", "Figure", "Table"]


def reading_order(boxes: DataFrame, page: list[str], width: str = "width") -> DataFrame:
    """Adds place (from 1) to boxes(page, box_ord, x0, y0, x1, y1): the left column from the top, then the right; equals by box_ord.

    A box whose middle is at half the width or beyond stands in the right column.
    """
    right = (F.col("x0") + F.col("x1")) / 2 >= F.col(width) / 2
    return boxes.withColumn("place", F.row_number().over(Window.partitionBy(*page).orderBy(right, "y0", "box_ord")))


def sections(boxes: DataFrame, page: list[str]) -> DataFrame:
    """page, section_at, section, content (array of text and images): the sections of each page in reading order.

    boxes(page, place, label, text): text is what was read, or a picture's path. A section begins with its header; texts before
    the first header make a section '' at place 0. Pictures go to the last text of their section, those before any text of it are
    left out. A header without texts has no content. Pages stand by themselves.
    """
    before = Window.partitionBy(*page).orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda labels, c: F.last(F.when(F.col("label").isin(labels), F.col(c)), ignorenulls=True).over(before)
    own = boxes.where(F.col("label").isin(HEADERS + TEXTS + PICTURES))
    own = own.withColumn("section_at", F.coalesce(last(HEADERS, "place"), F.lit(0))).withColumn("section", F.coalesce(last(HEADERS, "text"), F.lit("")))
    own = own.withColumn("_at", F.when(last(TEXTS, "place") > F.col("section_at"), last(TEXTS, "place")))
    key = [*page, "section_at", "section"]
    images = F.array_sort(F.collect_list(F.when(F.col("label").isin(PICTURES), F.struct("place", "text"))))
    items = own.groupBy(*key, "_at").agg(F.max(F.when(F.col("label").isin(TEXTS), F.col("text"))).alias("text"), F.transform(images, lambda x: x["text"]).alias("images"))
    content = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "text", "images"))))
    out = items.groupBy(*key).agg(F.transform(content, lambda x: x.dropFields("_at")).alias("content"))
    return out.where("section_at > 0 or size(content) > 0")
