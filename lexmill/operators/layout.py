"""Page layout from boxes: lines of text, columns, reading order, figure captions and their images.

Boxes are rows (doc_id, page, item, x0, y0, x1, y1, text); a page is a group of bounded size, and every operator is
windows and joins over pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How a caption begins, and how far above and below its lower edge an image may begin.
CAPTIONS = [r"(?i)^图\s*(\d+[a-zA-Z]?)", r"(?i)^Figure\s+(\d+[a-zA-Z]?)", r"(?i)^Fig\.?\s+(\d+[a-zA-Z]?)"]
ABOVE, BELOW = 10, 400
PAGE = ["doc_id", "page"]


def lines(glyphs: DataFrame, step: float = 5.0, gap: float = 0.3) -> DataFrame:
    """(doc_id, page, text): pieces from top to bottom and left to right.

    A line ends where the next piece lies more than ``step`` lower or higher; a space stands where it begins further to
    the right than ``gap`` of its own width (3 if it has none).
    """
    w = Window.partitionBy(*PAGE).orderBy(F.bround(F.col("y0") / step) * step, "x0", "item")
    some = glyphs.where(F.coalesce("text", F.lit("")) != "")
    before, end = F.lag("y0").over(w), F.lag("x1").over(w)
    breaks = F.abs(F.col("y0") - before) > step
    wide = F.when(F.col("x1") > F.col("x0"), (F.col("x1") - F.col("x0")) * gap).otherwise(3.0)
    lead = F.when(before.isNull(), "").when(breaks, "\n").when(F.col("x0") - end > wide, " ").otherwise("")
    rows = some.select(*PAGE, F.row_number().over(w).alias("n"), F.concat(lead, "text").alias("t"))
    made = rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("p"))
    return made.select(*PAGE, F.regexp_replace(F.array_join("p.t", ""), r"^\s+|\s+$", "").alias("text"))


def thresholds(blocks: DataFrame) -> DataFrame:
    """(doc_id, page, line_height, char_width, column_gap, line_tolerance) from the medians of the blocks' heights and widths."""
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    m = blocks.groupBy(*PAGE).agg(F.coalesce(F.median(F.when(h > 0, h)), F.lit(12.0)).alias("h"), F.coalesce(F.median(F.when(w > 0, w)), F.lit(100.0)).alias("w"))
    return m.select(*PAGE, F.col("h").alias("line_height"), (F.col("w") / 10).alias("char_width"), (F.col("w") * 0.3).alias("column_gap"), (F.col("h") * 0.5).alias("line_tolerance"))


def columns(blocks: DataFrame, widths: DataFrame) -> DataFrame:
    """(doc_id, page, left_end, right_start) of pages of two columns; ``widths`` has doc_id, page, width.

    All edges of a page in order: the first gap of more than a tenth of the width whose middle lies within 15 % of the
    page's middle parts the columns, which reach a tenth into it.
    """
    edges = blocks.select(*PAGE, F.explode(F.array("x0", "x1")).alias("x")).join(widths, PAGE)
    w = Window.partitionBy(*PAGE).orderBy("x")
    rows = edges.withColumn("before", F.lag("x").over(w)).withColumn("gap", F.col("x") - F.col("before"))
    fits = (F.col("gap") > F.col("width") * 0.1) & (F.abs((F.col("before") + F.col("x")) / 2 - F.col("width") / 2) < F.col("width") * 0.15)
    found = rows.where(fits).groupBy(*PAGE).agg(F.min(F.struct("before", "x", "gap")).alias("g"))
    return found.select(*PAGE, (F.col("g.before") + F.col("g.gap") * 0.1).alias("left_end"), (F.col("g.x") - F.col("g.gap") * 0.1).alias("right_start"))


def in_reading_order(blocks: DataFrame, widths: DataFrame) -> DataFrame:
    """Blocks with ``place``: the left column before the right one, lines by half a median height, then from left to right."""
    rows = blocks.join(columns(blocks, widths), PAGE, "left").join(thresholds(blocks).select(*PAGE, "line_tolerance"), PAGE)
    middle = (F.col("x0") + F.col("x1")) / 2
    column = F.when(F.col("left_end").isNull() | (middle <= F.col("left_end")) | (middle < F.col("right_start")), 0).otherwise(1)
    line = F.bround(F.col("y0") / F.col("line_tolerance")) * F.col("line_tolerance")
    order = Window.partitionBy(*PAGE).orderBy(column, line, "x0", "item")
    return rows.withColumn("place", F.row_number().over(order)).drop("left_end", "right_start", "line_tolerance")


def captions(lines_: DataFrame) -> DataFrame:
    """(doc_id, page, number, label, y1) of lines (doc_id, page, text, y1) that begin like a figure's caption; labels are cut at 50 characters."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    number = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in CAPTIONS])
    return lines_.select(*PAGE, number.alias("number"), F.substring(text, 1, 50).alias("label"), "y1").where("number is not null")


def figures(captions_: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, number, figure_id, label, image_ids): captions with the images (doc_id, page, image_id, y0) of their page that begin near below."""
    near = (F.col("y0") > F.col("y1") - ABOVE) & (F.col("y0") < F.col("y1") + BELOW)
    caption = captions_.withColumn("c", F.struct("number", "label", "y1"))
    rows = caption.join(images.select(*PAGE, "image_id", "y0"), PAGE, "left")
    ids = F.array_sort(F.collect_list(F.when(near, F.struct("y0", "image_id"))))
    made = rows.groupBy(*PAGE, "c").agg(ids.alias("i"))
    return made.select(*PAGE, "c.number", F.concat(F.lit("fig-"), "c.number").alias("figure_id"), "c.label", F.col("i.image_id").alias("image_ids"))


def overview_figures(figures_: DataFrame, images: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, place, figure_id, page, image_ids): a document's first figures by page and number that have images; without any, its first images."""
    by_number = Window.partitionBy("doc_id").orderBy("page", "number")
    first = figures_.withColumn("place", F.row_number().over(by_number)).where((F.col("place") <= n) & (F.size("image_ids") > 0)).select("doc_id", "place", "figure_id", "page", "image_ids")
    by_image = Window.partitionBy("doc_id").orderBy("page", "image_id")
    alone = images.withColumn("place", F.row_number().over(by_image)).where(F.col("place") <= n).join(first.select("doc_id").distinct(), "doc_id", "left_anti")
    return first.unionByName(alone.select("doc_id", "place", F.col("image_id").alias("figure_id"), "page", F.array("image_id").alias("image_ids")))
