"""Boxes of recognised text: geometry, lines, reading order, values near labels, zones, unions.

Windows are per document, whose boxes one page bounds; labels meet the boxes within their reach on a grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Scores of a value in the label's row, below or above it, and the loss per pixel.
ROW, BELOW, LOSS = 12.0, 8.5, 0.02
LEAST_TOLERANCE, TOLERANCE_SHARE = 12.0, 0.75


def geometry(box: DataFrame) -> DataFrame:
    """Adds cx, cy, w, h to x1, y1, x2, y2; boxes without an extent go."""
    box = box.withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")}).filter("w > 0 and h > 0")
    return box.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})


def from_corners(box: DataFrame) -> DataFrame:
    """``bbox`` (a list of corner points) to x1, y1, x2, y2."""
    side = lambda pick, k: pick(F.transform("bbox", lambda p: p[k]))
    return box.withColumns({"x1": side(F.array_min, 0), "y1": side(F.array_min, 1), "x2": side(F.array_max, 0), "y2": side(F.array_max, 1)})


def cluster_lines(box: DataFrame) -> DataFrame:
    """``line_no`` from 0: a new line where the step down from the box before is above max(12, 0.75 of the median height)."""
    page = Window.partitionBy("doc_id")
    order = page.orderBy("cy", "x1", "idx")
    rows = geometry(box).withColumn("tolerance", F.greatest(F.lit(LEAST_TOLERANCE), TOLERANCE_SHARE * F.median("h").over(page)))
    step = F.col("cy") - F.lag("cy").over(order)
    return rows.withColumn("_new", F.coalesce((step > F.col("tolerance")).cast("int"), F.lit(0))).withColumn("line_no", F.sum("_new").over(order)).drop("_new")


def running_lines(box: DataFrame) -> DataFrame:
    """``line_no`` from 0: a box joins a line whose mean height so far it is near, by max(12, 0.75 of the median height), so that a slanted line
    ends where it has drifted off its own mean.

    Boxes come from the top down. A box that opens a line is below all means before it by more than the tolerance, and so are all boxes after
    it: only the newest line can grow. So the sorted boxes are walked once, with the sum and number of one line as the state, whatever the number of boxes.
    Boxes without an extent or a doc_id go; of equal places the least idx, null first, comes first.
    """
    page = Window.partitionBy("doc_id")
    rows = geometry(box).filter("doc_id is not null").withColumn("tolerance", F.greatest(F.lit(LEAST_TOLERANCE), TOLERANCE_SHARE * F.median("h").over(page)))
    placed = rows.select("doc_id", "cy", "tolerance", F.struct(*(F.col(c) for c in rows.columns)).alias("box"))
    schema = T.StructType([placed.schema["box"], T.StructField("line_no", T.LongType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, line, total, n = None, 0, 0.0, 0
        for batch in batches:
            found = []
            for doc_id, cy, tolerance in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "cy", "tolerance")), strict=True):
                if doc_id != now:
                    now, line, total, n = doc_id, 0, 0.0, 0
                elif cy - total / n > tolerance:
                    line, total, n = line + 1, 0.0, 0
                total, n = total + cy, n + 1
                found.append(line)
            yield pa.RecordBatch.from_arrays([batch.column("box"), pa.array(found, pa.int64())], ["box", "line_no"])

    ordered = placed.repartition("doc_id").sortWithinPartitions("doc_id", "cy", "box.x1", "box.idx")
    return ordered.mapInArrow(walk, schema).select("box.*", "line_no")


def reading_order(box: DataFrame, right_to_left: bool = False, lines=cluster_lines) -> DataFrame:
    """One row per line: doc_id, line_no, text, in the order of reading; ``lines`` numbers the lines."""
    lines = lines(box).groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("x1", "idx", "text"))).alias("_words"))
    words = F.transform("_words", lambda w: w["text"])
    return lines.select("doc_id", "line_no", F.array_join(F.reverse(words) if right_to_left else words, " ").alias("text"))


def label_contexts(line: DataFrame, label: str) -> DataFrame:
    """Lines with the label, and the lines before and after them."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = line.withColumns({"before": F.lag("text").over(order), "after": F.lead("text").over(order)})
    return rows.filter(F.col("text").rlike(label))


def near(labels: DataFrame, rows: DataFrame, reach: float) -> DataFrame:
    """Pairs of labels (doc_id, a) and boxes (doc_id, b) whose centres (cx, cy) are at most ``reach`` apart, with ``distance``.

    They meet on the cells of a grid as wide as the reach: a label stands in the nine cells around it, a box in one. So a page with any number
    of boxes is spread over many keys, and no box meets a label that it is far from.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    spread = labels.withColumn("_s", F.explode(steps)).withColumns({"_gx": cell("a.cx") + F.col("_s.i"), "_gy": cell("a.cy") + F.col("_s.j")}).drop("_s")
    placed = rows.withColumns({"_gx": cell("b.cx"), "_gy": cell("b.cy")})
    distance = F.sqrt(F.pow(F.col("b.cx") - F.col("a.cx"), 2) + F.pow(F.col("b.cy") - F.col("a.cy"), 2))
    return spread.join(placed, ["doc_id", "_gx", "_gy"]).drop("_gx", "_gy").withColumn("distance", distance).filter(F.col("distance") <= reach)


def label_values(box: DataFrame, label: str, reach: float = 400.0) -> DataFrame:
    """The best neighbour of the document's label boxes: right of it in the row, or below it; scores equal to 9 places go by box number, then text."""
    rows = geometry(box).withColumn("label", F.col("text").rlike(label))
    side = F.struct("idx", "text", "x1", "x2", "cx", "cy", "w", "h")
    pairs = near(rows.filter("label").select("doc_id", side.alias("a")), rows.filter("not label").select("doc_id", side.alias("b")), reach)
    same_row = F.abs(F.col("b.cy") - F.col("a.cy")) <= F.greatest("a.h", "b.h") * 0.6
    below = (F.col("b.cy") > F.col("a.cy")) & (F.abs(F.col("b.cx") - F.col("a.cx")) <= F.greatest("a.w", "b.w"))
    base = F.when(same_row & (F.col("b.x1") >= F.col("a.x1")), ROW).when(below, BELOW)
    scored = pairs.withColumn("score", F.round(base - LOSS * F.col("distance"), 9)).filter("score is not null")
    scored = scored.select("doc_id", "score", F.col("b.text").alias("text"), F.col("b.idx").alias("idx"), F.col("a.idx").alias("l_idx"))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("text", "score", "idx", "l_idx"), F.struct("score", -F.col("idx"), -F.col("l_idx"), "text")).alias("b"))
    return best.select("doc_id", F.col("b.text").alias("value"), F.round("b.score", 4).alias("score"))


def id_from_boxes(box: DataFrame, digits: int = 8) -> DataFrame:
    """The surest run of that many digits; equal ones go by box number, then the larger number."""
    number = F.regexp_extract(F.regexp_replace("text", r"\s", ""), rf"(?<!\d)(\d{{{digits}}})(?!\d)", 1)
    rows = box.withColumn("number", number).filter("number <> ''")
    return rows.groupBy("doc_id").agg(F.max_by("number", F.struct("confidence", -F.col("idx"), "number")).alias("number"))


def boxes_in_zone(box: DataFrame, zones: dict[str, tuple[float, float, float, float]], width: float, height: float) -> DataFrame:
    """The first zone (shares of the page) that holds the box's centre; boxes outside all zones go."""
    rows = geometry(box)
    x, y, zone = F.col("cx") / width, F.col("cy") / height, F.lit(None).cast("string")
    for name, (a, b, c, d) in reversed(zones.items()):
        zone = F.when(x.between(a, c) & y.between(b, d), name).otherwise(zone)
    return rows.withColumn("zone", zone).filter("zone is not null")


def zone_text(box: DataFrame) -> DataFrame:
    """The texts of each zone in order of rows and columns."""
    rows = box.groupBy("doc_id", "zone").agg(F.array_sort(F.collect_list(F.struct("cy", "x1", "idx", "text"))).alias("w"))
    return rows.select("doc_id", "zone", F.array_join(F.transform("w", lambda s: s["text"]), " ").alias("text"))


def padded(a: Column, b: Column, pad: float, most: Column) -> tuple[Column, Column]:
    extra = (b - a) * pad
    return F.greatest(a - extra, F.lit(0.0)), F.least(b + extra, most)


def document_box(box: DataFrame, pad: float, width: float, height: float) -> DataFrame:
    """The union of a document's boxes, widened by ``pad`` on each side, within the page."""
    whole = box.groupBy("doc_id").agg(F.min("x1").alias("a"), F.min("y1").alias("b"), F.max("x2").alias("c"), F.max("y2").alias("d"))
    (x1, x2), (y1, y2) = padded(F.col("a"), F.col("c"), pad, F.lit(float(width))), padded(F.col("b"), F.col("d"), pad, F.lit(float(height)))
    return whole.select("doc_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def yolo_lines(box: DataFrame, width: float, height: float) -> DataFrame:
    """``0 cx cy w h`` in shares of the page, six places."""
    share = [(F.col("x1") + F.col("x2")) / 2 / width, (F.col("y1") + F.col("y2")) / 2 / height, (F.col("x2") - F.col("x1")) / width, (F.col("y2") - F.col("y1")) / height]
    return box.select("doc_id", F.format_string("0 %.6f %.6f %.6f %.6f", *[F.round(F.round(s, 9), 6) for s in share]).alias("line"))
