"""Records of large CSV files whose values may hold line breaks, cut by many tasks.

Lines are read in splits. The quotes of a split, and those of all splits before it in its file, tell
whether it begins inside a quoted value, so every line knows whether it begins a record; the lines of
a record are put together wherever they were read. Every line is then held against the grammar
of its place: what the count of quotes alone could mistake is found, and left to Spark's own reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepkit.operators.aggregates import settle
from prepkit.sources.scratch import materialize

_INNER = r'(?:[^"]++|"")*+'
_FIELD = rf'(?:[^",]*+|"{_INNER}")'
_REST = rf'(?:{_FIELD},)*+(?:{_FIELD}|"{_INNER})'
# a line that begins outside of quotes, and one that begins inside of a quoted value
_OUTSIDE, _INSIDE = rf"\A{_REST}\z", rf'\A{_INNER}(?:"(?:,{_REST})?)?\z'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, block, nth, value, odd)``: lines in the order of ``nth`` within a split, and whether quotes are odd."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),
        "value",
        (quotes % 2).alias("odd"),
    )


def _of_blocks(lines: DataFrame) -> DataFrame:
    """``(file, block, inside, mode)`` per split: whether it begins inside quotes, and the file's line ends.

    The mode follows from the first line: 1 if it ends with a carriage return, else 0; null if it has
    another one, which only Spark's reader deals with.
    """
    first = F.min_by(F.when(F.col("block") == 0, F.col("value")), "nth")
    blocks = lines.groupBy("file", "block").agg(F.sum("odd").alias("odd"), first.alias("first"))
    order = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first("first").over(order)
    plain = F.locate("\r", first).isin(0) | (F.locate("\r", first) == F.length(first))
    mode = F.when(plain, F.endswith(first, F.lit("\r")).cast("int"))
    return blocks.select("file", "block", (before % 2).alias("inside"), mode.alias("mode"))


def _placed(lines: DataFrame) -> DataFrame:
    """Lines with ``starts`` (they begin a record), ``rec`` (the ``nth`` of the last that does in the split) and ``sound``."""
    blocks, small = settle(_of_blocks(lines))
    found = lines.join(F.broadcast(blocks) if small else blocks, ["file", "block"])
    value = F.when(F.col("mode") == 1, F.regexp_replace("value", r"\r\z", "")).otherwise(F.col("value"))
    order = Window.partitionBy("file", "block").orderBy("nth")
    before = F.coalesce(F.sum("odd").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = found.select("file", "block", "nth", "odd", "mode", value.alias("value"), ((F.col("inside") + before) % 2 == 0).alias("starts"))
    sound = F.when(F.col("starts"), F.col("value").rlike(_OUTSIDE)).otherwise(F.col("value").rlike(_INSIDE))
    return found.select(
        "*",
        F.max(F.when(F.col("starts"), F.col("nth"))).over(order).alias("rec"),
        (sound & F.col("mode").isNotNull()).alias("sound"),
    )


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """``(record)``: the text of every record but the files' headers; None where lines do not tell them apart.

    Line ends are as Spark's reader has them: in a file whose first line ends with CRLF, a CRLF within
    a value becomes a line feed. Empty lines are no records.
    """
    lines = materialize(_placed(_lines(spark, path)), "csv_lines")
    whole = lines.groupBy("file").agg(F.sum("odd").alias("odd"), F.bool_and("sound").alias("sound"))
    if whole.where(~F.col("sound") | (F.col("odd") % 2 == 1)).take(1):
        return None
    order = Window.partitionBy("file").orderBy("block")
    last = F.max(F.when(F.col("rec").isNotNull(), F.struct(F.col("block").alias("rec_block"), "rec")))
    blocks = lines.groupBy("file", "block").agg(last.alias("last"))
    carried = F.last("last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select(F.col("file").alias("f"), F.col("block").alias("b"), carried.alias("from"))
    blocks, small = settle(blocks.select("f", "b", "from.rec_block", F.col("from.rec").alias("from_rec")))
    blocks = F.broadcast(blocks) if small else blocks
    here = F.struct(F.col("block"), F.col("rec").alias("nth"))
    plain = lines.where(F.col("starts") & (F.col("odd") == 0)).select("file", here.alias("at"), F.col("value").alias("record"))
    parts = lines.where(~F.col("starts") | (F.col("odd") == 1))
    parts = parts.join(blocks, (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")))
    carried = F.struct(F.col("rec_block").alias("block"), F.col("from_rec").alias("nth"))
    place = F.when(F.col("rec").isNotNull(), here).otherwise(carried)
    piece = F.struct("block", "nth", "value")
    joined = parts.groupBy("file", place.alias("at")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    joined = joined.select("file", "at", F.array_join("pieces.value", "\n").alias("record"))
    found = plain.unionByName(joined)
    header = lines.where(F.col("starts") & ((F.col("value") != "") | (F.col("odd") == 1)))
    header = header.groupBy(F.col("file").alias("f")).agg(F.min(here).alias("at")).select("f", F.col("at.block").alias("b"), F.col("at.nth").alias("n"))
    header, small = settle(header)
    header = F.broadcast(header) if small else header
    same: Column = (F.col("file") == F.col("f")) & (F.col("at.block") == F.col("b")) & (F.col("at.nth") == F.col("n"))
    # as a value, so that no filter on what is parsed from a record is evaluated for what is none
    record = F.when(F.col("f").isNull() & (F.col("record") != ""), F.col("record"))
    return found.join(header, same, "left").select(record.alias("record")).where("record IS NOT NULL")
