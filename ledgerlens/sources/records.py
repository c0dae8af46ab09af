"""Records of delimited text files whose quoted fields may hold line breaks, read in splits.

A line break is part of a field where the number of quotes before it is odd. The quotes of each
split of a file are counted, the counts of the splits before are summed up, and so every split
knows whether it begins inside quotes; then every line does. Lines that belong together are put together
again, also across splits; all others are records as they stand. No file is read in one piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlens.session import Scratch, materialize

QUOTE = '"'


def quotes_in(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(QUOTE), F.lit("")))


def breaks_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether any line of the files ends inside quotes; one pass without a shuffle."""
    return not spark.read.text(path).where(quotes_in(F.col("value")) % 2 == 1).isEmpty()


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with file and split, numbered inside their split, and their quotes."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("place"), "value",
        quotes_in(F.col("value")).cast("long").alias("quotes"))


def whole_records(spark: SparkSession, path: str) -> DataFrame:
    """``record``, the text of every record but the first of each file, which is the header.

    Records keep the line breaks inside quotes; a carriage return at their end and blank records are left out.
    """
    with Scratch(spark) as scratch:
        lines = scratch.keep(_lines(spark, path), "lines")
        # One row for each split.
        earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        splits = lines.groupBy("file", "split").agg(F.sum("quotes").alias("quotes")).select(
            "file", "split", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before"))
        inside = Window.partitionBy("file", "split").orderBy("place")
        until = inside.rowsBetween(Window.unboundedPreceding, -1)
        quoted = (F.col("before") + F.coalesce(F.sum("quotes").over(until), F.lit(0))) % 2 == 1
        placed = lines.join(splits, ["file", "split"]).withColumn("goes_on", quoted)
        numbered = scratch.keep(placed.withColumn(
            "number", F.sum(F.when(F.col("goes_on"), 0).otherwise(1)).over(inside)), "numbered")
        ended = F.when(F.max("number") > 0, F.struct("split", F.max("number").alias("number")))
        owners = numbered.groupBy("file", "split").agg(ended.alias("ended")).select(
            F.col("file").alias("f"), F.col("split").alias("s"),
            F.last("ended", ignorenulls=True).over(
                Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)).alias("owner"))
        # A line that goes on at the head of a split belongs to the last record of a split before.
        heads = numbered.where("number = 0").join(
            owners, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s"))).select(
            "file", F.col("owner.split").alias("start"), F.col("owner.number").alias("number"), "split", "place", "value")
        single = ~F.col("goes_on") & (F.col("quotes") % 2 == 0)
        parts = numbered.where((F.col("number") > 0) & ~single).select(
            "file", F.col("split").alias("start"), "number", "split", "place", "value").unionByName(heads)
        ordered = F.array_sort(F.collect_list(F.struct("split", "place", "value")))
        joined = parts.groupBy("file", "start", "number").agg(
            F.array_join(F.transform(ordered, lambda line: line["value"]), "\n").alias("value"))
        alone = numbered.where(single).select("file", F.col("split").alias("start"), "number", "value")
        records = alone.unionByName(joined).where("not (start = 0 and number = 1)")
        record = F.regexp_replace("value", "\r$", "").alias("record")
        return materialize(records.select(record).where("record <> ''"), "records")
