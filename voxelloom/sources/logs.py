"""Delimited logs whose header may change from line to line, read in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'  # a comma outside quotes


def read_drifting_logs(spark: SparkSession, folder: str, glob: str = "boxes_log*.csv", first_field: str = "capture") -> DataFrame:
    """(file, split, line, row map<string, string>) of every line but headers, each under the last header before it.

    A header is a line whose first field is ``first_field``: logs that are appended to repeat theirs, and a new version of
    the writer adds columns in the middle of a file. Files are read in splits of Spark's own making. A line is placed by
    its split's first byte and its number there; the header in force where a split begins comes from one row for each
    split of the file, so neither a file nor its lines meet in one task. Lines before any header have a NULL row. Empty
    cells are NULL; quotes around a cell go, doubled ones inside become one. Cells beyond the header are left out, missing
    ones are NULL. Quoted line feeds are not supported, as everywhere where a text is split.
    """
    m = F.col("_metadata")
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder)
    lines = text.select(m["file_path"].alias("file"), m["file_block_start"].alias("split"), F.monotonically_increasing_id().alias("line"), "value").filter("value <> ''")
    strip = lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')
    fields = F.transform(F.split("value", COMMA, -1), strip)
    cut = lines.withColumn("cells", fields).withColumn("names", F.when(F.get("cells", F.lit(0)) == first_field, F.col("cells"))).drop("value")
    ends = cut.groupBy("file", "split").agg(F.max_by("names", F.when(F.col("names").isNotNull(), F.col("line"))).alias("_end"))  # one row a split
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    start = ends.select("file", "split", before.alias("_start"))
    inside = F.last("names", ignorenulls=True).over(Window.partitionBy("file", "split").orderBy("line"))
    placed = cut.withColumn("_own", inside).filter(F.col("names").isNull()).join(start, ["file", "split"])
    head = F.coalesce("_own", "_start")
    cells = F.transform(head, lambda _, i: F.nullif(F.get("cells", i), F.lit("")))
    return placed.select("file", "split", "line", F.when(head.isNotNull(), F.map_from_arrays(head, cells)).alias("row"))
