"""Three-column CSV files in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("col1", "col2", "col3")


def load_csv(spark: SparkSession, path: str, has_header: bool = True, encoding: str = "UTF-8", delimiter: str = ",", line_breaks: bool = True) -> DataFrame:
    """``row_id, col1, col2, col3``: the first three fields of every record, trimmed; missing ones are empty.

    The header is skipped by position, not by name.  Quoted fields may hold
    delimiters, doubled quotes and, with ``line_breaks``, line breaks; without,
    a large file is read by many tasks, otherwise by one.  Empty lines are dropped;
    bytes that the encoding cannot read become U+FFFD and are then dropped.
    ``row_id`` orders records within a file and files by partition; it is unique
    but not dense.  An empty file gives no rows.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS])
    raw = (
        spark.read.schema(schema).option("header", has_header).option("enforceSchema", True).option("sep", delimiter).option("encoding", encoding)
        .option("quote", '"').option("escape", '"').option("multiLine", line_breaks).option("mode", "PERMISSIVE").option("maxCharsPerColumn", -1).csv(path)
    )
    clean = [F.coalesce(F.regexp_replace(F.regexp_replace(c, "�", ""), r"(?U)^\s+|\s+$", ""), F.lit("")).alias(c) for c in COLUMNS]
    return raw.select(F.monotonically_increasing_id().alias("row_id"), *clean)


def save_clustered(rows: DataFrame, labels: DataFrame, path: str, id_col: str = "row_id", files: int | None = None) -> None:
    """Writes ``col1, col2, col3, cluster_id`` with a header; rows without a label are left out.

    Written by all tasks; ``files`` limits the number of files (1 for a single
    file of a small result).
    """
    out = rows.join(labels.select(id_col, "cluster_id"), id_col).select(*COLUMNS, "cluster_id")
    out = out.coalesce(files) if files else out
    out.write.mode("overwrite").option("header", True).option("emptyValue", "").option("quote", '"').option("escape", '"').csv(path)


def load_lines(spark: SparkSession, texts: str, labels: str | None = None) -> DataFrame:
    """``doc_id, text[, label]`` from files with one document a line, joined by line number.

    The number comes from the offsets of the partitions of each file in turn, so
    it needs one file each for texts and labels, with equally many lines.
    """

    def numbered(path: str, name: str) -> DataFrame:
        rows = spark.read.text(path).withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
        size = rows.groupBy("_p").agg(F.count("*").alias("_n"))
        offset = size.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_o"))
        local = F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33)
        return rows.join(F.broadcast(offset), "_p").select((F.col("_o") + local).alias("doc_id"), F.col("value").alias(name))

    t = numbered(texts, "text")
    return t if labels is None else t.join(numbered(labels, "label"), "doc_id")


def joined_text(*columns: str) -> Column:
    """The columns as one text, separated by spaces; null reads as empty."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
