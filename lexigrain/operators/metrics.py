"""Evaluation of predictions, and stratified splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, actual: str = "label", predicted: str = "prediction") -> DataFrame:
    """``actual, predicted, n``; rows where either is null are left out."""
    ok = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return ok.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def report(df: DataFrame, actual: str = "label", predicted: str = "prediction", digits: int = 6) -> DataFrame:
    """``label, precision, recall, f1, support`` of every label that occurs on either side; a ratio over nothing is 0."""
    c = confusion(df, actual, predicted)
    sides = c.select(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).alias("claimed"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"))
    sides = sides.unionByName(c.select(F.col("predicted").alias("label"), F.lit(0).alias("support"), F.col("n").alias("claimed"), F.lit(0).alias("tp")))
    s = sides.groupBy("label").agg(*[F.sum(x).alias(x) for x in ("support", "claimed", "tp")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    s = s.withColumn("p", ratio(F.col("tp"), F.col("claimed"))).withColumn("r", ratio(F.col("tp"), F.col("support")))
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    return s.select("label", F.round("p", digits).alias("precision"), F.round("r", digits).alias("recall"), F.round(f1, digits).alias("f1"), F.col("support").cast("bigint").alias("support"))


def summary(df: DataFrame, actual: str = "label", predicted: str = "prediction", digits: int = 6) -> DataFrame:
    """``accuracy, macro_f1, n``: one row; accuracy and F1 of no rows are 0.  The macro mean is over all labels of either side."""
    c = confusion(df, actual, predicted).agg(F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("right"), F.sum("n").alias("n"))
    m = report(df, actual, predicted, 12).agg(F.avg("f1").alias("m"))
    accuracy = F.when(F.col("n") > 0, F.col("right") / F.col("n")).otherwise(F.lit(0.0))
    return c.join(F.broadcast(m)).select(F.round(accuracy, digits).alias("accuracy"), F.round(F.coalesce("m", F.lit(0.0)), digits).alias("macro_f1"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "doc_id", test_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """The rows with a column ``split``: of each label the first max(1, floor(n * ratio)) in a hashed order are ``test``, the others ``train``.

    A label of one row goes to the test side.  Null labels are one class.  The
    order is the MD5 of seed and id, which SQL engines share.  Rows are ranked
    within a label and the first two hash digits, offset by the counts of the
    digits before, so no task sorts a whole label.
    """
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    keyed = df.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 2))
    counts = keyed.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    by = Window.partitionBy(label)
    before = counts.select(F.col(label).alias("_l"), F.col("_b").alias("_bb"), (F.sum("_n").over(by.orderBy("_b")) - F.col("_n")).alias("_before"), F.sum("_n").over(by).alias("_all"))
    place = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", id_col))
    joined = keyed.withColumn("_p", place).join(before, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_bb")))
    test = F.greatest(F.lit(1), F.floor(F.col("_all") * F.lit(test_ratio)))
    return joined.withColumn("split", F.when(F.col("_before") + F.col("_p") <= test, "test").otherwise("train")).drop("_h", "_b", "_l", "_bb", "_before", "_all", "_p")
