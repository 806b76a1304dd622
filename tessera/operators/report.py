"""Reports on corpora and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_groups(df: DataFrame, key: str, value: str, top: int = 10) -> DataFrame:
    """The groups with most rows, and their mean value (AGG1, SRT1); equals by key. A null key is a group."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).orderBy(F.desc("n"), key).limit(top)


def number_summary(df: DataFrame, value: str) -> DataFrame:
    """Sum, mean, least, most and interpolated median (AGG3, AGG7); nulls are left out. Equal values are counted first, so the median needs
    only the distinct ones; without any value all are null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    total = F.sum(F.col("v") * F.col("c"))
    return counts.agg(total.alias("total"), (total / F.sum("c")).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.percentile("v", 0.5, F.col("c")).alias("median"))


def missing_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_missing, share) of columns with null or empty values (AGG4, AGG8), in one pass."""
    counted = df.agg(F.count("*").alias("_n"), *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_missing")) for c in columns])
    return counted.select("_n", F.inline(pairs)).where("n_missing > 0").select("column_name", "n_missing", (F.col("n_missing") / F.col("_n")).alias("share"))


def value_counts(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """(column_name, value, n): the most frequent values of each column (AGG5); equals by value."""
    parts = [df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top).select(F.lit(c).alias("column_name"), "value", "n") for c in columns]
    return reduce(DataFrame.unionByName, parts)


def positive_range(df: DataFrame, column: str) -> DataFrame:
    """Least and most of the positive values (AGG6, FLT8); nulls if there are none."""
    return df.where(F.col(column) > 0).agg(F.min(column).alias("first"), F.max(column).alias("last"))


def size_statistics(df: DataFrame, value: str, group: str) -> DataFrame:
    """Per group: count, mean, least, most and upper median, the value at n div 2 of the sorted values (AGG10).

    The median is found by counting: values are counted, then ranked among the distinct ones, so no group's rows are gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    order = Window.partitionBy(group).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(group)))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col(value)))
    return ranked.groupBy(group).agg(
        F.sum("c").alias("n"), (F.sum(F.col("c") * F.col(value)) / F.sum("c")).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), middle.alias("upper_median")
    )


def per_parent(chunks: DataFrame, parent: str, child: str, words: str) -> DataFrame:
    """Parents, distinct children, the mean number of children of a parent, and the mean and interpolated median of the children's words
    (AGG18). Of repeated children one counts; equal word counts are counted before the median."""
    one = chunks.groupBy(parent, child).agg(F.max(words).alias("words"))
    each = one.groupBy(parent).agg(F.count(child).alias("n")).agg(F.count("*").alias("parents"), F.sum("n").alias("children"), F.avg("n").alias("mean"))
    counts = one.where(F.col(child).isNotNull()).groupBy("words").agg(F.count("*").alias("c"))
    numbers = counts.agg((F.sum(F.col("words") * F.col("c")) / F.sum(F.when(F.col("words").isNotNull(), F.col("c")))).alias("mean_words"), F.percentile("words", 0.5, F.col("c")).alias("median_words"))
    return each.join(numbers)


def failed_share(rows: DataFrame, error: str) -> DataFrame:
    """(n, n_failed): all rows and those with an error (AGG17)."""
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col(error).isNotNull()).alias("n_failed"))
