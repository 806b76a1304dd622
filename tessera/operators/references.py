"""References whose target does not exist, is gone, or comes later."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")


def merged_validity(parents: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Per key, the spans during which at least one parent row is valid, as ``span_start`` and ``span_end`` (null: open).

    A row is valid from ``start`` until before ``end``. Rows without a start and rows that end before they start are never valid.
    Copies are removed before the rows are sorted, so a key with many copies stays small.
    """
    rows = parents.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    rows = rows.where(F.col("_s").isNotNull() & (F.col("_e").isNull() | (F.col("_e") > F.col("_s")))).distinct()
    before = Window.partitionBy(*keys).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.max(F.when(F.col("_e").isNull(), 1).otherwise(0)).over(before)
    end_before = F.max("_e").over(before)
    rows = rows.withColumn("_new", F.when(open_before == 1, 0).when(end_before >= F.col("_s"), 0).otherwise(1))
    upto = Window.partitionBy(*keys).orderBy("_s", "_e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_span", F.sum("_new").over(upto))
    spans = rows.groupBy(*keys, "_span").agg(
        F.min("_s").alias("span_start"),
        F.when(F.max(F.col("_e").isNull().cast("int")) == 1, F.lit(None)).otherwise(F.max("_e")).alias("span_end"),
    )
    return spans.drop("_span")


def orphan_references(
    references: DataFrame,
    parents: DataFrame,
    keys: list[tuple[str, str]],
    time: str,
    valid_from: str,
    valid_until: str,
    match: str = "simple",
) -> DataFrame:
    """The rows of ``references`` that no row of ``parents`` answers at their time, with a column ``reason``.

    ``keys`` pairs each referring column with its parent column. References are grouped by their null mask, and each mask is
    anti-joined on its non-null columns alone. ``match`` says what a null in the key means:

    * ``simple``: a reference with any null is not checked and never comes out;
    * ``partial``: the non-null columns must agree with some parent; a reference of nulls only is not checked;
    * ``full``: a reference of nulls only is not checked; one with some nulls comes out as ``incomplete``.

    ``reason`` is ``missing`` if no parent row agrees, else ``late`` if none starts at or before the time, else ``deleted``.
    A null time agrees with no span: ``late`` if there is a parent. Parents with a null start count as rows that never start.
    Empty tables, repeated rows (each comes out) and other columns of any name are allowed; names starting with ``_`` are not.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    refs = references.select(F.struct(*references.columns).alias("_row"), F.col(time).alias("_t"), *[F.col(c).alias(f"_k{i}") for i, (c, _) in enumerate(keys)])
    known = parents.select(*[F.col(p).alias(f"_k{i}") for i, (_, p) in enumerate(keys)], F.col(valid_from).alias("_from"), F.col(valid_until).alias("_until"))
    parts = []
    for mask in product((True, False), repeat=len(keys)):
        present = [f"_k{i}" for i, there in enumerate(mask) if there]
        if not present or match == "simple" and len(present) < len(keys):
            continue
        of_mask = refs.where(_mask(mask))
        if match == "full" and len(present) < len(keys):
            parts.append(of_mask.select("_row", F.lit("incomplete").alias("reason")))
        else:
            parts.append(_unanswered(of_mask, known.where(_all_there(present)), present))
    return reduce(DataFrame.unionByName, parts).select("_row.*", "reason")


def _mask(mask: tuple[bool, ...]) -> Column:
    return reduce(Column.__and__, [F.col(f"_k{i}").isNotNull() if there else F.col(f"_k{i}").isNull() for i, there in enumerate(mask)])


def _all_there(columns: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in columns])


def _unanswered(refs: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """References of one mask without a valid parent. A parent may be in many rows, a hot reference in many: the parents are reduced
    to merged spans first, so an anti-join reads few rows per key and its skewed side is split by AQE."""
    spans = merged_validity(known, on, "_from", "_until").select(*[F.col(c).alias(f"p{c}") for c in on], "span_start", "span_end")
    valid = reduce(Column.__and__, [F.col(c) == F.col(f"p{c}") for c in on])
    valid = valid & (F.col("span_start") <= F.col("_t")) & (F.col("span_end").isNull() | (F.col("_t") < F.col("span_end")))
    failed = refs.join(spans, valid, "left_anti")
    first = known.groupBy(*on).agg(F.min("_from").alias("_first"), F.lit(True).alias("_any"))
    reason = F.when(F.col("_any").isNull(), "missing").when(F.coalesce(F.col("_first") <= F.col("_t"), F.lit(False)), "deleted").otherwise("late")
    return failed.join(first, on, "left").select("_row", reason.alias("reason"))


def orphan_counts(orphans: DataFrame, table: str, time: str, field: str) -> DataFrame:
    """Orphans per table, field, month of the time ('YYYY-MM', null for a null time) and reason."""
    return (
        orphans.groupBy(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.date_format(time, "yyyy-MM").alias("period"), "reason")
        .agg(F.count("*").alias("n"))
    )
