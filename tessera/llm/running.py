"""Running totals over groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import cut_lineage


def running_totals(df: DataFrame, group: list[str], order: str, value: str, into: str = "before") -> DataFrame:
    """Adds ``into``: the sum of ``value`` over the rows of the same group that come before in ``order``.

    Rows are sorted into range partitions of (group, order), so a group may span any number of tasks; each partition counts on from
    the totals of those before it. ``order`` must be unique within a group for one defined result; nulls in ``value`` count as 0 and
    groups must not be null. The rows are written to the shared folder once, since both sides must see the same partitions.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_upto", T.LongType())])
    columns, keys = df.columns, list(group)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            rows = pd.DataFrame({**{c: batch[c] for c in columns}})
            sums = rows[value].fillna(0).astype("int64").groupby([rows[k] for k in keys], sort=False).cumsum()
            same = pd.Series([k == last for k in zip(*[rows[k] for k in keys])], index=rows.index)
            sums = sums + same.astype("int64") * carried
            yield rows.assign(_part=part, _upto=sums)
            last, carried = tuple(rows[k].iloc[-1] for k in keys), int(sums.iloc[-1])

    sorted_rows = df.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    counted = cut_lineage(sorted_rows.mapInPandas(count, schema))
    totals = counted.groupBy(*keys, "_part").agg(F.max("_upto").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    placed = counted.join(offsets, [*keys, "_part"])
    own = F.coalesce(F.col(value).cast("long"), F.lit(0))
    return placed.select(*columns, (F.col("_offset") + F.col("_upto") - own).alias(into))
