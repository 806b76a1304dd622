"""Containers of fixed capacity filled with items of varying length, every window of them mixed like the target.

Sources are queues. Deficit round-robin serves each queue its share of every window and carries what a queue was served too much or
too little into the next; an exhausted queue's share goes to the others. Served like a fluid, a queue has reached its running total c
when p * v = c, with p its share and v the rounds so far, and by then all queues together have been served the sum over them of
min(p * v, total). So an item's window follows from its running total alone, across partitions too.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.running import running_totals

OTHER = ""


def split_items(sized: DataFrame, limits: DataFrame, kind: str = "container_kind", capacity: str = "capacity_tokens") -> DataFrame:
    """Pieces (container_kind, capacity, source, doc_id, piece, start, size) of items (doc_id, source, n_tokens) for every kind.

    An item within the capacity is one piece; a longer one is cut into full pieces and a rest. Items of null or no size have none.
    The kinds are a short fixed list; those without a positive capacity are left out.
    """
    kinds = [(r[0], r[1]) for r in limits.where(F.col(kind).isNotNull() & (F.col(capacity) > 0)).select(kind, F.col(capacity).cast("long")).distinct().collect()]
    each = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity")) for k, c in sorted(kinds)]).cast("array<struct<container_kind:string,capacity:bigint>>")
    rows = sized.where("n_tokens > 0").select("doc_id", F.coalesce("source", F.lit(OTHER)).alias("source"), "n_tokens", F.inline(each))
    rows = rows.withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.col("capacity"))))
    return rows.select(
        "container_kind",
        "capacity",
        "source",
        "doc_id",
        (F.col("start") / F.col("capacity")).cast("int").alias("piece"),
        "start",
        F.least("capacity", F.col("n_tokens") - F.col("start")).alias("size"),
    )


def mixed_windows(pieces: DataFrame, shares: dict[str, float], containers: int = 256) -> DataFrame:
    """Adds ``window`` to pieces: ``containers`` capacities of tokens, in which each source has its share while it lasts.

    ``shares`` is a short list of target proportions; sources that it does not name form one queue, which gets its own part of all
    tokens as its share. The order within a queue follows a hash of the id.
    """
    known = {s: p for s, p in shares.items() if p and p > 0}
    queue = F.when(F.col("source").isin(*known), F.col("source")).otherwise(OTHER) if known else F.lit(OTHER)
    queued = pieces.withColumn("queue", queue).withColumn("_order", F.concat_ws("/", F.hex(F.xxhash64("doc_id")), "doc_id", F.lpad(F.col("piece"), 9, "0")))
    totals: dict[str, dict[str, int]] = {}
    for row in queued.groupBy("container_kind", "queue").agg(F.sum("size").alias("total")).collect():  # as many rows as kinds and shares
        totals.setdefault(row.container_kind, {})[row.queue] = row.total
    placed = running_totals(queued, ["container_kind", "queue"], "_order", "size")
    window = F.lit(None)
    for kind, own in totals.items():
        everything, named = sum(own.values()), sum(known.get(q, 0) for q in own)
        rest = own.get(OTHER, 0) / everything
        share = {q: rest if q == OTHER else known[q] / named * (1 - rest) for q in own}
        rounds = F.lit(None)
        for q, p in share.items():
            rounds = F.when(F.col("queue") == q, F.col("before") / F.lit(p)).otherwise(rounds)
        served = sum((F.least(rounds * F.lit(p), F.lit(float(own[q]))) for q, p in share.items()), F.lit(0.0))
        window = F.when(F.col("container_kind") == kind, F.floor(served / (F.col("capacity") * containers))).otherwise(window)
    return placed.withColumn("window", window.cast("long")).drop("_order", "before")


def fill_containers(windowed: DataFrame) -> DataFrame:
    """Assigns every piece of a window to a container of it: ``container`` counts from 0 within (container_kind, window).

    Pieces are taken from the largest to the smallest, equals by id; each goes where the least room is left. A window holds a bounded
    number of tokens and so of pieces.
    """
    schema = "container_kind string, window long, container int, capacity long, source string, doc_id long, piece int, start long, size long"

    def fill(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["size", "doc_id", "piece"], ascending=[False, True, True])
        rooms: list[tuple[int, int]] = []
        number, chosen = 0, []
        for size, capacity in zip(pieces["size"], pieces["capacity"]):
            at = bisect_left(rooms, (size, -1))
            room, container = rooms.pop(at) if at < len(rooms) else (capacity, number)
            number += container == number
            if room > size:
                insort(rooms, (int(room - size), container))
            chosen.append(container)
        return pieces.assign(container=chosen)[["container_kind", "window", "container", "capacity", "source", "doc_id", "piece", "start", "size"]]

    return windowed.groupBy("container_kind", "window").applyInPandas(fill, schema)


def pack(sized: DataFrame, limits: DataFrame, shares: dict[str, float], containers: int = 256) -> DataFrame:
    """Every item of (doc_id, source, n_tokens) in containers of every kind; see the functions above. An empty table gives no rows;
    a repeated doc_id is packed as often as it comes."""
    return fill_containers(mixed_windows(split_items(sized, limits), shares, containers))


def fill_report(packed: DataFrame) -> DataFrame:
    """Per kind: containers, pieces, tokens, and the share of the room that is filled."""
    each = packed.groupBy("container_kind", "window", "container").agg(F.first("capacity").alias("capacity"), F.sum("size").alias("size"), F.count("*").alias("n"))
    return each.groupBy("container_kind").agg(
        F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.sum("size").alias("tokens"), (F.sum("size") / F.sum("capacity")).alias("filled")
    )
