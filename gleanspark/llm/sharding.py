"""Sharding by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from gleanspark.llm.store import plain, ranked, row_key, written

#: Bytes that a document counts for besides its text.
OVERHEAD = 16
#: Sizes are dealt with in classes: exact below 2**(BITS + 1), within 2**-BITS of each other above.
BITS = 12


def size_class(size: Column) -> Column:
    """The smallest size of the class of ``size``: its leading BITS + 1 binary digits."""
    digits = F.length(F.conv(size.cast("string"), 10, 2))
    unit = F.pow(F.lit(2.0), F.greatest(digits - (BITS + 1), F.lit(0))).cast("long")
    return size - F.pmod(size, unit)


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int], list[int]]]:
    """Deals groups, given as (class, number, bytes), largest first, each to the least-loaded shard through a heap.

    Returns for each class the shards that get some of its groups, and how many groups go to each of these and those
    before it: at most ``shards`` entries, however many groups there are.

    A class of many groups is dealt at once as far as the heap's order is known: a shard takes a group at its load,
    then at its load and one size, and so on, and the heap takes the least of all these. All below some level are
    dealt together, the level found by bisection; the few that are left go through the heap one by one.
    """
    heap = [(0.0, s) for s in range(shards)]
    out = []
    for key, number, total in sorted(classes, reverse=True):
        size, taken = total / number, [0] * shards
        left = number
        if left > 4 * shards:
            loads = np.array([load for load, _ in sorted(heap, key=lambda x: x[1])])
            dealt = lambda level: np.maximum(np.ceil((level - loads) / size), 0).astype(np.int64)
            low, high = float(loads.min()), float(loads.min()) + size * (left + 1)
            for _ in range(64):
                level = (low + high) / 2
                low, high = (level, high) if dealt(level).sum() <= left else (low, level)
            taken = dealt(low).tolist()
            left -= sum(taken)
            heap = [(float(load) + size * n, s) for s, (load, n) in enumerate(zip(loads, taken))]
            heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            taken[s] += 1
        some = [s for s in range(shards) if taken[s]]
        out.append((key, some, np.cumsum([taken[s] for s in some]).tolist()))
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``bytes``: groups of equal texts stay together and shards hold nearly equal bytes, as far as the largest
    group allows. A row's size is its text's UTF-8 bytes plus OVERHEAD. slot counts a shard's rows from 0 without
    gaps. grown_shard is null under this law.

    Null texts are empty and belong to the group of empty texts. Repeated rows and null ids are rows like others;
    an empty table gives an empty result; other columns are ignored.

    Only the histogram of group sizes reaches the driver, in classes, of which there are at most about
    2**BITS for each doubling of the size. Ranks inside a class and slots inside a shard are taken in
    buckets, so a class, group or shard with most of the rows is ranked by many tasks.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.sha2(text, 256).alias("same"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    rows = written(rows.withColumn("same", F.unhex("same")).withColumn("key", row_key("id", "same")), "rows")
    groups = rows.groupBy("same").agg(F.sum("size").alias("bytes")).withColumn("class", size_class(F.col("bytes")))
    groups = written(groups, "groups")
    histogram = [tuple(r) for r in groups.groupBy("class").agg(F.count(F.lit(1)), F.sum("bytes")).collect()]
    plan = spark.createDataFrame(schedule(histogram, shards), "class long, shards array<int>, ends array<long>")

    placed = ranked(groups, ["class"], ["same"], "rank").join(plan, "class")
    before = F.size(F.filter("ends", lambda end: end <= F.col("rank")))
    placed = placed.select("same", F.get("shards", before).alias("shard"))
    placed = written(rows.join(placed, "same").select("id", "key", "size", "text_crc32", "shard"), "placed")
    return ranked(placed, ["shard"], ["key"], "slot").select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), 40)
