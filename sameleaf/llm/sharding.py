"""Op 10: minimax contiguous partition of documents into shards, with DataFrame functions only.

Documents with equal texts form a group, and a group stays whole unless it is larger than a shard's
equal share of all bytes; only then is it cut. Groups are ordered by the hash of their text and gathered
in UNITS ranges of that order. A group of more than 1 / PART of all bytes or rows is an item of its own,
and its rows are dealt to parts of about that size: a whole group's parts are placed together, and those
of a group that has to be cut one by one. So no task ranks a large group. The driver sees the sizes of
units and parts only, at most UNITS + 4 * PART + 1 rows at any input size. It looks for the smallest
capacity with which a greedy pass over the ordered sizes needs at most the wanted number of shards, and
cuts there. Slots come from the offsets of units and parts and a rank inside them.

Defined results: a null text has size 16 and the CRC of no bytes, and forms a group with the other
nulls; an empty text likewise forms its own group. A null doc_id sorts first. Repeated rows each get
a slot. Empty input gives empty output. Other columns of the input are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, keep_columns, table

SHARDS, UNITS, PART, OVERHEAD = 40, 1 << 16, 1000, 16


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The smallest capacity with which at most `shards` contiguous runs hold all sizes."""

    def feasible(capacity: int) -> bool:
        runs, room = 1, capacity
        for x in sizes:
            if x > room:
                runs, room = runs + 1, capacity
                if runs > shards:
                    return False
            room -= x
        return True

    low, high = max([0, *sizes, -(-sum(sizes) // shards)]), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def cut_greedily(sizes: list[int], shards: int) -> list[int]:
    """The shard of each of the ordered sizes: contiguous, none over the smallest capacity.

    Among such cuts a shard is closed once it has its share of what is left, if the rest still fits;
    that keeps the last shards from staying empty.
    """
    capacity, left = smallest_capacity(sizes, shards), sum(sizes)
    needed = [1] * (len(sizes) + 1)  # runs that the greedy pass needs from here
    ends, end, total = [0] * len(sizes), len(sizes), 0
    for i in range(len(sizes) - 1, -1, -1):
        total += sizes[i]
        while total > capacity:
            end -= 1
            total -= sizes[end]
        ends[i] = end
        needed[i] = 1 + (needed[end] if end < len(sizes) else 0)
    out, shard, used = [], 0, 0
    share = left / shards
    for i, x in enumerate(sizes):
        full = used + x > capacity or (used + x / 2 > share and used and needed[i] <= shards - 1 - shard)
        if full and shard < shards - 1:
            left -= used
            shard, used = shard + 1, 0
            share = left / (shards - shard)
        out.append(shard)
        used += x
    return out


def shard_documents(docs: DataFrame, shards: int = SHARDS, units: int = UNITS, part: int = PART) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    null = F.col("text").isNull()
    rows = cut(
        keep_columns(docs, "doc_id", "text").select(
            "doc_id",
            F.when(null, OVERHEAD).otherwise(F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text, null).alias("h1"),
            F.xxhash64(F.lit("second"), text, null).alias("h2"),
            F.monotonically_increasing_id().alias("row"),  # fixed by writing the table
        )
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    share = F.greatest(F.col("bytes") * part / F.lit(float(total or 1)), F.col("n") * part / F.lit(float(n or 1)))
    hot = (
        rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(share > 1)
        .select("h1", "h2", F.ceil(share).cast("long").alias("parts"), (F.col("bytes") * shards > total).alias("cut"))
    )
    # At most 2 * `part` groups can each hold more than 1 / part of the bytes or of the rows: a proven bound.
    rows = rows.join(F.broadcast(hot), ["h1", "h2"], "left").select(
        "doc_id", "size", "text_crc32", "cut",
        F.shiftrightunsigned("h1", 64 - (units.bit_length() - 1)).alias("unit"),
        F.when(F.col("parts").isNotNull(), F.col("h1")).alias("group"),
        F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row"), "parts")).alias("part"),
    )
    key = ["unit", "group", "part"]
    sums = sorted(
        rows.groupBy(*key, "cut").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect(),
        key=lambda r: (r["unit"], r["group"] is not None, r["group"] or 0, r["part"] or 0),
    )
    items: list[list] = []  # what is placed together
    for r in sums:
        if items and r["cut"] is False and items[-1][0]["group"] == r["group"] and items[-1][0]["unit"] == r["unit"]:
            items[-1].append(r)
        else:
            items.append([r])
    placed, filled = [], [0] * shards
    for item, s in zip(items, cut_greedily([sum(r["bytes"] for r in item) for item in items], shards), strict=True):
        for r in item:
            placed.append((r["unit"], r["group"] or 0, -1 if r["part"] is None else r["part"], s, filled[s]))
            filled[s] += r["n"]
    kind = T.StructType([T.StructField(n, T.LongType(), False) for n in ("unit", "group", "part", "shard", "before")])
    at = spark.createDataFrame(placed, kind)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("doc_id", "text_crc32", "size"))
    return (
        rows.withColumns({"group": F.coalesce("group", F.lit(0)), "part": F.coalesce("part", F.lit(-1))})
        .join(F.broadcast(at), key)  # at most units + 4 * part + 1 rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
            (F.col("before") + rank - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
