"""Sharding over fixed virtual slots with a versioned slot-to-shard map."""

from __future__ import annotations

import bisect
import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from residua.llm.common import exists, grouped_rank, hot_keys, read, settled, stored, without

SLOTS = 16_384
SHARDS = 24
#: A shard may hold so much over the mean before the map is edited.
TOLERANCE = 0.0005
#: Ids with over a HOT-th of all rows are spread over the slots.
HOT = 1000


def virtual_slot(doc_id, slots: int = SLOTS):
    """The slot of a record, for good: a hash of its id."""
    return F.pmod(F.xxhash64(doc_id), F.lit(slots)).cast("int")


def slotted(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``records`` (a stored table with doc_id) with virtual_slot.

    Ids (null is one) that over 1 / HOT of all rows have, HOT at most, would each fill a slot that no map can split: their rows go to the slot
    of their id and a number of their own, spread over all slots.
    """
    hot = hot_keys(records, "doc_id", HOT).select(F.col("doc_id").alias("_hot"), F.lit(True).alias("_is_hot"))
    t = records.join(F.broadcast(hot), F.col("doc_id").eqNullSafe(F.col("_hot")), "left")
    own = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(slots)).cast("int")
    return t.withColumn("virtual_slot", F.when(F.col("_is_hot"), own).otherwise(virtual_slot(F.col("doc_id"), slots))).drop("_hot", "_is_hot")


def first_map(slots: int, shards: int) -> list[int]:
    """Version 1: runs of slots of equal length."""
    return [s * shards // slots for s in range(slots)]


def rebalanced(held: list[int], of: list[int], shards: int, tolerance: float = TOLERANCE) -> list[int]:
    """The next version of the map ``of`` for slots that hold ``held`` bytes: few slots move, until shards differ little.

    The fullest shard gives a slot to the emptiest, the one that comes nearest to half of their difference; it ends when that
    difference is within ``tolerance`` of the mean or no slot of the fullest is smaller than it. Ties: lowest number.
    """
    of, total = list(of), [0] * shards
    mine: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for s, b in enumerate(held):
        total[of[s]] += b
        if b:
            mine[of[s]].append((b, s))
    for x in mine:
        x.sort()
    mean = sum(held) / shards
    full, empty = [(-t, k) for k, t in enumerate(total)], [(t, k) for k, t in enumerate(total)]
    heapq.heapify(full)
    heapq.heapify(empty)
    for _ in range(20 * len(held)):
        while -full[0][0] != total[full[0][1]]:
            heapq.heappop(full)
        while empty[0][0] != total[empty[0][1]]:
            heapq.heappop(empty)
        hi, lo = full[0][1], empty[0][1]
        gap = total[hi] - total[lo]
        if gap <= tolerance * mean or not mine[hi]:
            break
        at = bisect.bisect_left(mine[hi], (gap / 2, -1))
        near = [i for i in (at - 1, at) if 0 <= i < len(mine[hi])]
        i = min(near, key=lambda j: (abs(mine[hi][j][0] - gap / 2), mine[hi][j][1]))
        b, s = mine[hi][i]
        if b >= gap:
            break
        mine[hi].pop(i)
        bisect.insort(mine[lo], (b, s))
        of[s] = lo
        for k, d in ((hi, -b), (lo, b)):
            total[k] += d
            heapq.heappush(full, (-total[k], k))
            heapq.heappush(empty, (total[k], k))
    return of


def next_map(spark: SparkSession, held: list[int], shards: int = SHARDS, tolerance: float = TOLERANCE, store: str | None = None) -> tuple[DataFrame, str, int]:
    """The stored maps (version, virtual_slot, shard, bytes), their path, and the version for slots that hold ``held`` bytes.

    A store that is there is read, its last version edited for these bytes and this number of shards, and what comes out appended as the
    next version if any slot moves; earlier versions stay. Without one, version 1 deals out runs of slots. The table has slots * versions rows.
    """
    slots, versions = len(held), []
    if store is not None and exists(spark, store):
        table = spark.read.parquet(store)
        last = table.agg(F.max("version")).first()[0]
        rows = table.filter(F.col("version") == last).select("virtual_slot", "shard").collect()
        of = [0] * len(rows)
        for s, k in rows:
            of[s] = k
        if len(of) != slots:
            raise ValueError(f"the map in {store} has {len(of)} slots, not {slots}")
        if max(of) >= shards:  # shards that are gone: their slots go round the rest
            of = [k if k < shards else s % shards for s, k in enumerate(of)]
            versions.append((last + 1, of))
    else:
        last, of = 0, first_map(slots, shards)
        versions.append((1, of))
    new = rebalanced(held, of, shards, tolerance)
    if versions and last:
        versions[-1] = (last + 1, new)
    elif new != of:
        versions.append((last + 1 + len(versions), new))
    if versions:
        rows = [(v, s, m[s], held[s]) for v, m in versions for s in range(slots)]
        frame = spark.createDataFrame(rows, "version int, virtual_slot int, shard int, bytes long").coalesce(1)
        if store is None:
            return *stored(frame, "slot-map"), versions[-1][0]
        frame.write.mode("append").parquet(store)
    return spark.read.parquet(store), store, versions[-1][0] if versions else last


def assign(records: DataFrame, slots: int = SLOTS, shards: int = SHARDS, tolerance: float = TOLERANCE, store: str | None = None) -> tuple[DataFrame, str]:
    """``records`` (doc_id, size, ...) with virtual_slot, shard and map_version; and the path of the stored map.

    Bytes are summed per slot (``slots`` rows come to the driver, whatever the input), and ``next_map`` makes or edits the map in ``store``.
    Columns named like those that are added are replaced. Null sizes count as 0. Empty table: empty result.
    """
    spark = records.sparkSession
    t, _ = stored(without(records, ["virtual_slot", "shard", "map_version"]), "records")
    t, _ = stored(slotted(t, slots), "slotted")
    held = [0] * slots
    for s, b in t.groupBy("virtual_slot").agg(F.sum("size")).collect():
        held[s] = int(b or 0)
    table, path, version = next_map(spark, held, shards, tolerance, store)
    last = table.filter(F.col("version") == version).select("virtual_slot", "shard", F.col("version").alias("map_version"))
    return t.join(F.broadcast(last), "virtual_slot"), path


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law ``bytes``, shard, slot (place in the shard), grown_shard null, virtual_slot, map_version.

    Null text: size 8, checksum of no bytes. Repeated and null ids: a row each, in the slot of their id, or spread if they are many. Rows equal
    in slot, id and checksum get places in any order. Empty table: empty result. Other columns don't matter.
    """

    def make() -> DataFrame:
        text = F.coalesce(F.col("text"), F.lit(""))
        slim = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"))
        t = grouped_rank(assign(slim)[0], ["shard"], [F.col("virtual_slot").asc(), F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc()], "slot")
        return t.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")

    return settled(spark, make, "shards")
