"""Filling containers of fixed capacity by large-item matching.

All that decides a packing is how many items there are of each size, and there are at most ``capacity`` sizes. The
matching therefore runs on these counts: items above a third of the capacity are matched greedily (two of them in a
container at most, the largest partner that fits), the smaller ones then go best-fit into what is left, largest
first. The outcome is a short list of container patterns with the number of containers of each. The items take
their places by their rank within their size, which is found without gathering the items of a size in one task.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwell.session import written


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes in a container, number of such containers); sizes are between 1 and ``capacity``."""
    left = Counter({s: n for s, n in counts.items() if n > 0})
    order = sorted(left)
    bins: list[tuple[tuple[int, ...], int]] = []

    def largest(limit: int, floor: int = 0) -> int | None:
        k = bisect_right(order, limit) - 1
        return order[k] if k >= 0 and order[k] > floor else None

    def take(s: int, n: int) -> None:
        left[s] -= n
        if not left[s]:
            order.remove(s)

    third = capacity // 3
    while (a := largest(capacity, third)) is not None:  # matching of the large items
        b = largest(min(a, capacity - a), third)
        if b is None:
            bins.append(((a,), n := left[a]))
            take(a, n)
        elif b == a:
            n, odd = divmod(left[a], 2)
            if n:
                bins.append(((a, a), n))
                take(a, 2 * n)
            if odd:
                b = largest(min(a - 1, capacity - a), third)
                bins.append(((a,) if b is None else (a, b), 1))
                take(a, 1)
                if b is not None:
                    take(b, 1)
        else:
            n = min(left[a], left[b])
            bins.append(((a, b), n))
            take(a, n)
            take(b, n)
    # best fit of the small ones: gaps by size, the largest item into the tightest gap that holds it
    gaps: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(pattern: tuple[int, ...], n: int) -> None:
        room = capacity - sum(pattern)
        if room not in gaps:
            rooms.insert(bisect_right(rooms, room), room)
            gaps[room] = []
        gaps[room].append([pattern, n])

    for pattern, n in bins:
        put(pattern, n)
    while (s := largest(capacity)) is not None:
        k = bisect_right(rooms, s - 1)
        if k == len(rooms):
            fit, n = max(1, capacity // s), left[s]
            if n >= fit:
                put((s,) * fit, n // fit)
                take(s, n // fit * fit)
            else:
                put((s,) * n, 1)
                take(s, n)
            continue
        room = rooms[k]
        pattern, n = gaps[room].pop()
        if not gaps[room]:
            del gaps[room]
            rooms.pop(k)
        each = min(room // s, left[s])
        m = min(n, left[s] // each)
        put(pattern + (s,) * each, m)
        take(s, m * each)
        if n > m:
            put(pattern, n - m)
    merged: Counter = Counter()
    for room in rooms:
        for pattern, n in gaps[room]:
            merged[tuple(sorted(pattern, reverse=True))] += n
    return sorted(merged.items(), reverse=True)


def pack(items: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = 2048) -> DataFrame:
    """(key, part, size, container): each item, or each part of an item above the capacity, with its container.

    An item above the capacity is cut into full containers and a rest (part 0, 1, ...); no other item is cut.
    Items of size 0, negative or null need no room and get container null. Keys may repeat: each row is an item.
    The driver gets the count of each size, so at most ``capacity`` rows, and plans on these.
    """
    spark = items.sparkSession
    n = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    parts = items.select(F.col(key).alias("key"), F.greatest(n, F.lit(0)).alias("n")).select(
        "key", F.posexplode(F.expr(f"transform(sequence(0L, greatest(0L, (n - 1) div {capacity})), i -> least({capacity}L, n - i * {capacity}L))")).alias("part", "size")
    )
    # ranks within a size: range partitions, counted, then offset; no task needs a whole size
    parts = written(parts.repartitionByRange("size", "key", "part").sortWithinPartitions("size", "key", "part").withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "pack")
    held = parts.groupBy("pid", "size").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()  # at most sizes + partitions rows
    counts: Counter = Counter()
    offsets = []
    for r in sorted(held, key=lambda r: (r["pid"], r["size"])):
        offsets.append((r["pid"], r["size"], counts[r["size"]] - r["first"]))
        counts[r["size"]] += r["n"]
    slots, container = [], 0
    used: Counter = Counter()
    for pattern, times in plan({s: c for s, c in counts.items() if s > 0}, capacity):
        for s, each in Counter(pattern).items():
            slots.append((s, used[s], used[s] + each * times, container, each))
            used[s] += each * times
        container += times
    kinds = "size long, lo long, hi long, base long, each int"
    ranges = spark.createDataFrame(slots, kinds).groupBy("size").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "base", "each"))).alias("slots"))
    offset = spark.createDataFrame(offsets, "pid int, size long, shift long")
    ranked = parts.join(F.broadcast(offset), ["pid", "size"]).select("key", "part", "size", (F.col("at") + F.col("shift")).alias("rank"))
    # all the slots of a size sum to no more than its patterns; both tables are bounded by sizes, not by items
    hit = F.expr("filter(slots, s -> s.lo <= rank and rank < s.hi)[0]")
    return (
        ranked.join(F.broadcast(ranges), "size", "left")
        .withColumn("slot", hit)
        .select(F.col("key").alias(key), "part", F.col("size"), (F.col("slot.base") + F.floor((F.col("rank") - F.col("slot.lo")) / F.col("slot.each")).cast("long")).alias("container"))
    )
