"""Minimax contiguous sharding (native DataFrame operations only).

Groups of equal texts are atomic. They are put in one fixed order, that of their text's hash,
and cut into `n_shards` contiguous shards so that the largest shard has as few bytes as
possible. The smallest feasible capacity is found by binary search, each capacity checked by
greedy cuts against running sums that were written once, in order. The check needs only the
group ends near the cuts: if a bounded number of them is in question the search runs on those,
else jobs that follow many capacities at once, a step per shard, narrow the question first. At
that capacity each cut is made as near to its even share as the capacity allows, to the same
cuts on either path.

A group may hold any share of the rows: rows are salted by doc_id inside their group, so that
no task gets more than one cell of a group. Running sums are made in a fixed number of hash
blocks, which keeps both levels of the sum distributed.

Defined results: a null text has the size 1, crc32 0 and groups with empty texts; rows with a
null doc_id come first in their cell; repeated rows get different slots. An empty table gives
no rows. A group larger than the even share makes its shard that large and no larger.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import cut, table

N_SHARDS = 16
SALTS = 256
BLOCKS = 4096
PROBES = 32
NEAR_ROWS = 200_000


def sizes(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the group's hash h and the row's salt."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(SALTS)).cast("int").alias("salt"),
    )


def _block(h: str) -> Column:
    return (F.shiftright(h, 52) + BLOCKS // 2).cast("int")


def running_sums(cells: DataFrame) -> DataFrame:
    """Adds to each cell its block's place and the rows and bytes up to its end, in the order
    of (h, text_crc32, salt); last: it ends its group."""
    inside = Window.partitionBy("block").orderBy("h", "text_crc32", "salt")
    cells = cells.withColumn("block", _block("h"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over 4096 block totals at most
    totals = (
        cells.groupBy("block").agg(F.sum("bytes").alias("b"), F.sum("rows").alias("r"))
        .select("block", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"))
    )
    after = F.lead("h").over(inside)
    return (
        cells.withColumns({
            "bytes_end": F.sum("bytes").over(inside),
            "rows_end": F.sum("rows").over(inside),
            "last": after.isNull() | (after != F.col("h")) | (F.lead("text_crc32").over(inside) != F.col("text_crc32")),
        })
        .join(F.broadcast(totals), "block")
        .select("block", "h", "text_crc32", "salt", (F.col("bytes_end") + F.col("b0")).alias("bytes_end"), (F.col("rows_end") + F.col("r0") - F.col("rows")).alias("rows_before"), (F.col("rows_end") + F.col("r0")).alias("rows_end"), "last")
    )


def greedy_cuts(ends: DataFrame, capacities: list[int], largest: int, total: int, n_shards: int) -> list[list[int]]:
    """For each capacity the byte positions at which greedy shards end; n_shards of them, the
    last one `total` if the capacity is feasible."""
    cuts: list[list[int]] = [[] for _ in capacities]
    at = [0] * len(capacities)
    for _ in range(n_shards):
        goal = [a + c for a, c in zip(at, capacities)]
        open_ = [i for i, a in enumerate(at) if a < total]
        if open_:
            found = (
                ends.where(F.col("bytes_end").between(min(goal[i] for i in open_) - largest, max(goal[i] for i in open_)))
                .agg(*(F.max(F.when(F.col("bytes_end") <= goal[i], F.col("bytes_end"))).alias(str(i)) for i in open_))
                .first()
            )
            for i in open_:
                at[i] = max(at[i], found[str(i)] or 0)
        for a, c in zip(at, cuts):
            c.append(a)
    return cuts


def local_cuts(near: list[int], capacity: int, total: int, n_shards: int) -> list[int]:
    """Greedy cuts among `near`, the sorted ends that any capacity in question can cut at."""
    at, cuts = 0, []
    for _ in range(n_shards):
        at = total if at + capacity >= total else max(at, near[bisect_right(near, at + capacity) - 1])
        cuts.append(at)
    return cuts


def even_cuts(near: list[int], capacity: int, total: int, n_shards: int) -> list[int]:
    """Cuts within the capacity, each as near to its even share as the earlier and the later
    shards allow; the greedy ones if `near` doesn't hold the ends that this takes."""
    least = [total] * (n_shards + 1)  # the earliest cut from which the rest still fits
    for k in range(n_shards - 1, 0, -1):
        least[k] = near[min(bisect_left(near, least[k + 1] - capacity), len(near) - 1)]
    at, cuts = 0, []
    for k in range(1, n_shards):
        a, b = bisect_left(near, max(least[k], at)), bisect_right(near, at + capacity) - 1
        goal = bisect_left(near, k * total / n_shards)
        best = min((i for i in (goal - 1, goal) if 0 <= i < len(near)), key=lambda i: abs(near[i] - k * total / n_shards))
        at = near[max(0, min(max(best, a), b))]
        cuts.append(at)
    cuts.append(total)
    if all(0 <= b - a <= capacity for a, b in zip([0, *cuts], cuts)):
        return cuts
    return local_cuts(near, capacity, total, n_shards)


def even_cuts_by_jobs(ends: DataFrame, capacity: int, total: int, n_shards: int) -> list[int]:
    """What even_cuts gives on all the ends, each found by a job over `ends`."""
    end = F.col("bytes_end")

    def first_from(x: int) -> int:
        return 0 if x <= 0 else ends.where(end >= x).agg(F.min(end)).first()[0]

    def last_to(x: int) -> int:
        return total if x >= total else ends.where(end <= x).agg(F.max(end)).first()[0] or 0

    goals = [k * total / n_shards for k in range(1, n_shards)]
    sides = [f(F.when(c, end)) for g in goals for f, c in ((F.max, end < g), (F.min, end >= g))]
    found = ends.agg(*(s.alias(str(i)) for i, s in enumerate(sides))).first() if goals else []
    least = [total] * (n_shards + 1)
    for k in range(n_shards - 1, 0, -1):
        least[k] = first_from(least[k + 1] - capacity)
    at, cuts = 0, []
    for k, goal in enumerate(goals, 1):
        best = min((found[2 * k - 2] or 0, found[2 * k - 1]), key=lambda e: abs(e - goal))
        best = max(best, least[k], at)
        at = best if best <= at + capacity else last_to(at + capacity)
        cuts.append(at)
    return [*cuts, total]


def minimax_cuts(ends: DataFrame, n_shards: int, near_rows: int = NEAR_ROWS) -> list[int]:
    """Cut positions of the smallest feasible capacity. ends: bytes_end of every group.

    For the capacities in question, lo to hi, the k-th cut lies in a known range. If these
    ranges hold at most `near_rows` ends, the search goes on among those alone; else jobs that
    follow `PROBES` capacities at once narrow lo and hi first. The first ranges hold every end
    that evening out can take, later ones don't: then it is done by jobs, with the same cuts."""
    w = ends.agg(F.max("bytes_end").alias("total"), F.max("group_bytes").alias("largest")).first()
    total, largest = w["total"] or 0, w["largest"] or 0
    if not total:
        return [0] * n_shards
    even = -(-total // n_shards)
    lo, hi = max(largest, even), even + largest  # hi is always feasible
    ranges = [(k * (lo - largest), k * hi) for k in range(1, n_shards)]
    narrowed = False
    while True:
        inside = ends.where(reduce(or_, (F.col("bytes_end").between(a, b) for a, b in ranges), F.lit(False)))
        if inside.count() <= near_rows:
            near = [0, *inside.agg(F.sort_array(F.collect_list("bytes_end"))).first()[0]]
            while lo < hi:
                middle = (lo + hi) // 2
                if local_cuts(near, middle, total, n_shards)[-1] == total:
                    hi = middle
                else:
                    lo = middle + 1
            return even_cuts_by_jobs(ends, lo, total, n_shards) if narrowed else even_cuts(near, lo, total, n_shards)
        capacities = sorted({*range(lo, hi, max(1, -(-(hi - lo) // PROBES))), hi})
        cuts = greedy_cuts(ends, capacities, largest, total, n_shards)
        k = next(i for i, c in enumerate(cuts) if c[-1] == total)
        lo, hi = capacities[k - 1] + 1 if k else lo, capacities[k]
        if lo == hi:
            return even_cuts_by_jobs(ends, lo, total, n_shards)
        ranges, narrowed = list(zip(cuts[k - 1], cuts[k])), True


def shard(documents: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    rows = sizes(documents)
    cells = rows.groupBy("h", "text_crc32", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    sums = cut(running_sums(cells).repartitionByRange("bytes_end").sortWithinPartitions("bytes_end"), "sums")
    start = Window.partitionBy("block").orderBy("bytes_end")
    group_ends = sums.where("last").select("block", "bytes_end")
    first = group_ends.groupBy("block").agg(F.max("bytes_end").alias("block_end"))
    before = first.select("block", F.coalesce(F.lag("block_end").over(Window.orderBy("block")), F.lit(0)).alias("b0"))
    ends = group_ends.join(F.broadcast(before), "block").select("bytes_end", (F.col("bytes_end") - F.coalesce(F.lag("bytes_end").over(start), F.col("b0"))).alias("group_bytes"))
    ends = cut(ends.repartitionByRange("bytes_end").sortWithinPartitions("bytes_end"), "ends")
    cuts = minimax_cuts(ends, n_shards)
    inner = sorted(set(cuts))
    base = {r["bytes_end"]: r["rows_end"] for r in sums.where(F.col("last") & F.col("bytes_end").isin(inner)).select("bytes_end", "rows_end").collect()}
    number = sum((F.when(F.col("bytes_end") > c, 1).otherwise(0) for c in cuts[:-1]), F.lit(0))
    starts = F.array(*(F.lit(v).cast("bigint") for v in [0, *(base.get(c, 0) for c in cuts[:-1])]))
    placed = sums.withColumn("shard", number.cast("int")).select("h", "text_crc32", "salt", "shard", (F.col("rows_before") - F.get(starts, F.col("shard"))).alias("first_slot"))
    in_cell = F.row_number().over(Window.partitionBy("h", "text_crc32", "salt").orderBy(F.col("doc_id").asc_nulls_first()))
    return (
        rows.withColumn("place", in_cell)
        .join(placed, ["h", "text_crc32", "salt"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first_slot") + F.col("place") - 1).alias("slot"))
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
