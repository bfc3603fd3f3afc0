"""Problem 8: filling containers of fixed capacity with items, by minimum bin slack.

Items of one size are interchangeable, so the plan is made over the histogram of sizes, which has
at most `capacity` rows however many items there are. Each step takes the largest size left and
finds, with a bitset subset-sum over the sizes still available, the fullest combination that fits;
that combination is used for as many containers as the histogram allows and removed. Every step
exhausts at least one size, so there are at most `capacity` steps. Items are then numbered within
their size, in salted ranges whose offsets are joined where the items already are, and joined with
the plan: a row per step and size in it, fewer than capacity * log(capacity) however many items
there are, which is checked before it is broadcast.

Defined results: an item above the capacity is divided into full pieces and a rest, and only then;
null and zero sizes take no space and get no container; equal sizes are filled in order of salt
and id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholion.runtime import cut

#: Items of one size are numbered in this many independent ranges, so that a common size is no hot group.
SALTS = 64
#: Rows of a plan that are broadcast at most.
PLAN_ROWS = 1 << 18


def fullest(capacity: int, sizes: list[tuple[int, int]]) -> dict[int, int]:
    """{size: copies} of the fullest combination of (size, available) within `capacity`, by bitset subset-sum."""
    mask, bits, trail = (1 << (capacity + 1)) - 1, 1, []
    for size, available in sizes:
        copies = min(available, capacity // size)
        step = 1
        while copies > 0 and not bits >> capacity & 1:
            take = min(step, copies)
            trail.append((bits, size, take))
            bits |= (bits << size * take) & mask
            copies -= take
            step *= 2
        if bits >> capacity & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for before, size, take in reversed(trail):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + take
            at -= size * take
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """[(first container, number of equal containers, {size: copies in each})] for all items of the histogram."""
    left, out, first = {s: n for s, n in histogram.items() if s > 0 and n > 0}, [], 0
    while left:
        seed = max(left)
        left[seed] -= 1
        rest = sorted(((s, n) for s, n in left.items() if n and s <= capacity - seed), reverse=True)
        mix = fullest(capacity - seed, rest)
        left[seed] += 1
        mix[seed] = mix.get(seed, 0) + 1
        times = min(left[s] // n for s, n in mix.items())
        for s, n in mix.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        out.append((first, times, mix))
        first += times
    return out


def pack(items: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(container, id_col, piece, start, end, size): every item, or piece of an oversized item, in its container."""
    spark = items.sparkSession
    kind = dict(items.dtypes)[id_col]
    sized = items.select(F.col(id_col).alias("_id"), F.col(size_col).cast("long").alias("_n")).where("_n > 0")
    pieces = sized.select(
        "_id", F.posexplode(F.expr(f"transform(sequence(0L, (_n - 1) div {capacity}), i -> struct(i * {capacity} AS s, least((i + 1) * {capacity}, _n) AS e))")).alias("piece", "span")
    ).select("_id", "piece", F.col("span.s").alias("start"), F.col("span.e").alias("end"), (F.col("span.e") - F.col("span.s")).alias("size"), F.pmod(F.xxhash64("_id", "piece"), F.lit(SALTS)).alias("salt"))
    counts = cut(pieces.groupBy("size", "salt").count())
    # At most capacity * SALTS rows, capacity of which reach the driver.
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("count").alias("n")).collect()}
    rows, offset = [], dict.fromkeys(histogram, 0)
    for first, times, mix in plan(histogram, capacity):
        for size, n in mix.items():
            rows.append((size, offset[size], offset[size] + times * n, first, n))
            offset[size] += times * n
    # A step has few sizes beside those it exhausts; beyond the bound the plan is shuffled like any table.
    steps = spark.createDataFrame(rows, "size long, lo long, hi long, first long, per long")
    steps = F.broadcast(steps) if len(rows) <= PLAN_ROWS else steps
    before = counts.select("size", "salt", (F.sum("count").over(Window.partitionBy("size").orderBy("salt")) - F.col("count")).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy("_id", "piece")) - 1).join(before.hint("merge"), ["size", "salt"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    return (
        ranked.join(steps, (ranked["size"] == steps["size"]) & (ranked["rank"] >= steps["lo"]) & (ranked["rank"] < steps["hi"]))
        .select((F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("per"))).cast("long").alias("container"), F.col("_id").cast(kind).alias(id_col), "piece", "start", "end", ranked["size"])
    )
