"""Exact ranks within groups by histograms of key digits, without a global sort.

The leading digits of the first key deal the rows of each group to buckets of about `PER` rows. Counting the buckets and then, eight bits at a time, the
buckets of buckets gives the number of rows before each bucket: every sum runs over 256 counts at most, however many rows there are. Only inside a bucket rows are
put in order. A bucket that holds more than `MOST` rows (dense or repeated keys) is dealt anew by its next digits, then by the next key.

Defined results: nulls come before all numbers. The last key must tell all rows of a group apart; rows alike in it get their order from the engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach, free_name, stash

#: Rows that a bucket is made for, rows above which it is dealt anew, and bits of a digit of the counts.
PER, MOST, BITS = 1024, 65_536, 8


def ranks(rows: DataFrame, group: str, keys: list[str], *, out: str = "rank", total: str = "group_rows") -> DataFrame:
    """Adds each row's place (from 0) among the rows of its group in ascending order of the keys, and the number of these. rows must be a written table, as it is
    read several times; group holds no nulls; the keys are integers of 64 bits at most."""
    node, before, key, bucket, n, start = (free_name([*rows.columns, out, total], f"_{x}") for x in ("node", "before", "key", "bucket", "n", "start"))
    open_rows = rows.withColumns({node: F.col(f"`{group}`").cast("string"), before: F.lit(0).cast("long"), total: F.lit(0).cast("long"), key: F.col(f"`{keys[0]}`").cast("long")})
    order = Window.partitionBy(node, bucket).orderBy(*(F.col(f"`{k}`") for k in keys))
    kept, at, width = [], 0, None
    while True:
        low, high, count = open_rows.agg(F.min(key), F.max(key), F.count(F.lit(1))).first()
        if not count:
            break
        low, span = (0, 1) if low is None else (low, high - low + 1)
        shift = min(63, max(0, (span * PER // count).bit_length() - 1))
        dealt = open_rows.withColumn(bucket, F.coalesce(F.shiftright(key, shift) - F.lit(low >> shift) + 1, F.lit(0).cast("long")))
        found = stash(_starts(dealt, node, bucket, n, start, ((low + span - 1) >> shift) - (low >> shift) + 1), "buckets")
        placed = attach(dealt, found, [node, bucket], n, count)
        placed = placed.withColumns({before: F.col(before) + F.col(start), total: F.when(F.col(total) == 0, F.col(f"{n}_all")).otherwise(F.col(total))})
        last = at == len(keys) - 1 and shift == 0
        cold = placed if last else placed.where(F.col(n) <= MOST)
        kept.append(cold.select(*(F.col(f"`{c}`") for c in rows.columns), (F.col(before) + F.row_number().over(order) - 1).alias(out), total))
        if last or not found.where(F.col(n) > MOST).limit(1).count():
            break
        rest = placed.where(F.col(n) > MOST).withColumn(node, F.concat_ws("/", node, bucket)).drop(bucket, n, start, f"{n}_all")
        if shift:
            rest = rest.withColumn(key, F.col(key).bitwiseAND(F.lit((1 << shift) - 1)))
        else:
            at += 1
            rest = rest.withColumn(key, F.col(f"`{keys[at]}`").cast("long"))
        open_rows = stash(rest, "dense")
    if not kept:
        return rows.withColumns({out: F.lit(0).cast("long"), total: F.lit(0).cast("long")})
    return reduce(DataFrame.unionByName, kept)


def _starts(dealt: DataFrame, node: str, bucket: str, n: str, start: str, most: int) -> DataFrame:
    """For each bucket its rows n, the rows of its node before it, and all rows of the node (n_all). most: the largest bucket."""
    levels = [stash(dealt.groupBy(node, bucket).agg(F.count(F.lit(1)).alias(n)), "counts")]
    while most >> BITS * len(levels):
        up = F.shiftright(bucket, BITS).alias(bucket)
        levels.append(levels[-1].groupBy(node, up).agg(F.sum(n).alias(n)))
    whole = Window.partitionBy(node)
    found = levels[-1].withColumn(start, F.sum(n).over(whole.orderBy(bucket)) - F.col(n)).withColumn(f"{n}_all", F.sum(n).over(whole))
    for level in reversed(levels[:-1]):
        above = found.select(node, F.col(bucket).alias(f"{bucket}_up"), F.col(start).alias(f"{start}_up"), f"{n}_all")
        within = Window.partitionBy(node, f"{bucket}_up").orderBy(bucket)
        own = level.withColumn(f"{bucket}_up", F.shiftright(bucket, BITS))
        found = own.withColumn(start, F.sum(n).over(within) - F.col(n)).join(above, [node, f"{bucket}_up"])
        found = found.withColumn(start, F.col(start) + F.col(f"{start}_up")).select(node, bucket, n, start, f"{n}_all")
    return found
