"""Exact quantiles of many groups at once, and of what is outside each group, with bounded state.

A scope's values are cut into some hundred ranges of about equal size (from approximate quantiles), and the rows of each group in each range are counted. The counts say
in which range an order statistic lies: a group's own from its counts, that of the rest of the scope from the counts of all less the group's. Ranges of more than
SMALL rows that are asked for are cut again; a range of one value needs no more. Only the rows of small ranges are put in order, so no task
holds a group, and rows are never joined with the groups they are outside of. A scope of any size takes about log(n / SMALL) / log(CUTS) rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import finite
from ..sources.shared import stash

#: Ranges of a cut, the sketch's accuracy, rows that may be put in order in one task, rows of a table that one aggregate may hold, and rows of a table that is broadcast.
CUTS, ACCURACY, SMALL, ONE_BUFFER, FEW = 128, 10_000, 20_000, 100_000, 4096


def quantiles(df: DataFrame, value: str, qs, *, by=(), group=(), rest: bool = False, written: bool = False) -> DataFrame:
    """Columns by and group, q, and x: the quantile (linear) of the finite values of each group, or with `rest` of the scope (the rows alike in `by`) without the
    group. Groups whose values are all null or not finite, and rests without a row, have none. The rows are written first, unless df is `written` or cheap to read again."""
    qs, by, group = [qs] if isinstance(qs, float) else [*qs], [*by], [*group]
    rows = df.select(_key(by).alias("s"), _key(group).alias("g"), finite(F.col(value)).alias("x")).where("x is not null")
    rows = rows if written else stash(rows, "values")
    if not rest and rows.limit(ONE_BUFFER + 1).count() <= ONE_BUFFER:
        points = F.percentile("x", F.array(*map(F.lit, qs)))
        found = rows.groupBy("s", "g").agg(points.alias("x")).select("s", "g", F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), "x")).alias("p")).select("s", "g", "p.q", "p.x")
    else:
        found = _found(rows, qs, rest)
    return found.select(*(F.col(f"s.k{i}").alias(c) for i, c in enumerate(by)), *(F.col(f"g.k{i}").alias(c) for i, c in enumerate(group)), "q", "x")


def wide(df: DataFrame, value: str, names: dict[str, float], *, by=(), group=(), rest: bool = False, written: bool = False) -> DataFrame:
    """As quantiles, one row for each group with a column for each q."""
    found = quantiles(df, value, [*dict.fromkeys(names.values())], by=by, group=group, rest=rest, written=written)
    return found.groupBy(*by, *group).agg(*(F.max(F.when(F.col("q") == q, F.col("x"))).alias(n) for n, q in names.items()))


def _key(columns: list[str]) -> Column:
    """The columns as one struct: nulls in it are equal to each other, in groups and joins alike."""
    return F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(columns)), F.lit(0).alias("all"))


def _small_side(df: DataFrame) -> DataFrame:
    """Broadcast if its rows are few: a range has a kilobyte of bounds at most."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def _found(rows: DataFrame, qs: list[float], rest: bool) -> DataFrame:
    own = rows.groupBy("s", "g").agg(F.count(F.lit(1)).alias("own"))
    scopes = own.groupBy("s").agg(F.sum("own").alias("n"))
    size = F.col("n") - F.col("own") if rest else F.col("own")
    asked = own.join(scopes, "s").withColumn("size", size).where("size > 0").withColumn("q", F.explode(F.array(*map(F.lit, qs))))
    asked = asked.withColumn("at", (F.col("size") - 1) * F.col("q")).withColumn("side", F.explode(F.array(F.lit("low"), F.lit("high"))))
    asked = asked.withColumn("p", F.when(F.col("side") == "low", F.floor("at")).otherwise(F.ceil("at"))).withColumn("part", F.col("at") - F.floor("at"))
    asked = stash(asked.select("s", "g", "q", "side", "p", "part", F.lit("").alias("path"), (F.col("n") > SMALL).alias("open")), "asked")
    rows, done = rows.withColumn("path", F.lit("")), [_in_order(rows.withColumn("path", F.lit("")), asked.where("not open"), rest)]
    while asked.where("open").limit(1).count():
        asked = asked.where("open")
        rows, asked, settled = _cut(rows, asked, rest)
        done += [settled, _in_order(rows, asked.where("not open"), rest)]
    ends = reduce(DataFrame.unionByName, done).groupBy("s", "g", "q").agg(*(F.max(F.when(F.col("side") == e, F.col("x"))).alias(e) for e in ("low", "high")), F.first("part").alias("part"))
    return ends.select("s", "g", "q", ((1 - F.col("part")) * F.col("low") + F.col("part") * F.col("high")).alias("x"))


def _cut(rows: DataFrame, asked: DataFrame, rest: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: the rows of the ranges that are still asked for, the order statistics in them, and those that are settled."""
    held = rows.join(_small_side(asked.select("s", "path").distinct()), ["s", "path"], "left_semi")
    points = F.percentile_approx("x", F.array(*(F.lit(i / CUTS) for i in range(1, CUTS))), F.lit(ACCURACY))
    bounds = stash(held.groupBy("s", "path").agg(F.array_distinct(points).alias("b")), "bounds")
    # a bound's own value is a range by itself, so values that many rows share are settled and every round gets on
    bin_ = F.size(F.filter("b", lambda y: y < F.col("x"))) + F.size(F.filter("b", lambda y: y <= F.col("x")))
    dealt = held.join(_small_side(bounds), ["s", "path"]).withColumn("bin", bin_).drop("b")
    counts = stash(dealt.groupBy("s", "path", "bin", "g").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most")), "counts")
    whole = counts.groupBy("s", "path", "bin").agg(F.sum("n").alias("all"), F.min("least").alias("least"), F.max("most").alias("most"))
    of = asked.join(whole, ["s", "path"]).join(counts.select("s", "path", "bin", "g", "n"), ["s", "path", "bin", "g"], "left").fillna(0, ["n"])
    of = of.withColumn("c", F.col("all") - F.col("n") if rest else F.col("n"))
    upto = F.sum("c").over(Window.partitionBy("s", "g", "q", "side").orderBy("bin"))
    at = of.withColumn("before", upto - F.col("c")).where("before <= p and p < before + c").withColumn("p", F.col("p") - F.col("before"))
    at = stash(at.withColumn("path", F.concat_ws("/", "path", "bin")).withColumn("open", F.col("all") > SMALL), "asked")
    settled = at.where("least = most").select("s", "g", "q", "side", "part", F.col("least").alias("x"))
    more = at.where("least < most").select("s", "g", "q", "side", "p", "part", "path", "open")
    left = dealt.withColumn("path", F.concat_ws("/", "path", "bin")).drop("bin")
    return stash(left.join(_small_side(more.select("s", "path").distinct()), ["s", "path"], "left_semi"), "values"), more, settled


def _in_order(rows: DataFrame, asked: DataFrame, rest: bool) -> DataFrame:
    """The order statistics that lie in small ranges."""
    if rest:
        met = rows.withColumnRenamed("g", "of").join(asked, ["s", "path"]).where(F.col("of") != F.col("g"))
        place = F.row_number().over(Window.partitionBy("s", "g", "q", "side").orderBy("x")) - 1
        return met.withColumn("place", place).where("place = p").select("s", "g", "q", "side", "part", "x")
    small = rows.join(asked.select("s", "path").distinct(), ["s", "path"], "left_semi")
    placed = small.withColumn("p", (F.row_number().over(Window.partitionBy("s", "path", "g").orderBy("x")) - 1).cast("long"))
    return placed.join(asked, ["s", "path", "g", "p"]).select("s", "g", "q", "side", "part", "x")
