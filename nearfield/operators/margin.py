"""The cross-confounder margin: how much nearer the m nearest rows of the same label (other confounder) are than those of the same
confounder (other label)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import finite
from ..sources.shared import stash
from .quantiles import wide

KEY = ("subset", "q")


def margins(typed: DataFrame, ms, units: DataFrame | None = None) -> DataFrame:
    """typed: nearest_typed rows with rank up to max(ms). Per unit and m: n_so, n_os, d_so, d_os and the margin, null where support is not total."""
    ms = [ms] if isinstance(ms, int) else [*ms]
    grid = typed.withColumn("m", F.explode(F.array(*map(F.lit, ms)))).where("rank <= m")
    aggs = [a for t in ("SO", "OS") for a in (F.count(F.when(F.col("type") == t, 1)).alias(f"n_{t.lower()}"), F.avg(F.when(F.col("type") == t, F.col("dist"))).alias(f"d_{t.lower()}"))]
    rows = grid.groupBy(*KEY, "m").agg(*aggs)
    if units is not None:
        rows = units.select(*KEY, F.explode(F.array(*map(F.lit, ms))).alias("m")).join(rows, [*KEY, "m"], "left").na.fill(0, ["n_so", "n_os"])
    total = (F.col("n_so") == F.col("m")) & (F.col("n_os") == F.col("m")) & (F.col("d_os") + F.col("d_so") > 0)
    return rows.withColumn("margin", F.when(total, (F.col("d_os") - F.col("d_so")) / (F.col("d_os") + F.col("d_so"))))


def require_support(rows: DataFrame) -> DataFrame:
    """Total support or an error that names the counts and the cause; no partial results."""
    bad = rows.agg(F.count(F.when((F.col("n_so") < F.col("m")) | (F.col("n_os") < F.col("m")), 1)).alias("few"), F.count(F.when(F.col("margin").isNull(), 1)).alias("none")).first()
    if bad["none"]:
        raise RuntimeError(f"{bad['few']} units lack m neighbours of a type and {bad['none'] - bad['few']} have a zero denominator")
    return rows


def summary(rows: DataFrame) -> DataFrame:
    """Per m: the median of the subsets' medians, the population deviation of these, and the number of subsets."""
    rows = stash(rows.select("m", "subset", "margin"), "margins")
    each = rows.groupBy("m", "subset").agg(F.count(F.lit(1)).alias("n")).join(wide(rows, "margin", {"median": 0.5}, by=["m", "subset"], written=True), ["m", "subset"], "left")
    each = stash(each, "medians")
    over = each.groupBy("m").agg(F.stddev_pop("median").alias("std"), F.count(F.lit(1)).alias("n_pairs"))
    return over.join(wide(each, "median", {"value": 0.5}, by=["m"], written=True), "m", "left").select("m", "value", "std", "n_pairs")


def tail(rows: DataFrame, column: str = "margin", alpha: float = 0.1, by=()) -> DataFrame:
    """The alpha quantile (linear) of the finite values, the mean of those not above it, and how many these are."""
    good = stash(rows.select(*by, finite(F.col(column)).alias("x")).where("x is not null"), "finite")
    q = wide(good, "x", {"quantile": alpha}, by=by, written=True)
    joined = good.join(q, [*by]) if by else good.crossJoin(F.broadcast(q))  # one row
    return joined.groupBy(*by).agg(F.max("quantile").alias("quantile"), F.avg(F.when(F.col("x") <= F.col("quantile"), F.col("x"))).alias("lower_tail_mean"), F.count(F.when(F.col("x") <= F.col("quantile"), 1)).alias("n_tail"))


def not_positive(rows: DataFrame, column: str = "margin", by=()) -> DataFrame:
    """Share of the finite values at or below zero."""
    x = finite(F.col(column))
    return rows.groupBy(*by).agg(F.avg(F.when(x.isNotNull(), (x <= 0).cast("double"))).alias("f0"))


def sweep_shape(swept: DataFrame) -> DataFrame:
    """swept: m, value. Mean height by the trapezoid rule, smallest value, last minus first."""
    w = Window.orderBy("m")
    step = (F.col("m") - F.lag("m").over(w)) * (F.col("value") + F.lag("value").over(w)) / 2
    return swept.withColumn("area", step).agg(
        (F.sum("area") / (F.max("m") - F.min("m"))).alias("auc"), F.min("value").alias("least"), (F.max_by("value", "m") - F.min_by("value", "m")).alias("rise")
    )


def depths(found: DataFrame, m: int) -> DataFrame:
    """found: ranked rows of all candidates. Per unit the rank at which both types reach their m-th neighbour."""
    w = Window.partitionBy(*KEY, "type").orderBy("rank")
    nth = found.where("type in ('SO', 'OS')").withColumn("nth", F.row_number().over(w)).where(F.col("nth") == m)
    return nth.groupBy(*KEY).agg(F.max("rank").alias("depth"), F.count(F.lit(1)).alias("types")).where("types = 2").drop("types")


def search_schedule(n: int, depth: int, start_k: int = 200, growth: float = 2.0) -> dict[str, int]:
    """k_start, k_final and retries that a widening search over n rows would report, given the greatest depth needed."""
    k = start = max(1, min(start_k, n - 1))
    grow = lambda k: min(n - 1, max(k + 1, math.ceil(k * growth)))
    retries = 0
    while k < depth and k < n - 1:
        k, retries = grow(k), retries + 1
    if k < n - 1:
        k, retries = grow(k), retries + 1
    return {"k_start": start, "k_final": k, "retries": retries}
