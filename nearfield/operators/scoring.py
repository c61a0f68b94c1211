"""Robustness indices over typed neighbours.

`robustness_index` counts neighbours that share only the label (SO) against those that share only the confounder (OS). `margin_robustness_index` weighs
them by exp(-distance / tau). One running sum along the rank scores every k at once. Weights are taken relative to the smallest typed distance of all units for pooled
ratios and to the unit's own for its share, so both are stable for any tau.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import quantile

KEY = ("subset", "q")
TAU = 0.2
CAUSES = ("defined", "same-label-and-confounder", "other-label-and-confounder", "balanced-or-empty")


def k_list(ks) -> list[int]:
    """Positive, without repetitions, in the given order."""
    out = list(dict.fromkeys(int(k) for k in ks))
    if not out or min(out) < 1:
        raise ValueError("k candidates must be positive")
    return out


def k_grid(k_max: int, sparse: bool = False) -> list[int]:
    return [k for k in (1, 3, 5, 7, 9) if k <= k_max] + [*range(11, k_max, 10)] if sparse else [*range(1, k_max + 1)]


def ones(distance: Column) -> Column:
    return F.lit(1.0)


def decay(tau: float):
    """A weight of the distance relative to the smallest typed one."""
    if not tau > 0:
        raise ValueError("tau must be positive")
    return lambda distance: F.exp(-distance / F.lit(float(tau)))


def evidence(found: DataFrame, weight=ones, units: DataFrame | None = None) -> DataFrame:
    """One row for each unit and rank: running counts of the four types, running SO and OS weights (w, relative to the smallest typed distance of all units) and the
    same relative to the unit's own smallest (u). Units without neighbours need `units`."""
    w = Window.partitionBy(*KEY).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    typed = F.col("type").isin("SO", "OS")
    least = found.agg(F.min(F.when(typed, F.col("dist"))).alias("least"))
    nearest = F.min(F.when(typed, F.col("dist"))).over(Window.partitionBy(*KEY))
    rows = found.crossJoin(F.broadcast(least)).withColumn("w", F.when(typed, weight(F.col("dist") - F.col("least"))))  # one row
    rows = rows.withColumn("u", F.when(typed, weight(F.col("dist") - nearest)))
    counts = {f"n_{t.lower()}": F.sum(F.when(F.col("type") == t, 1).otherwise(0)).over(w) for t in ("SS", "SO", "OS", "OO")}
    sums = {f"{x}_{t.lower()}": F.coalesce(F.sum(F.when(F.col("type") == t, F.col(x))).over(w), F.lit(0.0)) for x in ("w", "u") for t in ("SO", "OS")}
    out = rows.select(*KEY, "rank", *(c.alias(n) for n, c in (counts | sums).items()))
    if units is None:
        return out
    none = units.join(out.select(*KEY).distinct(), [*KEY], "left_anti").select(*KEY, F.lit(0).alias("rank"), *(F.lit(0).cast("long").alias(n) for n in counts), *(F.lit(0.0).alias(n) for n in sums))
    return out.unionByName(none)


def at_k(running: DataFrame, ks) -> DataFrame:
    """The running row of each unit at each k; a unit with fewer neighbours counts with its last."""
    ks = k_list(ks)
    last = F.max("rank").over(Window.partitionBy(*KEY))
    rows = running.withColumn("last", last).where(F.col("rank").isin(ks) | (F.col("rank") == F.col("last")))
    grid = F.array(*map(F.lit, ks))
    at = F.filter(grid, lambda k: (k == F.col("rank")) | ((F.col("rank") == F.col("last")) & (k > F.col("last"))))
    return rows.withColumn("k", F.explode(at)).drop("last", "rank")


def per_unit(scored: DataFrame) -> DataFrame:
    """Adds defined, share and cause (0 defined; 1 more SS than OO; 2 more OO than SS; 3 neither)."""
    defined = F.col("n_so") + F.col("n_os") > 0
    cause = F.when(defined, 0).when(F.col("n_ss") > F.col("n_oo"), 1).when(F.col("n_oo") > F.col("n_ss"), 2).otherwise(3)
    return scored.withColumn("defined", defined).withColumn("share", F.when(defined, F.try_divide(F.col("u_so"), F.col("u_so") + F.col("u_os")))).withColumn("cause", cause)


def pooled(scored: DataFrame, by=("k",)) -> DataFrame:
    """Micro average over all units, support, and the shares of undefined causes over all units."""
    so, both = F.sum("w_so"), F.sum(F.col("w_so") + F.col("w_os"))
    rows = per_unit(scored).groupBy(*by).agg(
        F.when(F.sum(F.col("n_so") + F.col("n_os")) > 0, so / both).otherwise(0.5).alias("value"),
        F.avg(F.col("defined").cast("double")).alias("support"),
        *(F.avg((F.col("cause") == i).cast("double")).alias(n) for i, n in ((1, "undefined_ss"), (2, "undefined_oo"), (3, "undefined_tie"))),
        F.count(F.lit(1)).alias("n_units"),
    )
    return rows


def over_subsets(scored: DataFrame) -> DataFrame:
    """Per k: the pooled value, and the number and population deviation of the subsets' own values."""
    each = pooled(scored, ("subset", "k")).groupBy("k").agg(F.stddev_pop("value").alias("std"), F.count(F.lit(1)).alias("n_pairs"))
    return pooled(scored).join(each, "k")


def typed_distances(found: DataFrame, k: int) -> DataFrame:
    return found.where((F.col("rank") <= k) & F.col("type").isin("SO", "OS")).select("subset", "q", "dist")


def recommend_tau(found: DataFrame, k: int, default: float = TAU) -> float:
    """Median typed distance among the k nearest; the default where there is none or it isn't positive."""
    tau = quantile(typed_distances(found, k), "dist", 0.5)
    if tau is None:
        warnings.warn("no typed neighbours: tau falls back to the default", stacklevel=2)
        return default
    if tau <= 0:
        warnings.warn("the median typed distance isn't positive: tau falls back to the default", stacklevel=2)
        return default
    return tau


def assess_tau(distances: DataFrame, tau: float) -> DataFrame:
    """Whether tau lies within a factor of four of the median typed distance."""
    middle = quantile(distances, "dist", 0.5)
    med = distances.agg(F.lit(middle).cast("double").alias("median_distance"), F.count("dist").alias("n_typed"))
    regime = (
        F.when(F.col("median_distance").isNull() | (F.col("median_distance") <= 0), "undetermined")
        .when(F.lit(tau) < F.col("median_distance") / 4, "too_sharp")
        .when(F.lit(tau) > F.col("median_distance") * 4, "too_flat")
        .otherwise("principled")
    )
    return med.withColumn("tau", F.lit(float(tau))).withColumn("regime", regime)


def warn_support(row) -> list[str]:
    say = []
    if row["support"] < 1:
        say.append(f"{1 - row['support']:.1%} of the units have no typed neighbour")
    if row["undefined_oo"] > max(row["undefined_ss"], row["undefined_tie"]):
        say.append("most undefined units are surrounded by rows that share neither")
    for s in say:
        warnings.warn(s, stacklevel=2)
    return say


def robustness_index(found: DataFrame, ks, units: DataFrame | None = None) -> DataFrame:
    return pooled(at_k(evidence(found, ones, units), ks))


def margin_robustness_index(found: DataFrame, ks, *, tau: float | None = None, k_tau: int | None = None, units: DataFrame | None = None) -> DataFrame:
    """One tau for all k; by default the recommended one at the largest k."""
    if tau is not None and not tau > 0:
        raise ValueError("tau must be positive")
    tau = recommend_tau(found, k_tau or max(k_list(ks))) if tau is None else tau
    return pooled(at_k(evidence(found, decay(tau), units), ks)).withColumn("tau", F.lit(float(tau)))


def composition(found: DataFrame, ks) -> DataFrame:
    """Per k: mean share of each type among a unit's first k neighbours (all, if fewer), and quartile points of the OO share. A unit's types are gathered in one array; units are
    counted by k and OO share, of which there are few, and the quartile points (linear) are read from the counts."""
    ks = k_list(ks)
    types = F.col("rank") * 4 + F.when(F.col("type") == "SS", 0).when(F.col("type") == "SO", 1).when(F.col("type") == "OS", 2).otherwise(3)
    units = found.where(F.col("rank") <= max(ks)).groupBy(*KEY).agg(F.array_sort(F.collect_list(types.cast("int"))).alias("types")).select("types")

    def count(batches):
        for batch in batches:
            if not len(batch):
                continue
            size = pc.list_value_length(batch.column("types")).to_numpy()
            flat, start = batch.column("types").flatten().to_numpy() & 3, np.cumsum(size) - size
            running = np.concatenate([np.zeros((4, 1), "int64"), np.cumsum(flat == np.arange(4)[:, None], axis=1)], axis=1)
            for k in ks:
                n = np.minimum(k, size)
                shares = (running[:, start + n] - running[:, start]) / n
                oo, of, units = np.unique(shares[3], return_inverse=True, return_counts=True)
                sums = [np.bincount(of, weights=x) for x in shares[:3]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(oo), k, "int32")), pa.array(oo), pa.array(units), *map(pa.array, sums)], names=["k", "oo", "units", "ss", "so", "os"])

    counted = units.mapInArrow(count, "k int, oo double, units long, ss double, so double, os double")
    rows = counted.groupBy("k", "oo").agg(*(F.sum(c).alias(c) for c in ("units", "ss", "so", "os")))
    w = Window.partitionBy("k")
    rows = rows.withColumn("n", F.sum("units").over(w)).withColumn("upto", F.sum("units").over(w.orderBy("oo")))

    def point(q: float) -> Column:
        at = (F.col("n") - 1) * q
        low, high = (F.min(F.when(F.col("upto") > end(at), F.col("oo"))) for end in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        return (1 - part) * low + part * high

    means = [(F.sum(c) / F.sum("units")).alias(f"mean_{c}") for c in ("ss", "so", "os")] + [(F.sum(F.col("oo") * F.col("units")) / F.sum("units")).alias("mean_oo")]
    return rows.groupBy("k").agg(*means, *(point(q).alias(f"oo_q{round(q * 100)}") for q in (0.25, 0.75, 0.9)))


def contested(units: DataFrame) -> DataFrame:
    """units: per_unit rows at one k with counts. Shares of defined, pure and contested units."""
    d = F.col("defined")
    return units.agg(
        F.avg(d.cast("double")).alias("defined"),
        F.avg((d & (F.col("n_os") == 0)).cast("double")).alias("pure_so"),
        F.avg((d & (F.col("n_so") == 0)).cast("double")).alias("pure_os"),
        F.avg(((F.col("n_so") > 0) & (F.col("n_os") > 0)).cast("double")).alias("contested"),
    )


def rank_depth(found: DataFrame, first: DataFrame, depths=(10, 25, 50)) -> DataFrame:
    """Per unit: rank of the first SO, first OS (from neighbors.first_typed, over all candidates), both and either; the share of SS among the first ranks."""
    rows = found.groupBy(*KEY).agg(*(F.avg(F.when(F.col("rank") <= d, (F.col("type") == "SS").cast("double"))).alias(f"ss_at_{d}") for d in depths)).join(first, list(KEY), "left")
    both = F.when(F.col("first_so").isNotNull() & F.col("first_os").isNotNull(), F.greatest("first_so", "first_os"))
    return rows.withColumn("first_both", both).withColumn("first_typed", F.least("first_so", "first_os"))
